"""Every registered query against its SQL on the smallest tables, and the CSV and JSON sinks."""

from __future__ import annotations

import pytest
from check_oracles import connect, difference

import __spark_entry__ as entry
from weaksift.plans.catalog import ORACLES, QUERIES
from weaksift.operators import clusters as C
from weaksift.operators import summaries as U
from weaksift.plans.tables import tables
from weaksift.sources import sinks as K


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(rows, connection.execute(ORACLES[name]).df()) is None


def test_entry_holds_all_queries():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_has_all_categories(spark):
    assert entry.entry(spark).count() == 7


def test_csv_and_json_sinks(spark, sf_dir, tmp_path):
    t = tables(spark, sf_dir)
    run = {
        "evidence_rows": t.evidence, "prepared_items": t.items, "category_summaries": U.category_summary(t.evidence),
        "excluded_items": t.assessed.where("NOT kept").select("source_index", "exclude_reasons"), "clusters": t.rollup,
    }
    paths = K.export_csv(run, str(tmp_path), "run")
    assert len(paths) == 5
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths["evidence_items"])
    assert back.count() == t.evidence.count() and "evidence_excerpt" in back.columns
    first = t.evidence.orderBy("item_no", "category_ord").first()
    match = back.where((back.item_id == first.item_id) & (back.category == first.category)).first()
    assert match.evidence_excerpt == first.evidence_excerpt and match.matched_terms == "; ".join(first.matched_terms)
    K.write_csv(t.evidence.limit(0), str(tmp_path / "empty"))
    review = C.review_rows(t.members.where("threshold = 0.12"), t.items, t.rollup)
    files = K.export_review(review, str(tmp_path), "run")
    assert spark.read.json(files["labels"]).count() == t.items.count()
    K.export_json({"items": t.items.select("item_id", "labels")}, str(tmp_path), "run")
    assert spark.read.json(str(tmp_path / "run_items")).count() == t.items.count()
