from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weaksift.operators import history as H
from weaksift.operators import numbering as N
from weaksift.sources import raw_items as I


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("root", ""), ("child", "root"), ("grandchild", "child"), ("orphan", "gone"), ("a", "b"), ("b", "a"), ("self", "self"),
    ]
    return spark.createDataFrame(rows, "run_id string, resume_from_run_id string")


@pytest.mark.parametrize(
    "run_id, expected",
    [
        ("grandchild", ["grandchild", "child", "root"]), ("root", ["root"]), ("orphan", ["orphan"]),
        ("a", ["a", "b"]), ("self", ["self"]), ("unknown", []),
    ],
)
def test_lineage(runs, run_id, expected):
    assert [r.ancestor for r in H.lineage(runs, run_id).orderBy("depth").collect()] == expected


def test_lineage_of_all_runs(runs):
    rows = H.all_lineages(runs)
    assert rows.count() == 1 + 2 + 3 + 1 + 2 + 2 + 1
    assert [r.ancestor for r in rows.where("run_id = 'grandchild'").orderBy("depth").collect()] == ["grandchild", "child", "root"]


PAGES = [
    ("s1", "q1", 0, 3, 2, True), ("s1", "q1", 1, 1, 0, False), ("s1", "q2", 1, 5, 5, True), ("s2", "q1", 4, 1, 1, True),
]
PAGE_SCHEMA = "source string, query string, page_number long, raw_count long, item_count long, has_more boolean"


def test_collection_state_and_resume_points(spark):
    states = H.collection_state(spark.createDataFrame(PAGES, PAGE_SCHEMA))
    found = {(r.source, r.query): r for r in states.collect()}
    first = found[("s1", "q1")]
    assert (first.page_count, first.last_page_number, first.next_page_number) == (2, 1, 2)
    assert (first.total_raw_count, first.total_item_count, first.completed) == (4, 2, True)
    assert [tuple(r) for r in H.resume_points(states, "s1").collect()] == [("s1", "q2", 2)]


def test_resume_plan_loses_no_page(spark):
    states = H.collection_state(spark.createDataFrame(PAGES, PAGE_SCHEMA))
    queries = spark.createDataFrame(
        [("s1", "q1", 0), ("s1", "q2", 0), ("s2", "q1", 1), ("s2", "never", 1)], "source string, query string, first_page long"
    )
    taken = spark.createDataFrame([("s1", "q1", 2), ("s1", "q2", 3), ("s2", "q1", 1)], "source string, query string, items_taken long")
    plan = {(r.source, r.query): r.next_page_number for r in H.resume_plan(queries, states, taken).collect()}
    # q1 is done; q2 was cut short by the cap, so its page repeats; a query never reached starts.
    assert plan == {("s1", "q2"): 1, ("s2", "q1"): 5, ("s2", "never"): 1}


def test_resume_dedupe_marks_and_drops(spark):
    schema = "source_name string, source_id string, text string"
    seen = spark.createDataFrame([("fixture", "review-1", "a")], schema)
    new = spark.createDataFrame([("fixture", "review-1", "b"), ("fixture", "review-2", "c"), ("other", "review-1", "d")], schema)
    marked = {(r.source_name, r.source_id): r for r in H.mark_seen(new, seen, "parent").collect()}
    assert marked[("fixture", "review-1")].duplicate_reason == "seen_in_resume_chain"
    assert marked[("fixture", "review-1")].resume_from_run_id == "parent"
    assert marked[("other", "review-1")].duplicate_reason is None
    assert sorted(r.text for r in H.drop_seen(new, seen).collect()) == ["c", "d"]


def test_saving_a_run_again_replaces_it_alone(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "run_id string, source_type string, source_name string, source_id string, title string, arrival long"
    first = [("r1", "review", "n", "1", "old", 1), ("r1", "review", "n", "1", "new", 2), ("r1", "review", "n", "2", "x", 3)]
    H.save_run({"raw_items": spark.createDataFrame(first, schema)}, root, "arrival")
    H.save_run({"raw_items": spark.createDataFrame([("r2", "review", "n", "1", "y", 1)], schema)}, root, "arrival")
    H.save_run({"raw_items": spark.createDataFrame([("r1", "review", "n", "9", "z", 1)], schema)}, root, "arrival")
    rows = {(r.run_id, r.source_id, r.title) for r in H.read_table(spark, root, "raw_items").collect()}
    assert rows == {("r1", "9", "z"), ("r2", "1", "y")}


def test_artifacts_append_and_last_wins(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = (
        "run_id string, batch_index long, item_id string, source_id string, artifact_type string, model_name string, "
        "model_version string, input_hash string, artifact string, created_at string"
    )
    row = lambda item, kind, text, at: ("r1", 1, item, item, kind, "m", "v1", "h", text, at)
    H.append_artifacts(spark.createDataFrame([row("i1", "embedding", "old", "1"), row("i2", "embedding", "b", "1")], schema), root)
    H.append_artifacts(spark.createDataFrame([row("i1", "embedding", "new", "2"), row("i1", "cluster", "c", "2")], schema), root)
    stored = H.read_table(spark, root, "model_artifacts")
    assert {(r.item_id, r.artifact_type, r.artifact) for r in stored.collect()} == {
        ("i1", "embedding", "new"), ("i2", "embedding", "b"), ("i1", "cluster", "c"),
    }
    page = H.artifact_page(stored, artifact_type="embedding", limit=1, offset=1).collect()
    assert [r.item_id for r in page] == ["i2"]


def test_numbers_equal_one_global_window(spark):
    keys = [k * 7 % 1009 for k in range(1, 600)]
    rows = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g int").repartition(7)
    dense = {r.k: r.n for r in N.dense_positions(rows, "k", "n", chunk=50).collect()}
    assert dense == {k: i for i, k in enumerate(sorted(keys), start=1)}
    sparse = rows.select((F.col("k") * 10**12).alias("k"))
    assert {r.k // 10**12: r.n for r in N.dense_positions(sparse, "k", "n").collect()} == dense
    total = {r.k: r.total for r in N.running_total(rows, "k", "g", "total", chunk=50).collect()}
    running, expected = 0, {}
    for k in sorted(keys):
        running += k % 3
        expected[k] = running
    assert total == expected
    ranked = {r.k: r.place for r in N.global_rank(rows, ["g"], [F.desc("k")], "place").collect()}
    for g in range(3):
        group = sorted((k for k in keys if k % 3 == g), reverse=True)
        assert [ranked[k] for k in group] == list(range(1, len(group) + 1))


def test_batch_of_items_by_cumulative_range(spark):
    batches = spark.createDataFrame([(1, 2), (2, 0), (3, 3)], "batch_index long, quality_candidates long")
    items = spark.createDataFrame([(f"review-{i}",) for i in range(1, 8)], "item_id string")
    found = {r.item_id: r.batch_index for r in H.batch_of_items(items, batches).collect()}
    assert [found[f"review-{i}"] for i in range(1, 8)] == [1, 1, 3, 3, 3, 3, 3]  # past the end: the last batch


def test_cap_and_first_per_source(spark):
    rows = spark.createDataFrame([("review", str(i % 40), i) for i in range(100)], "source_type string, source_id string, place long")
    first = I.first_per_source_id(rows, ["place"])
    assert sorted(r.place for r in first.collect()) == list(range(40))
    assert sorted(r.place for r in I.cap_per_source(rows, ["place"], 5).collect()) == list(range(5))


@pytest.mark.parametrize("cap", [5, 5000])
def test_cap_keeps_rows_without_a_type(spark, cap):
    rows = [("review", i) for i in range(50)] + [("discussion", i) for i in range(3)] + [(None, i) for i in range(20)]
    found = I.cap_per_source(spark.createDataFrame(rows, "source_type string, place long"), ["place"], cap).collect()
    assert sorted(((r.source_type, r.place) for r in found), key=repr) == sorted((r for r in rows if r[1] < cap), key=repr)


def test_saving_a_run_again_leaves_no_stale_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    evidence = spark.createDataFrame([("r/1", f"i{i}", "pain") for i in range(10)] + [("r2", "i", "pain")], "run_id string, item_id string, category string")
    H.save_run({"evidence_rows": evidence}, root)
    H.save_run({"evidence_rows": evidence.limit(0)}, root, run_ids=["r/1"])
    assert [r.run_id for r in H.read_table(spark, root, "evidence_rows").collect()] == ["r2"]
    schema = "run_id string, source_type string, source_name string, source_id string"
    H.save_run({"raw_items": spark.createDataFrame([("r2", t, "n", t) for t in ("review", "discussion")], schema)}, root)
    H.save_run({"raw_items": spark.createDataFrame([("r2", "review", "n", "review")], schema)}, root)
    assert [r.source_type for r in H.read_table(spark, root, "raw_items").collect()] == ["review"]


def test_rows_with_one_key_need_an_arrival_column(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "i", "pain"), ("r1", "i", "pain")], "run_id string, item_id string, category string")
    with pytest.raises(ValueError, match="arrival"):
        H.save_run({"evidence_rows": rows}, str(tmp_path / "store"))


def test_seen_keys_without_an_id(spark):
    schema = "source_name string, source_id string, text string"
    new = spark.createDataFrame([(None, "1", "a"), ("n", None, "b"), ("n", "2", "c")], schema)
    seen = spark.createDataFrame([("", "1", "x"), ("n", "", "y")], schema)
    assert [r.text for r in H.drop_seen(new, seen).collect()] == ["c"]
    assert sorted(r.text for r in H.mark_seen(new, seen, "p").where("duplicate_reason is null").collect()) == ["c"]


def test_lineage_of_a_long_chain(spark):
    runs = spark.range(5000).selectExpr("concat('r', id) as run_id", "if(id = 0, '', concat('r', id - 1)) as resume_from_run_id")
    walk = H.lineage(runs, "r4999").collect()
    assert len(walk) == 5000 and {r.ancestor: r.depth for r in walk}["r0"] == 4999


def test_lineages_with_branches_and_long_cycles(spark):
    parents = {"c0": "c2", "c1": "c0", "c2": "c1", "t": "c1", "u": "t", "x": "gone", "y": "x", "s": "s", "z": "s"}
    runs = spark.createDataFrame(list(parents.items()), "run_id string, resume_from_run_id string")
    expected = set()
    for start in parents:
        walk, at = [], start
        while at in parents and at not in walk:
            walk.append(at)
            at = parents[at]
        expected |= {(start, a, d) for d, a in enumerate(walk)}
        assert {(r.run_id, r.ancestor, r.depth) for r in H.lineage(runs, start).collect()} == {e for e in expected if e[0] == start}
    assert {tuple(r) for r in H.all_lineages(runs).collect()} == expected


def test_discussion_pages(spark, tmp_path):
    path = tmp_path / "pages"
    path.mkdir()
    (path / "p.json").write_text(
        '{"query": "q", "page_number": 0, "hits": [{"objectID": "1", "story_id": 7, "comment_text": "hello"}, '
        '{"objectID": "2", "parent_id": 8, "comment_text": " "}, {"objectID": "3", "comment_text": "<p>hi</p>", "author": "me"}], "nbPages": 2}\n'
        '{"query": "q", "page_number": 1, "hits": []}\n'
    )
    pages = I.read_discussion_pages(spark, str(path))
    items = {r.source_id: r for r in I.discussion_items(pages).collect()}
    assert set(items) == {"1", "3"}
    assert items["1"].source_url.endswith("=7") and items["3"].source_url.endswith("=3")
    assert items["1"].author == "unknown" and items["3"].author == "me"
    log = {r.page_number: r for r in I.discussion_page_log(pages).collect()}
    assert (log[0].raw_count, log[0].item_count, log[0].has_more) == (3, 2, True)
    assert (log[1].raw_count, log[1].has_more, log[1].request_params) == (0, False, {})


def test_question_pages(spark, tmp_path):
    path = tmp_path / "pages"
    path.mkdir()
    (path / "p.json").write_text(
        '{"query": "q", "page_number": 1, "request_params": {"tagged": "x", "page": "1"}, "items": [{"question_id": 5, "title": "A &amp; B", "body": "<p>x</p>\\ny", "tags": ["a", "b"], '
        '"score": 0, "creation_date": 86400}, {"title": "no id"}], "has_more": true}\n'
    )
    log = I.question_page_log(I.read_question_pages(spark, str(path))).first()
    assert log.request_params == {"tagged": "x", "page": "1"} and log.has_more
    rows = {r.source_id: r for r in I.question_items(I.read_question_pages(spark, str(path))).collect()}
    assert rows["5"].text == "A & B. x y" and rows["5"].rating == "0" and rows["5"].reviewed_product == "a, b"
    assert rows["5"].created_at == "1970-01-02T00:00:00+00:00"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        again = I.question_items(I.read_question_pages(spark, str(path))).where("source_id = '5'").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert again.created_at == "1970-01-02T00:00:00+00:00"
    assert rows["unknown-question"].created_at == "" and rows["unknown-question"].author == "unknown"


def test_page_plan(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    assert {(r.page_size, r.max_pages) for r in I.page_plan(queries, 50).collect()} == {(17, 1)}
    assert {(r.page_size, r.max_pages) for r in I.page_plan(queries, 900, page_size=40).collect()} == {(40, 8)}


def test_raw_items_reader_takes_defaults(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"source_type": "review", "source_id": "1", "text": "t", "created_at": "2026-01-01T00:00:00+00:00"}]')
    rows = I.with_timestamps(I.with_defaults(I.read_raw_items(spark, str(tmp_path / "items.json"), json_lines=False)))
    row = rows.first()
    assert row.rating == "" and row.is_demo_fallback is False and row.created_ts is not None and row.collected_ts is None


def test_chain_reads_prune_partitions(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"r{i}", f"i{k}", "pain") for i in range(6) for k in range(3)], "run_id string, item_id string, category string")
    H.save_run({"evidence_rows": rows}, root)
    runs = spark.createDataFrame([(f"r{i}", f"r{i - 1}" if i else "") for i in range(6)], "run_id string, resume_from_run_id string")
    chain = H.chain_runs(H.lineage(runs, "r3"))
    read = H.in_chain(H.read_table(spark, root, "evidence_rows"), chain)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert chain == ["r0", "r1", "r2", "r3"] and "PartitionFilters: [run_id" in plan.replace("isnotnull(run_id", "")
    assert read.count() == 12 and len(read.inputFiles()) >= 1
    with pytest.raises(ValueError, match="more than 2 runs"):
        H.chain_runs(H.lineage(runs, "r3"), most=2)


EVIDENCE = "run_id string, item_id string, category string"


def evidence_of(spark, run, items):
    return spark.createDataFrame([(run, i, "pain") for i in items], EVIDENCE)


def stored_items(spark, root, **options):
    return sorted((r.run_id, r.item_id) for r in H.read_table(spark, root, "evidence_rows", **options).collect())


def test_a_save_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    """Whether it dies among its tables or before its manifest is in place; the next save works."""
    root = str(tmp_path / "store")
    runs = spark.createDataFrame([("r1", "")], "run_id string, resume_from_run_id string")
    H.save_run({"evidence_rows": evidence_of(spark, "r1", "ab"), "runs": runs}, root)
    broken = evidence_of(spark, "r1", "x").withColumn("item_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        H.save_run({"runs": runs.withColumn("resume_from_run_id", F.lit("new")), "evidence_rows": broken}, root)

    def no_rename(*_):
        raise OSError("dead")

    with monkeypatch.context() as m:
        m.setattr(H.S, "_put", no_rename)
        with pytest.raises(OSError):
            H.save_run({"evidence_rows": evidence_of(spark, "r1", "xyz")}, root)
    assert stored_items(spark, root) == [("r1", "a"), ("r1", "b")]
    assert [r.resume_from_run_id for r in H.read_table(spark, root, "runs").collect()] == [""]
    H.save_run({"evidence_rows": evidence_of(spark, "r1", "c")}, root)
    assert stored_items(spark, root) == [("r1", "c")]


def test_a_reader_sees_one_version(spark, tmp_path):
    root = str(tmp_path / "store")
    first = H.save_run({"evidence_rows": evidence_of(spark, "r1", "ab")}, root)
    open_ = H.read_table(spark, root, "evidence_rows")
    H.save_run({"evidence_rows": evidence_of(spark, "r1", "cde")}, root)
    H.save_run({"evidence_rows": evidence_of(spark, "r2", "f")}, root)
    assert sorted(r.item_id for r in open_.collect()) == ["a", "b"]
    assert stored_items(spark, root) == [("r1", "c"), ("r1", "d"), ("r1", "e"), ("r2", "f")]
    assert stored_items(spark, root, run_ids=["r2", "gone"]) == [("r2", "f")]
    assert stored_items(spark, root, number=first) == [("r1", "a"), ("r1", "b")]
    assert H.S.clear_versions(spark, root) == 1
    assert stored_items(spark, root) == [("r1", "c"), ("r1", "d"), ("r1", "e"), ("r2", "f")]
    H.save_run({"evidence_rows": H.read_table(spark, root, "evidence_rows").where("run_id = 'r1'").limit(1)}, root)  # from itself
    assert len(stored_items(spark, root)) == 2


def test_saves_at_the_same_time(spark, tmp_path, monkeypatch):
    """The one that comes second keeps what the first has saved; if it was made from rows that changed, it fails."""
    root = str(tmp_path / "store")
    H.save_run({"evidence_rows": evidence_of(spark, "r1", "a")}, root)
    real, between = H.S._put, []

    def put(spark_, root_, number, content):
        if not between:
            between.append(number)
            H.save_run({"evidence_rows": evidence_of(spark, "r2", "b")}, root)
        return real(spark_, root_, number, content)

    with monkeypatch.context() as m:
        m.setattr(H.S, "_put", put)
        H.save_run({"evidence_rows": evidence_of(spark, "r3", "c")}, root)
    assert stored_items(spark, root) == [("r1", "a"), ("r2", "b"), ("r3", "c")] and H.S.last_number(spark, root) == 3

    schema = "run_id string, batch_index int, item_id string, artifact_type string, model_name string, model_version string, input_hash string, created_at string"
    artifact = lambda item: spark.createDataFrame([("r1", 1, item, "t", "m", "v", "h", "1")], schema)
    H.append_artifacts(artifact("i1"), root)
    real_commit = H.S.commit

    def commit(spark_, root_, changes, based_on=None):
        if based_on is not None and len(between) == 1:
            between.append(None)
            H.save_run({"model_artifacts": artifact("i2")}, root)
        return real_commit(spark_, root_, changes, based_on)

    with monkeypatch.context() as m:
        m.setattr(H.S, "commit", commit)
        with pytest.raises(H.S.Superseded):
            H.append_artifacts(artifact("i3"), root)
    assert [r.item_id for r in H.read_table(spark, root, "model_artifacts").collect()] == ["i2"]


def test_counts_kept_at_each_save(spark, tmp_path):
    """The counts of a manifest follow every save, and equal the rows; sketches come near the distinct items."""
    root = str(tmp_path / "store")
    schema = "run_id string, source_type string, source_name string, source_id string"
    items = lambda run, ids: spark.createDataFrame([(run, "review", "n", str(i)) for i in ids], schema)
    H.save_run({"raw_items": items("r1", range(3000)), "evidence_rows": evidence_of(spark, "r1", "abc")}, root)
    H.save_run({"raw_items": items("r2", range(2000, 5000)), "evidence_rows": evidence_of(spark, "r2", "d")}, root)
    H.save_run({"raw_items": items("r3", range(90_000, 90_010))}, root)
    H.save_run({"evidence_rows": evidence_of(spark, "r1", "ab")}, root)
    H.save_run({"evidence_rows": evidence_of(spark, "r2", "")}, root, run_ids=["r2"])
    for chain in (["r1"], ["r1", "r2"], ["r1", "r2", "r3", "gone"], []):
        got = {r.name: r.n for r in H.stored_counts(spark, root, chain).collect()}
        full = H.table_counts({n: H.read_table(spark, root, n) for n in ("raw_items", "evidence_rows")}, chain)
        assert got == {r.name: r.n for r in full.collect()}
        about = H.about_unique_items(spark, root, chain).first().n
        assert abs(about - got["unique_raw_items"]) <= 0.03 * got["unique_raw_items"]


def test_seen_keys_in_buckets(spark):
    """New items meet the stored keys in their buckets: the stored side is neither shuffled nor sent around."""
    schema = "source_name string, source_id string, text string"
    table = "seen_keys_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    try:
        seen = spark.range(500).selectExpr("concat('n', id % 3) as source_name", "cast(id as string) as source_id", "'x' as text")
        H.add_seen_keys(seen.where("int(source_id) < 300"), table, buckets=4)
        H.add_seen_keys(seen.where("int(source_id) >= 250").unionByName(spark.createDataFrame([(None, "a", "y"), ("n", None, "y")], schema)), table)
        rows = [("n0", "0", "old"), ("n1", "0", "new"), (None, "a", "old"), ("", "a", "old"), ("n", None, "old"), (None, None, "new"), ("n2", "299", "old"), ("n1", "499", "old"), ("n1", "502", "new")]
        new = spark.createDataFrame(rows, schema)
        kept = H.drop_seen_in(new, table)
        assert sorted(((r.source_name, r.source_id) for r in kept.collect()), key=repr) == sorted([r[:2] for r in rows if r[2] == "new"], key=repr)
        assert kept.columns == new.columns
        plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "Broadcast" not in plan
        again = H.drop_seen(new, spark.table(table))
        assert again.exceptAll(kept).isEmpty() and kept.exceptAll(again).isEmpty()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_deep_pages_skip_row_groups(spark, tmp_path):
    """A page deep down has the rows of offset paging, and bounds that leave out nearly all row groups."""
    root = str(tmp_path / "store")
    rows = spark.range(60_000).selectExpr(
        "concat('r', id % 3) as run_id", "cast(id as string) as item_id", "'pain' as category",
        "cast(hash(id) % 100 as int) as signal_relevance_score", "id as item_no", "cast(id % 7 as int) as category_ord",
    )
    spark.conf.set("parquet.block.size", "4096")
    try:
        H.save_run({"evidence_rows": rows.coalesce(2)}, root)
    finally:
        spark.conf.unset("parquet.block.size")
    for chain in (["r0"], ["r0", "r2"]):
        whole = H.read_table(spark, root, "evidence_rows", run_ids=chain)
        for offset in (0, 10, 7_000, 19_970, 10**6):
            page = H.stored_evidence_page(spark, root, chain, 50, offset).collect()
            assert page == H.evidence_page(whole, 50, offset).collect()
    assert H.stored_evidence_page(spark, root, [], 50, 0).count() == 0
    page = H.stored_evidence_page(spark, root, ["r0"], 50, 10_000)
    low, high = (page.agg(f("signal_relevance_score")).first()[0] for f in (F.min, F.max))
    groups = opened = 0
    for name in page.inputFiles():
        meta = pq.ParquetFile(name.removeprefix("file://")).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("signal_relevance_score")
        for g in range(meta.num_row_groups):
            own = meta.row_group(g).column(at).statistics
            groups += 1
            opened += own.max >= low and own.min <= high
    assert groups >= 40 and opened <= 0.1 * groups
    plan = page._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert pushed.count("(signal_relevance_score,") >= 1
