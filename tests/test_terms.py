"""Tokens, vectors and leading terms told in Arrow batches, against the built-in functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weaksift.functions import text as T
from weaksift.operators import vectors as V

KEYS = ["threshold", "cluster_id"]
TEXTS = [
    "", "a", "Alpha beta-2 ALPHA", "-abc 1-2x-y --- ----a-b 12 ab3", "über straße naïve-té the and", "x" * 300 + "-", "abc", "def",
    "\U0001f600tok\U0001f600en éabcé 9a9 a-- z99", None, "tab\tnew\nline abc def", "-" * 50 + "q", "İstanbul KELVIN",
]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tokens_and_vectors_by_bytes_equal_the_built_in_ones(spark, small_batches):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abz09- ,é\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    none = F.array().cast("array<string>")
    items = spark.createDataFrame([(t,) for t in texts], "clean_text string").select(
        "clean_text", F.lit("The title").alias("title"), none.alias("relevance_reasons"), none.alias("quality_reasons")
    )
    built_in = V._unit_counts(V.token_slots(V.tokens()), F.lit(V.DIMENSIONS))
    both = V.hashed_vectors(items).select(V.tokens().alias("a"), V.token_lists().alias("b"), "vector", built_in.alias("v"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("vector").eqNullSafe(F.col("v"))).count() == 0
    assert both.count() == len(texts)


@pytest.mark.parametrize("together", [1, 3, 1_000])
def test_terms_of_groups_equal_those_of_all_rows(spark, small_batches, together):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        g = rng.choice([0, 0, 0, 0, 1, 2, *range(4, 60)])
        words = [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([0.5, 0.8]) if g < 4 else 0.5, f"c{g}", None if i % 50 == 0 else str(i % 200), words if i % 17 else None))
    frame = spark.createDataFrame(rows, "threshold double, cluster_id string, item_id string, tokens array<string>")
    sized = frame.join(frame.groupBy(*KEYS).agg(F.count("*").alias("size")), KEYS)
    listed = lambda found: {(r[0], r[1]): r["top_terms"] for r in found.collect()}
    assert listed(V.top_terms_of_groups(sized, KEYS, "size", "item_id", together=together)) == listed(V.top_terms(frame, KEYS))


def test_a_group_that_is_whole_sends_its_leading_terms_alone(spark, monkeypatch):
    """What leaves the tasks that count grows with the groups and not with the terms."""
    rows = [("c", str(i), [f"w{i}-{k}" for k in range(200)]) for i in range(20)] + [(f"s{i}", "1", ["aaa"] * 3) for i in range(30)]
    frame = spark.createDataFrame(rows, "cluster_id string, item_id string, tokens array<string>")
    sized = frame.join(frame.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    sent = []
    leading = V._leading
    monkeypatch.setattr(V, "_leading", lambda counts, *more: sent.append(counts.count()) or leading(counts, *more))
    V.top_terms_of_groups(sized, ["cluster_id"], "size", "item_id").collect()
    assert sent == [V.TOP_TERMS + 30]


def test_compact_of_the_head_equals_that_of_the_whole(spark):
    rng = random.Random(5)
    texts = [None, "", " " * 100, " " * 100 + "ab", "ab cd" + " " * 100 + "ef", "a" * 20, "a" * 21, "a" * 20 + " ", " a" * 60, "\u00a0b \u2003c" * 30]
    texts += ["".join(rng.choice("ab \t\u00a0\U0001f600") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.compact(F.col("t"), 20).alias("c"), T.collapse_spaces(F.col("t")).alias("s"))
    for row in rows.collect():
        assert row.c == (row.s if row.s is None or len(row.s) <= 20 else row.s[:17] + "...")
