from __future__ import annotations

from pyspark.sql import functions as F

from weaksift import lexicons as X
from weaksift.functions import matching as M
from weaksift.operators import scan as S
from weaksift.plans.seeded import seeded_items

WORDS = {
    "customer": ["the customer said", True],
    "ai": ["maintain it", False],
    "api": ["an éapi call", False],
    "crm": ["crm_x field", False],
}


def test_word_rule_needs_whole_words(spark):
    rows = spark.createDataFrame([(w, t, e) for w, (t, e) in WORDS.items()], "w string, t string, e boolean")
    automaton = M.text_finder(list(WORDS))
    found = rows.select(
        "w", "e",
        F.array_contains(automaton("t")["words"], F.col("w")).alias("by_automaton"),
        F.array_contains(M.word_hits(F.col("t"), list(WORDS)), F.col("w")).alias("builtin"),
    ).collect()
    for row in found:
        assert row.by_automaton == row.e and row.builtin == row.e, row


def test_plural_is_another_word_and_phrases_are_substrings(spark):
    rows = spark.createDataFrame([("all customers, small businesses",)], "t string")
    terms = ["customer", "customers", "small business", "all"]
    found = rows.select(M.text_finder(terms)("t").alias("f")).first().f
    assert found.substrings == terms
    assert found.words == ["customers", "small business", "all"]


def test_pick_keeps_list_order_and_duplicates(spark):
    joined = X.BUSINESS_SCOPE + X.WORKFLOW_FRICTION
    rows = spark.createDataFrame([(["operations", "follow-up"],)], "found array<string>")
    hits = rows.select(M.pick(F.col("found"), joined).alias("h")).first().h
    assert hits == ["operations", "follow-up", "follow-up", "operations"]


def test_literal_array_quotes(spark):
    terms = ["doesn't work", 'say "x"', "back\\slash", "i "]
    assert spark.range(1).select(M.literal_array(terms).alias("a")).first().a == terms


def test_automaton_equals_builtin_functions(spark, sf_dir):
    items = S.clean_items(seeded_items(spark, sf_dir))
    columns = [F.array_sort(c).alias(c) if c.startswith("found") else F.col(c) for c in S.SCAN_COLUMNS]
    fast = S.scan_items(items).select("source_index", *columns)
    plain = S.scan_items(items, builtin=True).select("source_index", *columns)
    assert fast.exceptAll(plain).isEmpty() and plain.exceptAll(fast).isEmpty()


def test_terms_across_title_and_text(spark):
    rows = spark.createDataFrame([("We are a small", "team of two"), ("", "x small team")], "title string, clean_text string")
    for builtin in (False, True):
        first, second = S.scan_items(rows, builtin=builtin).orderBy("title").collect()[::-1]
        assert "small team" in first.found_all and "small team" not in first.found_text
        assert "small team" in second.found_text


def test_lexicon_table_round_trip(spark):
    table = X.to_table(spark, X.DOMAIN)
    back = X.from_table(table, "domain")
    assert {k: list(v) for k, v in X.DOMAIN.items()} == back
