from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weaksift.functions import text as T


def apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


CLEAN = [
    ("<p>one&nbsp;two &amp; three</p><p>four</p>", "one two & three four"),
    (None, ""),
    ("", ""),
    ("AT&T", "AT&T"),  # a bare ampersand at the end loses nothing
    ("plain R&D text", "plain R&D text"),
    ("a < b and c > d", "a < b and c > d"),
    ("<b>fo</b>o", "fo o"),
    ("x<!-- <p>hidden</p> -->y", "x y"),
    ("x<style>p{}</style>y", "x p{} y"),
    ('<script>var t="</p>";go(1)</script>end', 'var t="</p>";go(1) end'),
    ('<a title="x > y">link</a>', "link"),
    ("<p>it's</p>", "it's"),
    ("non break  and wide\tspace\n", "non break and wide space"),
    ("&amp;lt;tag&amp;gt;", "<tag>"),
    ("caf&eacute; &#8364;5 &middot; &copy;", "café €5 · ©"),
]


@pytest.mark.parametrize("raw, expected", CLEAN)
def test_clean_text(spark, raw, expected):
    assert apply(spark, [raw], T.clean_text) == [expected]


def test_clean_text_can_drop_scripts(spark):
    drop = lambda c: T.clean_text(c, keep_scripts=False)
    assert apply(spark, ["x<style>p{}</style>y<script>z()</script>"], drop) == ["x y"]


def test_simple_cleaner_decodes_once(spark):
    assert apply(spark, ["<p>a &amp;lt; b</p>\n c"], T.clean_markup_simple) == ["a &lt; b c"]


def test_excerpt_trims_before_the_dots_and_compact_does_not(spark):
    text = "abcde fghij klmno"
    assert apply(spark, [text], lambda c: T.excerpt(c, 9)) == ["abcde..."]
    assert apply(spark, [text], lambda c: T.compact(c, 9)) == ["abcde ..."]
    assert apply(spark, [text], lambda c: T.excerpt(c, 17)) == [text]


def test_word_count(spark):
    assert apply(spark, ["", "one", "one two three"], T.word_count) == [0, 1, 3]
