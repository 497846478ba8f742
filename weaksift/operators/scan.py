"""One pass over an item's text that finds every lexicon term in it.

The rules later read small arrays instead of the text:

``found_text``    terms in the text alone
``found_all``     terms in title + text
``found_words``   terms in title + text under the word rule
``found_excerpt`` terms in title + 240-character excerpt under the word rule
``found_excerpt_plain`` the same as plain substrings
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.functions import matching as M
from weaksift.functions import text as T
from weaksift.lexicons import DOMAIN, all_terms

LINK = "https?://|www\\."

SCAN_COLUMNS = [
    "found_text", "found_all", "found_words", "found_excerpt", "found_excerpt_plain", "link_count",
    "word_count", "has_sentence_mark", "opening",
]


def clean_items(raw: DataFrame) -> DataFrame:
    """Adds ``clean_text`` and replaces ``title`` by its clean form."""
    return raw.withColumns(
        {
            "clean_text": T.clean_text(F.col("text")),
            "title": T.clean_text(F.col("title")),
        }
    )


def scan_items(items: DataFrame, lexicon: dict[str, list[str]] = DOMAIN, builtin: bool = False) -> DataFrame:
    """``items`` has ``title`` and ``clean_text``. The long text is searched once: a term of
    title + text that is not in the text alone must touch the title, so it lies within the
    title and as many characters of text as the longest term has.

    The search for all terms at once is an automaton run in Arrow batches: one step per
    character, where built-in functions need one pass per term. ``builtin`` picks those
    instead (same result, without the automaton library).
    """
    terms = all_terms(lexicon)
    reach = max((len(term) for term in terms), default=1)
    texts = (
        items.withColumn("_text", F.concat(F.lit(" "), F.lower("clean_text"), F.lit(" ")))
        .withColumns(
            {
                "_head": F.concat(F.lit(" "), F.lower("title"), F.substring("_text", 1, reach)),
                "_title": F.concat(F.lit(" "), F.lower("title"), F.lit(" ")),
                "_short": F.lower(
                    F.concat(F.lit(" "), "title", F.lit(" "), T.excerpt(F.col("clean_text")), F.lit(" "))
                ),
            }
        )
    )
    find = _find_builtin if builtin else _find_by_automaton
    found = find(texts, terms).withColumns(
        {
            "link_count": F.size(F.regexp_extract_all(F.col("_text"), F.lit(LINK), F.lit(0))),
            "word_count": T.word_count(F.col("clean_text")),
            "has_sentence_mark": F.col("clean_text").rlike("[.?!]"),
            "opening": F.substring("_text", 2, reach),
        }
    )
    return found.select(*items.columns, *SCAN_COLUMNS)


def _find_by_automaton(texts: DataFrame, terms: list[str]) -> DataFrame:
    scan = M.term_finder(terms)
    return texts.withColumn("_found", scan("_text", "_title", "_head", "_short")).select(
        "*", *[F.col(f"_found.{name}").alias(name) for name in M.FOUND_FIELDS]
    )


def _find_builtin(texts: DataFrame, terms: list[str]) -> DataFrame:
    words = M.words_of(terms)
    found = texts.withColumns(
        {
            "found_text": M.substring_hits(F.col("_text"), terms),
            "_found_head": M.substring_hits(F.col("_head"), terms),
            "found_excerpt_plain": M.substring_hits(F.col("_short"), terms),
        }
    ).withColumn("found_all", F.array_union("found_text", "_found_head"))
    return found.withColumns(
        {
            "found_words": M.found_by_word_rule(
                _words_in(("_text", "_title"), "found_all", words), F.col("found_all")
            ),
            "found_excerpt": M.found_by_word_rule(
                _words_in(("_short",), "found_excerpt_plain", words), F.col("found_excerpt_plain")
            ),
        }
    )


def _words_in(columns: tuple[str, ...], found: str, words: list[str]) -> Column:
    """Whole words of the columns. Tokenising is skipped where no word occurs even as a
    substring."""
    tokens = F.concat(*[F.split(name, M.NON_WORD) for name in columns])
    return F.when(
        M.any_found(F.col(found), words), F.array_intersect(tokens, M.literal_array(words))
    ).otherwise(F.array().cast("array<string>"))
