"""Text columns: HTML cleaning, excerpts, word counts.

Everything is a built-in expression except the decoding of uncommon HTML
entities, which an Arrow-batched function does for just those values.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# All characters a Unicode-aware "whitespace" class covers; Java's own \s is ASCII only.
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"

COMMENT = r"(?s)<!--.*?-->"
SCRIPT_ELEMENT = r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>"
# An opening, closing or declaration tag; quoted attribute values may hold ">".
TAG = r"""<[A-Za-z/!?][^"'<>]*(?:(?:"[^"]*"|'[^']*')[^"'<>]*)*>"""
LOOSE_TAG = r"<[A-Za-z/!?][^>]*>"
# Pieces of a page: comment | script or style element | tag | text run | stray "<".
PIECE = rf"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|{TAG}|{LOOSE_TAG}|[^<]+|<"
SCRIPT_OPEN = r"(?is)^<(?:script|style)\b[^>]*>"
SCRIPT_CLOSE = r"(?is)</(?:script|style)\s*>$"

COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ",
    "&amp;": "&",  # last, so that one pass never decodes its own output
}


@F.pandas_udf(StringType())
def _unescape_twice(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(html.unescape(v)), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_once(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _decode_common(col: Column) -> Column:
    for entity, char in COMMON_ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def decode_entities(col: Column, passes: int = 2) -> Column:
    """HTML entities decoded once or twice. Values whose entities are all common stay in the
    JVM; only the others reach the Python worker (as nulls otherwise)."""
    common = col
    for _ in range(passes):
        common = _decode_common(common)
    rare = common.rlike("&[#A-Za-z]")
    decode = _unescape_twice if passes == 2 else _unescape_once
    decoded = decode(F.when(F.contains(col, F.lit("&")) & rare, col))
    return F.when(~F.contains(col, F.lit("&")), col).otherwise(F.coalesce(decoded, common))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE, " "))


def strip_markup(col: Column, keep_scripts: bool = True) -> Column:
    """Tags and comments out, one space where each stood. Script and style bodies are text
    unless ``keep_scripts`` is false."""
    if keep_scripts:
        body = lambda p: F.regexp_replace(F.regexp_replace(p, SCRIPT_OPEN, ""), SCRIPT_CLOSE, "")
        pieces = F.regexp_extract_all(col, F.lit(PIECE), F.lit(0))
        with_scripts = F.array_join(
            F.transform(
                pieces,
                lambda p: F.when(p.rlike(SCRIPT_OPEN), body(p))
                .when(p.rlike(r"^<[A-Za-z/!?]"), F.lit(" "))
                .otherwise(p),
            ),
            " ",
        )
        plain = _strip_tags(col)
        stripped = F.when(col.rlike(r"(?i)<(?:script|style)\b"), with_scripts).otherwise(plain)
    else:
        stripped = _strip_tags(F.regexp_replace(col, SCRIPT_ELEMENT, " "))
    return F.when(F.contains(col, F.lit("<")), stripped).otherwise(col)


def _strip_tags(col: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(col, COMMENT, " "), TAG, " "), LOOSE_TAG, " "
    )


def clean_text(col: Column, keep_scripts: bool = True) -> Column:
    """Markup out, entities decoded twice, whitespace collapsed, trimmed; null becomes ''."""
    col = F.coalesce(col, F.lit(""))
    return collapse_spaces(decode_entities(strip_markup(col, keep_scripts), passes=2))


def clean_markup_simple(col: Column) -> Column:
    """The regex-only cleaner for question bodies: tags out, entities decoded once."""
    col = F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]+>", " ")
    return collapse_spaces(decode_entities(col, passes=1))


def excerpt(clean: Column, max_chars: int = 240) -> Column:
    """An already clean text cut to ``max_chars``, right-trimmed before the dots."""
    return F.when(F.length(clean) <= max_chars, clean).otherwise(
        F.concat(F.rtrim(F.substring(clean, 1, max_chars - 3)), F.lit("..."))
    )


def compact(col: Column, max_chars: int = 220) -> Column:
    """Whitespace collapsed and cut to ``max_chars`` without trimming before the dots."""
    cut = lambda text: F.concat(F.substring(text, 1, max_chars - 3), F.lit("..."))
    text, head = collapse_spaces(col), collapse_spaces(F.substring(col, 1, 4 * max_chars))
    # A head that is too long already tells how the whole begins, so a long text need not be searched to its end.
    return F.when(F.length(head) > max_chars, cut(head)).when(F.length(text) <= max_chars, text).otherwise(cut(text))


def word_count(clean: Column) -> Column:
    """Words of an already clean text: its single spaces plus one."""
    spaces = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean == "", 0).otherwise(spaces + 1)


def join_reasons(reasons: Column) -> Column:
    return F.array_join(reasons, "; ")
