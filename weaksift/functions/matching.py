"""Lexicon matching.

Two matchers exist side by side: plain substrings, and words (terms of only
``[a-z0-9]`` must equal a whole run of word characters, others are substrings).
A text is scanned once for every term of a lexicon; the lists the scoring rules
ask for are then picked from that small array of found terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weaksift.lexicons import is_plain_word

NON_WORD = r"[^\p{L}\p{N}_]+"


def literal_array(values: list[str]) -> Column:
    quoted = ["'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" for value in values]
    return F.expr(f"array({', '.join(quoted)})") if quoted else F.array().cast("array<string>")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value bound to a variable, so that an expression in its place, however often it is
    used, is computed once per row."""
    return F.transform(F.array(value), use)[0]


def substring_hits(text: Column, terms: list[str]) -> Column:
    """Terms contained in ``text``, in list order."""
    return once(text, lambda own: F.filter(literal_array(terms), lambda term: F.contains(own, term)))


def word_hits(text: Column, words: list[str]) -> Column:
    """Distinct words of ``text`` that are in ``words`` (hash lookup, one pass over the text)."""
    return F.array_intersect(F.split(text, NON_WORD), literal_array(words))


def hits_by_word_rule(text: Column, terms: list[str]) -> Column:
    """Found terms under the word rule with built-in functions alone: the better choice for words, which
    take one pass over the text together; phrases take one each."""
    phrases = [term for term in terms if not is_plain_word(term)]
    return F.concat(word_hits(text, words_of(terms)), substring_hits(text, phrases))


def pick(found: Column, terms: list[str]) -> Column:
    """The sub-list of ``terms`` that was found; order and duplicates of ``terms`` are kept."""
    return once(found, lambda own: F.filter(literal_array(terms), lambda term: F.array_contains(own, term)))


def any_found(found: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(found, literal_array(terms))


def count_of(hits: Column) -> Column:
    return F.size(hits)


def reason(code: str, hits: Column, first: int) -> Column:
    """``code:hit, hit`` with the first few hits."""
    return F.concat(F.lit(f"{code}:"), F.array_join(F.slice(hits, 1, first), ", "))


def found_by_word_rule(words_found: Column, substrings_found: Column) -> Column:
    """Found terms under the word rule: whole words plus phrases met as substrings."""
    phrases = F.filter(substrings_found, lambda term: ~term.rlike("^[a-z0-9]+$"))
    return F.concat(words_found, phrases)


def words_of(terms: list[str]) -> list[str]:
    return [term for term in terms if is_plain_word(term)]


FOUND_FIELDS = ["found_text", "found_all", "found_words", "found_excerpt", "found_excerpt_plain"]


def term_finder(terms: list[str]):
    """Arrow function over (text, title, head, short) that returns every term found in each, for
    all terms in one pass. Found terms come in list order."""
    matcher = _matcher(terms)
    phrase = [not is_plain_word(term) for term in terms]

    @F.pandas_udf(", ".join(f"{name} array<string>" for name in FOUND_FIELDS))
    def find(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.DataFrame]:
        matches = matcher()

        def named(numbers: set[int]) -> list[str]:
            return [terms[number] for number in sorted(numbers)]

        def phrases(numbers: set[int]) -> set[int]:
            return {number for number in numbers if phrase[number]}

        for text, title, head, short in batches:
            rows = []
            for a, b, c, d in zip(text, title, head, short):
                in_text, text_words = matches(a)
                in_short, short_words = matches(d)
                in_all = in_text | matches(c)[0]
                rows.append(
                    (
                        named(in_text),
                        named(in_all),
                        named(text_words | matches(b)[1] | phrases(in_all)),
                        named(short_words | phrases(in_short)),
                        named(in_short),
                    )
                )
            yield pd.DataFrame(rows, columns=FOUND_FIELDS)

    return find


def text_finder(terms: list[str]):
    """Arrow function over one lower-cased text: its terms as substrings and by the word rule."""
    matcher = _matcher(terms)
    phrase = [not is_plain_word(term) for term in terms]

    @F.pandas_udf("substrings array<string>, words array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matches = matcher()
        for texts in batches:
            rows = []
            for text in texts:
                anywhere, whole = matches(text or "")
                by_rule = whole | {number for number in anywhere if phrase[number]}
                rows.append(([terms[n] for n in sorted(anywhere)], [terms[n] for n in sorted(by_rule)]))
            yield pd.DataFrame(rows, columns=["substrings", "words"])

    return find


def _matcher(terms: list[str]):
    """A factory, called once per task, of ``text -> (terms anywhere, terms as whole words)``."""
    words = [is_plain_word(term) for term in terms]

    def build():
        import ahocorasick  # in requirements.txt; every worker needs it

        automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            automaton.add_word(term, (number, len(term), words[number]))
        automaton.make_automaton()

        def matches(text: str) -> tuple[set[int], set[int]]:
            anywhere, whole = set(), set()
            for end, (number, length, is_word) in automaton.iter(text):
                anywhere.add(number)
                if is_word and number not in whole:
                    start = end - length + 1
                    before, after = text[max(start - 1, 0) : start], text[end + 1 : end + 2]
                    if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                        whole.add(number)
            return anywhere, whole

        return matches

    return build
