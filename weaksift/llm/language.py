"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.llm.common import unused

TOP = 300  # n-grams of a profile
PIECE = 1 << 20  # code points looked at together
MERGE = 1 << 21  # n-grams gathered before equal ones are merged
LANGUAGES = 1_000  # that can be learned
UNKNOWN = "und"

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 to 3 code points of a word with its two blanks, packed into 21 bits each) and their counts."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = np.where(_letters()[np.minimum(raw, 0x10FFFF)], raw, 32).astype(np.uint64)
    word = np.concatenate(([np.uint64(32)], word, [np.uint64(32)]))
    word = word[np.concatenate(([True], (word[1:] != 32) | (word[:-1] != 32)))]
    found: tuple[list, list] = ([], [])
    for lo in range(0, len(word), PIECE):
        a = word[lo : lo + PIECE + 2]
        own = min(PIECE, len(word) - lo)
        inner = a != 32
        one = a[:own][inner[:own]]
        two = ((a[:-1] << np.uint64(21)) | a[1:])[:own]
        three = ((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:])[:own][inner[1:-1][:own]]
        codes, counts = np.unique(np.concatenate((one, two, three)), return_counts=True)
        found[0].append(codes)
        found[1].append(counts)
    return (found[0][0], found[1][0]) if len(found[0]) == 1 else _merge(*found)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams by language, summed over the task."""
    sums: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            codes, counts = grams(text)
            own = sums[lang]
            own[0].append(codes)
            own[1].append(counts)
            if sum(map(len, own[0][1:])) > MERGE:
                merged = _merge(*own)
                sums[lang] = ([merged[0]], [merged[1]])
    for lang, own in sums.items():
        codes, counts = _merge(*own)
        yield pd.DataFrame({"lang": lang, "gram": codes.astype(np.int64), "n": counts})


def profiles(labelled: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, place): the ``top`` most frequent n-grams of each language of all labelled texts, ties to the
    smaller n-gram. Its size is bounded by languages times ``top``."""
    texts = labelled.select(F.col("text"), F.col("lang")).where("text is not null and lang is not null")
    counts = texts.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("lang", "gram", "place")


class Ranks:
    """The profiles by n-gram: for each, the languages that have it and its place in their profiles."""

    def __init__(self, rows: pd.DataFrame, top: int):
        self.top = top
        self.langs = sorted(rows["lang"].unique())
        rows = rows.sort_values(["gram", "lang"])
        grams_ = rows["gram"].to_numpy(np.int64).astype(np.uint64)
        self.codes, self.first = np.unique(grams_, return_index=True)
        self.first = np.append(self.first, len(rows))
        self.lang = np.searchsorted(np.array(self.langs, dtype=object), rows["lang"].to_numpy(object)).astype(np.int64)
        self.place = rows["place"].to_numpy(np.int64) - 1

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of n-grams in rank order to each language: ``top`` for what a profile lacks."""
        at = np.searchsorted(self.codes, own)
        known = np.flatnonzero(at < len(self.codes))
        known = known[self.codes[at[known]] == own[known]]
        first, n = self.first[at[known]], self.first[at[known] + 1] - self.first[at[known]]
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        saved = self.top - np.abs(self.place[entry] - np.repeat(known, n))
        return self.top * len(own) - np.bincount(self.lang[entry], weights=saved, minlength=len(self.langs)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(self.langs) or not (codes != 32).any() or not ((codes < (1 << 21)).any()):
            return UNKNOWN, 0.0
        own = codes[np.lexsort((codes, -counts))[: self.top]]
        apart = self.distances(own)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.top * len(own))


def learned(profile: DataFrame, top: int = TOP, most: int = LANGUAGES) -> Ranks:
    """The profiles, gathered for every task: ``most`` languages of ``top`` n-grams at most. More are an error, as a column
    of something else than languages would be."""
    rows = profile.limit(most * top + 1).toPandas()
    if len(rows) > most * top:
        raise ValueError(f"more than {most} languages to learn")
    return Ranks(rows, top)


def identify(docs: DataFrame, ranks: DataFrame, top: int = TOP) -> DataFrame:
    """``docs`` with lang_pred and score, by the smallest out-of-place distance.

    A document's most frequent n-grams are ranked and each is compared with its rank in a language's profile; an
    n-gram that the profile lacks counts ``top`` places. score is 1 less the distance's share of the largest possible
    one. Null texts and texts without a letter give ``und`` and 0, also when nothing was learned; ties go to the
    smaller language name. Only the text is looked at. The profiles (languages times ``top`` rows) go to every task.
    """
    known = learned(ranks, top)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [known.predict(t) for t in frame["_text"]]
            frame = frame.drop(columns="_text")
            frame["lang_pred"] = [s[0] for s in said]
            frame["score"] = [s[1] for s in said]
            yield frame

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    schema = f"{fields}, lang_pred string, score double"
    return docs.mapInPandas(work, schema)


def held_out() -> Column:
    """Whether a document is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, top: int = TOP) -> DataFrame:
    return profiles(docs.where(~held_out() & F.col("lang").isNotNull()), top)


def language_query(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; null ids, texts and languages, repeated rows and an empty
    table are all allowed, and other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), held_out().alias("held_out"), F.col("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType
    said = identify(rows, learn(docs, top), top)
    return said.select(F.col("_id").cast(kind).alias("doc_id"), "held_out", "lang_pred", "score")


def language_stage(docs: DataFrame, top: int = TOP, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The documents in one of ``languages`` (None: all learned ones) by their text, with what was found as their lang;
    the others go, as do those without a letter. Rows keep all their columns; without a learned language nothing stays."""
    ranks = learned(learn(docs, top), top)

    @F.pandas_udf("string")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series([ranks.predict(t)[0] for t in texts], dtype=object)

    said = unused(docs, "_said")
    predict = predict.asNondeterministic()  # so that the plan does not ask twice
    known = docs.withColumn(said, predict(F.col("text"))).where(F.col(said) != UNKNOWN)
    if languages is not None:
        known = known.where(F.col(said).isin(list(languages)))
    return known.select(*[F.col(said).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
