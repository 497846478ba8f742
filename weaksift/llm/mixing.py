"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import ranked, stage, unused

WEIGHTS = (3, 1, 2)  # of the sources in order of their names, repeating
SHARE = 1.5  # the mix's size against that of all documents
MOST = 2  # copies of a source at most
SEED = 20  # of the sampling keys
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target: one row per source (null is one, and the last).

    The mix is shared out by weight. A target stops at ``most`` times its source's size and the rest is shared out
    again among the others, which is a common level per unit of weight: the level rises while some sources not yet full
    have caps below it, each time by what these leave over, and a round is one sum over the sources. Sources are
    numbered by a range-partitioned sort, so there may be any number of them.
    """
    by_source = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "by-source")
    whole = by_source.select("source", "source_size", F.lit(0).alias("_all"))
    ordered = ranked(whole, "_all", [F.asc_nulls_last("source")], "source_size", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    cap = (most * F.col("source_size")).alias("cap")
    sources = stage(ordered.select("source", "source_size", weight.alias("weight"), cap), "weighted")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= level * F.col("weight")
        row = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not row[2]:  # every source is full
            level = float("inf")
            break
        if row[0] <= full:
            break
        level, full = (total - (row[1] or 0)) / row[2], row[0]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words) and quality (share of letters in what is not white space; 0 without text)."""
    text = F.coalesce("text", F.lit(""))
    marks = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    quality = F.when(marks > 0, letters / marks).otherwise(0.0)
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), quality.alias("quality"), *more)


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``sizes`` (doc_id, source, size, quality, ...; a stage) with source_size, target and taken.

    A source's target is met by as many whole passes over it as fit, then by documents in the order of exponential
    keys scaled by quality (the smaller the quality the larger the key), until the words of the documents ahead fill
    the rest; the last document gives only its first words. taken counts words, so that a source's sum is its target
    rounded down. Ties go to the smaller id, null last; a rerun gives the same mix, as keys come from the ids.
    No document exceeds ``most`` times its size. Documents without words take part with nothing.
    """
    low = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))
    even = (F.shiftrightunsigned(low, 11).cast("double") + 0.5) / float(1 << 53)
    keyed = sizes.withColumn("_key", -F.log(even) / (F.lit(0.05) + F.coalesce("quality", F.lit(0.0))))
    order = [F.asc("_key"), F.asc_nulls_last("doc_id"), F.asc("size")]
    targets = stage(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "_source")
    placed = ranked(keyed, "source", order, "size", "mixed")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_passes", passes)
        .withColumn("taken", F.col("_passes") * F.col("size") + extra)
        .drop("_key", "_rank", "_before", "_passes", "_source", "weight")
    )


def mixing_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row. A null source is a source of its own, a null text has
    no words, repeated rows are rows, an empty table gives an empty result; other columns are ignored."""
    return mix(stage(sized(docs), "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The mix as documents: whole copies as repeated rows, and the last document of a source cut after the words
    taken of it. n_chars follows the text."""
    row, size, taken, words = (unused(docs, name) for name in ("_row", "_size", "_taken", "_words"))
    whole = stage(docs.select(F.monotonically_increasing_id().alias(row), "*"), "to-mix")
    sizes = sized(whole.select(F.col(row).alias("_row"), "doc_id", "source", "text"), "_row")
    mixed = mix(stage(sizes, "sizes")).where("taken > 0")
    rows = whole.join(mixed.select(F.col("_row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken)), row)
    copies = F.floor(F.col(taken) / F.col(size)).cast("int")
    part = (F.col(taken) % F.col(size)).cast("int")
    lengths = F.concat(F.array_repeat(F.lit(0), copies), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = rows.withColumn(words, F.explode(lengths))
    ends = F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    uncut = F.col(words) == 0
    out = out.withColumn("text", F.when(uncut, F.col("text")).otherwise(F.concat_ws("", F.slice(ends, 1, F.col(words)))))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(uncut, F.col("n_chars")).otherwise(length))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
