"""Near-duplicate detection by SetSketch registers, joint estimation and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import numbered, stage, unused
from weaksift.llm.graph import components

SHINGLE = 2  # words, by the query's contract
STAGE_SHINGLE = 5  # words, in a pipeline
PERCENT = 80  # least similarity, by the contract
BANDS, ROWS = 32, 4  # two sets of similarity 0.8 share no band with a chance of 5e-8
BASE = 1.001  # of the registers' scale
LIMIT = (1 << 16) - 1  # of a register
EVIDENCE = 16.0  # how much less likely (in log units) the threshold may be than the best estimate: refuses 1e-8 of pairs at it
CHUNK, MINOR = 1 << 21, 1 << 19  # shingles of a bucket that meet in one go: of all, and outside the largest component
WORDS = 1 << 20  # word hashes a worker remembers at most

_random = np.random.default_rng(20)
FACTOR = (_random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFT = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_words: dict[bytes, int] = {}


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles, words in lower-case A-Z; with fewer words, of them all."""
    global _words
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORDS:
        _words = {}
    for word in set(words).difference(_words):
        _words[word] = xxhash.xxh3_64_intdigest(word)
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ hashed[k : len(hashed) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: for each hash function, the least of the elements' exponential values, on a scale of powers
    of ``BASE``, truncated. The register of a union is the larger of the two."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTOR), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 2048):
        least = np.minimum(least, (FACTOR[:, None] * h[None, lo : lo + 2048] + SHIFT[:, None]).min(axis=1))
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def likely(equal: np.ndarray, more: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether a similarity of the threshold or more is likely enough, by the joint likelihood of the registers that
    are equal, larger in the first and larger in the second, given the two sizes."""
    similarity = np.linspace(0.005, 1.0, 200)[None, :]
    n, m = n[:, None].astype(float), m[:, None].astype(float)
    shared = similarity * (n + m) / (1 + similarity)
    possible = shared <= np.minimum(n, m) * (1 + 1e-9)
    total = n + m - shared
    less = len(FACTOR) - equal - more
    tiny = 1e-4
    score = (
        equal[:, None] * np.log(np.maximum(similarity, tiny))
        + more[:, None] * np.log(np.maximum((n - shared) / total, tiny))
        + less[:, None] * np.log(np.maximum((m - shared) / total, tiny))
    )
    score = np.where(possible, score, -np.inf)
    high = np.where(similarity >= PERCENT / 100 - 1e-9, score, -np.inf).max(axis=1)
    return high >= score.max(axis=1) - EVIDENCE


def _sketch(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sketch = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), width)
                n.append(len(own))
                key.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sketch.append(registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())],
                names=["_row", "n_shingles", "key", "sketch"],
            )

    return work


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            packed = np.ascontiguousarray(m).view(np.int64).reshape(-1)
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(band), pa.array(packed)], names=["id", "band", "h"])


def _compare(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs of sketches (rows of both) that may be similar enough."""
    return likely((left == right).sum(axis=1), (left > right).sum(axis=1), n, m)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, len(FACTOR)) for c in (4, 5))
            good = _compare(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles a set shares with each of some others."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat(own[at] == every, np.concatenate(([0], np.cumsum([len(o) for o in others])[:-1])))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members outside the largest component of a bucket against a chunk of all its members (rows come sorted by bucket
    and chunk). Pairs of one component are settled, a pair is looked at in the first band it shares only, and one link
    to a component is enough; what the registers allow is verified on the full sets, the likeliest first."""
    held: list[tuple] = []
    key = None

    def compare() -> Iterator[pa.RecordBatch]:
        minor, ids, comp, n = (np.concatenate([h[i] for h in held]) for i in range(4))
        sketch = np.concatenate([h[4] for h in held])
        sets = [v for h in held for v in h[5]]
        held.clear()
        a, b = np.flatnonzero(minor), np.flatnonzero(~minor)
        found: list[tuple[int, int]] = []
        for i in a.tolist():
            j = b[(comp[b] != comp[i]) & (100 * np.minimum(n[i], n[b]) >= PERCENT * np.maximum(n[i], n[b]))]
            equal = (sketch[j] == sketch[i]).sum(axis=1)
            maybe = equal >= 0.55 * len(FACTOR)  # beyond six deviations
            j, equal = j[maybe], equal[maybe]
            if not len(j):
                continue
            bands = (sketch[j].reshape(-1, BANDS, ROWS) == sketch[i].reshape(BANDS, ROWS)).all(axis=2)
            own = bands.argmax(axis=1) == key[0]
            j, equal = j[own], equal[own]
            good = likely(equal, (sketch[i] > sketch[j]).sum(axis=1), np.full(len(j), n[i]), n[j]) if len(j) else own[:0]
            j = j[good][np.argsort(-equal[good], kind="stable")]
            mine = np.frombuffer(sets[i], np.uint64)
            linked: set[int] = set()
            for lo in range(0, len(j), 128):
                some = [k for k in j[lo : lo + 128].tolist() if comp[k] not in linked]
                if some:
                    both = _overlaps(mine, [np.frombuffer(sets[k], np.uint64) for k in some])
                    for k in np.array(some)[100 * both >= PERCENT * (n[i] + n[some] - both)].tolist():
                        if comp[k] not in linked:
                            linked.add(int(comp[k]))
                            found.append((int(ids[i]), int(ids[k])))
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        sketch = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint16).reshape(-1, len(FACTOR))
        sets = batch.column(9).to_pylist()
        cols = [batch.column(4).to_numpy(zero_copy_only=False), *[batch.column(i).to_numpy() for i in (5, 6, 7)], sketch, sets]
        for lo, hi in zip(cut, [*cut[1:], batch.num_rows]):
            if held and tuple(keys[lo]) != key:
                yield from compare()
            key = tuple(keys[lo])
            held.append(tuple(c[lo:hi] for c in cols))
    if held:
        yield from compare()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _sets(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return work


def _full_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """id, shingles of the ``wanted`` classes. Only their texts are read again."""
    rows = classes.join(wanted.distinct(), "id").select("id", "_row")
    return stage(texts.join(rows, "_row").select("id", "text").mapInArrow(_sets(width), "id long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs of classes whose full sets are similar enough."""
    sets = _full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), classes, texts, width)
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stage(full.mapInArrow(_verify, "a long, b long"), "links")


def _side(classes: DataFrame, id_name: str, suffix: str) -> DataFrame:
    return classes.select(F.col("id").alias(id_name), F.col("n_shingles").alias("n" + suffix), F.col("sketch").alias("s" + suffix))


def near_rows(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """_row, doc_id, n_shingles, component_id, first_row for ``texts`` (_row, doc_id, text; a stage).

    Rows with equal shingle sets are one class. Classes that agree in a band of registers are a bucket; each member is
    paired with one center of its bucket (another one in each band), kept if the registers' joint likelihood allows the
    threshold, and verified on full sets. Components of the verified links settle most pairs of a bucket; members
    outside the bucket's largest component are then compared with all its members, block by block, and what the
    registers allow is verified too. first_row is the first of a component's rows with its smallest id. So no pair that shares a band is left out, and no bucket is listed pair by pair.
    """
    rows = stage(texts.select("_row", "text").mapInArrow(_sketch(width), "_row long, n_shingles long, key binary, sketch binary"), "sketches")
    one = F.min(F.col("_row")).alias("_row")
    first = rows.where("n_shingles > 0").groupBy("key").agg(one)
    classes = rows.join(first, ["_row", "key"]).select(F.monotonically_increasing_id().alias("id"), "_row", "key", "n_shingles", "sketch")
    classes = stage(classes, "classes")
    bands = stage(classes.select("id", "sketch").mapInArrow(_bands, "id long, band int, h long"), "bands")
    order = F.struct(F.xxhash64("id", "band"), "id")
    buckets = bands.groupBy("band", "h").agg(F.count("*").alias("size"), F.min(order).alias("o")).where("size > 1")
    buckets = stage(buckets.select("band", "h", "size", F.col("o.id").alias("center")), "buckets")
    shared = stage(bands.join(buckets, ["band", "h"]), "shared")
    pairs = shared.where("id <> center").select(F.greatest("id", "center").alias("a"), F.least("id", "center").alias("b")).distinct()
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    sides = pairs.join(_side(classes, "a", "a"), "a").join(_side(classes, "b", "b"), "b").where(close)
    pairs = sides.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_may_link, "a long, b long")
    links = _confirmed(stage(pairs, "pairs"), classes, texts, width)
    found = stage(components(links), "components")

    member = shared.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = stage(member.where("size > 2"), "members")  # two have met already
    member = stage(member.join(classes.select("id", "n_shingles"), "id"), "sized-members")
    counts = member.groupBy("band", "h", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"))
    top = F.max(F.struct("n", "component", "all")).alias("t")
    major = counts.groupBy("band", "h").agg(F.count("*").alias("parts"), F.sum("all").alias("all"), top).where("parts > 1")
    chunks = F.floor(F.col("all") / CHUNK).cast("int").alias("chunks")
    minors = F.floor((F.col("all") - F.col("t.all")) / MINOR).cast("int").alias("minors")
    major = stage(major.select("band", "h", F.col("t.component").alias("major"), chunks, minors), "open-buckets")
    open_ = stage(member.join(major, ["band", "h"]), "open-members")
    facts = classes.select("id", "sketch").join(_full_sets(open_.select("id"), classes, texts, width), "id")
    open_ = open_.join(facts, "id")
    own = F.xxhash64("id", F.lit(1))
    columns = ["band", "h", "chunk", "block", "minor", "id", "component", "n_shingles", "sketch", "shingles"]
    all_ = open_.select(
        "*", F.pmod(own, F.col("chunks") + 1).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), "minors")).alias("block"), F.lit(False).alias("minor")
    )
    few = open_.where("component <> major").select(
        "*", F.explode(F.sequence(F.lit(0), "chunks")).alias("chunk"), F.pmod(own, F.col("minors") + 1).cast("int").alias("block"), F.lit(True).alias("minor")
    )
    keys = ["band", "h", "chunk", "block"]
    met = all_.select(*columns).unionByName(few.select(*columns)).repartition(*keys).sortWithinPartitions(*keys)
    links = links.unionByName(stage(met.mapInArrow(_meet, "a long, b long").distinct(), "more-links"))
    found = stage(components(links), "components")

    ids = texts.select("_row", "doc_id")
    by_class = classes.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    placed = stage(rows.select("_row", "n_shingles", "key").join(by_class, "key", "left").join(ids, "_row"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    group = placed.where("component is not null").groupBy("component").agg(first, F.count("*").alias("rows")).where("rows > 1")
    group = stage(group.select("component", F.col("first.doc_id").alias("component_id"), F.col("first._row").alias("first_row")), "groups")
    lone = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.join(group, "component", "left").select(
        "_row", "doc_id", "n_shingles", lone.alias("component_id"), F.coalesce("first_row", "_row").alias("first_row")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Null and empty texts and texts of white space have no shingles and no links. component_id is the smallest doc_id
    reachable over links, itself included; null ids count only where a group has no other. Repeated rows are linked and
    both kept if theirs is the smallest id. Very long texts are taken whole; an empty table gives an empty result; other
    columns are ignored.
    """
    texts = numbered(docs, [F.col("doc_id"), F.col("text")], "texts")
    return near_rows(texts).select("doc_id", "n_shingles", "component_id", _kept().alias("kept"))


def _kept() -> Column:
    return F.col("component_id").eqNullSafe(F.col("doc_id"))


def near_stage(docs: DataFrame, width: int = STAGE_SHINGLE) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id, of repeated ids the first row;
    null ids count only where a group has no other. Rows without shingles are no group and stay."""
    row = unused(docs, "_row")
    rows = stage(docs.select(F.monotonically_increasing_id().alias(row), "*"), "near-input")
    found = near_rows(rows.select(F.col(row).alias("_row"), "doc_id", "text"), width)
    gone = found.where("_row <> first_row").select(F.col("_row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
