"""Exact dedup by deterministic block naming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import stage, unused

BLOCK = 4096  # bytes of a block
COPIES = 1 << 16  # rows that one element of a copy list stands for

KEYS = ["doc_id", "sha", "n", "copies", "pos"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = "doc_id {id}, sha binary, n long, copies long, pos long, h long, block binary"
NAMED = "doc_id {id}, sha binary, n long, copies long, pos long, name long, edge binary"


def _blocks(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
            for lo in range(0, len(texts), 256):
                at, sha, count, pos, h, block = [], [], [], [], [], []
                for i in range(lo, min(lo + 256, len(texts))):
                    text = texts[i].as_py()
                    digest = hashlib.sha256(text).digest()
                    n = max(1, -(-len(text) // size))
                    for k in range(n):
                        piece = text[k * size : (k + 1) * size]
                        at.append(i)
                        sha.append(digest)
                        count.append(n)
                        pos.append(k)
                        h.append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                        block.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)),
                        pa.array(sha, pa.binary()),
                        pa.array(count, pa.int64()),
                        pa.array(np.ones(len(at), np.int64)),
                        pa.array(pos, pa.int64()),
                        pa.array(h, pa.int64()),
                        pa.array(block, pa.binary()),
                    ],
                    names=["doc_id", "sha", "n", "copies", "pos", "h", "block"],
                )

    return work


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the distinct blocks of a sorted range. A block that may go on in another range (one with the hash of
    the first or of the last block here) is told once more, with its content in ``edge``."""
    name = (TaskContext.get().partitionId() << 40) - 1
    head = h_now = block_now = None
    tail: list[tuple[int, bytes]] = []  # the distinct blocks of the current hash
    kinds = None

    def told(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        empty = [pa.nulls(len(found), kind) for kind in kinds]
        named = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())]
        return pa.RecordBatch.from_arrays([*empty, *named], names=[*KEYS, "name", "edge"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kinds = [c.type for c in batch.columns[:5]]
        h, blocks = batch.column(5).to_numpy(), batch.column(6)
        same = np.empty(n, dtype=bool)
        same[0], same[1:] = h_now is not None and h[0] == h_now, h[1:] == h[:-1]
        for i in np.flatnonzero(same):  # equal hashes decide nothing: compare the contents
            same[i] = blocks[int(i)].as_py() == (blocks[int(i) - 1].as_py() if i else block_now)
        edges = []
        for i in map(int, np.flatnonzero(~same)):
            name += 1
            if h[i] != h_now:
                tail, h_now = [], h[i]
                head = h_now if head is None else head
            tail.append((name, blocks[i].as_py()))
            if h_now == head:
                edges.append(tail[-1])
        block_now = blocks[n - 1].as_py()
        names = name - np.cumsum(~same[::-1])[::-1] + ~same
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(names), pa.nulls(n, pa.binary())], names=[*KEYS, "name", "edge"]
        )
        if edges:
            yield told(edges)
    if tail and h_now != head:
        yield told(tail)


def _named(blocks: DataFrame, id_type: str) -> DataFrame:
    """Blocks sorted into whole-number names: equal names are equal blocks. A block spread over several ranges takes
    the smallest of its names there."""
    n = blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranges = blocks.repartitionByRange(int(n), "h", "doc_id", "pos").sortWithinPartitions("h", "block")
    placed = stage(ranges.mapInArrow(_number, NAMED.format(id=id_type)), "names")
    edges = placed.where(F.col("edge").isNotNull()).select("name", "edge")
    least = edges.groupBy("edge").agg(F.min("name").alias("least"), F.count("*").alias("told")).where("told > 1")
    moved = stage(edges.join(least, "edge").where("name <> least").select("name", "least").distinct(), "moved")
    return (
        placed.where(F.col("edge").isNull())
        .join(moved, "name", "left")
        .select(*KEYS, F.coalesce("least", "name").alias("name"))
    )


def exact_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Text keys (doc_id and digest) with their numbers of rows ``copies`` and identity (level, name).

    Blocks get names by sorting; then the names of neighbours, in pairs, get names the same way, and so on until one
    name is left. A document of b blocks ends at level ceil(log2 b). Two documents have the same level and name only
    if their texts are equal, whatever the hashes say: names are given by content.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_blocks(block), BLOCKS.format(id=id_type))
    level, done = 0, None
    while True:
        named = stage(_named(rows, id_type), f"level{level}")
        found = named.where("n = 1").select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name")
        done = found if done is None else done.unionByName(found)
        if not named.where("n > 1").limit(1).count():
            return done
        first = F.col("pos") % 2 == 0
        pairs = (
            named.where("n > 1")
            .groupBy("doc_id", "sha", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"),
                F.sum(F.when(first, F.col("copies")).otherwise(0)).alias("copies"),
                F.max(F.when(first, F.col("name"))).alias("a"),
                F.max(F.when(~first, F.col("name"))).alias("b"),
            )
            .withColumn("h", F.xxhash64("a", "b"))
            .withColumn("block", F.concat_ws(".", "a", "b").cast("binary"))
        )
        rows = stage(pairs.select(*KEYS, "h", "block"), f"pairs{level}")
        level += 1


def exact_keys(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``exact_names`` with the group each text key belongs to: keep_id (largest doc_id), group_size, and whether the
    key is the one that stays (one of its rows does)."""
    rows = exact_names(docs, block).groupBy("doc_id", "sha", "level", "name")
    names = stage(rows.agg(F.sum("copies").alias("copies")), "identities")
    groups = names.groupBy("level", "name").agg(F.max("doc_id").alias("_keep"), F.sum("copies").alias("_size"))
    groups = stage(groups.where("_size > 1"), "groups")  # most texts stand alone
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return names.join(groups, ["level", "name"], "left").select(
        "doc_id",
        "sha",
        "copies",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its group of equal texts.

    Texts are equal if they are identical after lower-casing A-Z; null is the empty text. Of a group the row with the
    largest doc_id stays (a null id is smaller than any other); of repeated rows with that id, one. Extra columns are
    ignored, an empty table gives an empty result, and very long texts are only ever handled block by block.
    """
    last = F.floor((F.col("copies") - 1) / COPIES).cast("long")
    many = exact_keys(docs, block).withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = F.least(F.lit(COPIES - 1).cast("long"), F.col("copies") - 1 - F.col("_high") * COPIES)
    return many.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), left))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("kept") & (F.col("_high") == 0) & (F.col("_low") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_stage(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Only rows of groups that lose some are looked at again."""
    keys = stage(exact_keys(docs), "keys")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).cast("binary"), 256)
    own, gone_id, gone_sha = (unused(docs, name) for name in ("_sha", "_gone_id", "_gone_sha"))
    marked = docs.withColumn(own, F.unhex(sha))
    gone = keys.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("sha").alias(gone_sha))
    same = (F.col(own) == F.col(gone_sha)) & F.col("doc_id").eqNullSafe(F.col(gone_id))
    left = marked.join(gone, same, "left_anti")
    if keys.where("kept and copies > 1").limit(1).count():  # whole rows repeat
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
