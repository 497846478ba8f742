"""Stage tables and ranks over sorted runs, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weaksift.plans.stages import new_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, fixes generated ids, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """The chosen columns with a row number ``_row`` that later jobs can rely on, since it is written down.
    Rows stay apart even if their ids repeat or are null."""
    return stage(docs.select(F.monotonically_increasing_id().alias("_row"), *columns), name)


def text_runs(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Where a batch of texts is to be cut into runs of about ``most`` bytes, which bounds what is held of it at once."""
    run = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // most
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cut, cut[1:]) if b > a)


def _run_sums(group: str, value: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, seen, total, begun = None, 0, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            fresh = np.empty(n, dtype=bool)
            fresh[1:] = codes[1:] != codes[:-1]
            fresh[0] = not begun or keys[0].as_py() != key
            at = np.arange(n)
            head = np.maximum.accumulate(np.where(fresh, at, -1))
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            ahead = np.cumsum(values) - values
            rank = np.where(head < 0, at + seen + 1, at - head + 1)
            before = np.where(head < 0, ahead + total, ahead - ahead[np.maximum(head, 0)])
            key, seen, total, begun = keys[-1].as_py(), int(rank[-1]), int(before[-1] + values[-1]), True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rank), pa.array(before.astype(np.int64))],
                names=[*batch.schema.names, "_part", "_rank", "_before"],
            )

    return work


def ranked(rows: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``_rank`` (from 1) and ``_before`` (sum of the whole number ``value`` over the rows ahead) inside ``group``.

    The rows are range-partitioned on group and order, so a group of any size spreads over tasks. Each task counts
    its own runs; the table of runs (tasks plus groups at most) gives every run its start. ``rows`` is read twice
    (the ranges are sampled) and should be a stage. Null is a group of its own.
    """
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_rank", T.LongType()),
            T.StructField("_before", T.LongType()),
        ]
    )
    keys = [F.asc_nulls_last(group), *order]
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_run_sums(group, value), schema)
    placed = stage(runs, name)
    spans = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(
        F.max("_rank").alias("_n"), F.max(F.col("_before") + F.col(value)).alias("_sum")
    )
    ahead = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(
        "_g",
        "_p",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum0"),
    )
    return (
        placed.join(stage(starts, name + "-runs"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
        .withColumn("_rank", F.col("_rank") + F.col("_n0"))
        .withColumn("_before", F.col("_before") + F.col("_sum0"))
        .drop("_g", "_p", "_n0", "_sum0", "_part")
    )
