"""Stage tables: a result written once to the shared folder and read back.

A stage cuts lineage and lets every later reader prune columns and push filters.
The folder is the one the cluster names in ``spark.checkpoint.dir``, so a stage
survives the loss of any executor. Only where none is named (a laptop, a test)
a fresh local folder is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
ONE_MACHINE = re.compile(r"local(\[[^\]]*\])?$")
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
SIZE = re.compile(r"(\d+)([bkmgtp]?)b?$")
UNEVEN = 2  # times the mean that the fullest split may hold


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's stages. On a cluster it must be named: a folder made here would
    exist on the driver only."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not ONE_MACHINE.match(spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weaksift-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/weaksift/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Deletes all stages of this application; for when the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet stage table and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends ``BATCH_BYTES`` of Arrow data to a Python worker at a time (or less, if the session says so; a
    longer row goes alone). A worker holds a batch several times over, as Arrow data, as Python values and as its results, and a
    core may keep more than one worker, so the default of 64 MB a batch costs gigabytes an executor."""
    before = spark.conf.get(BATCH_CONF, None)
    least = min([BATCH_BYTES, *[n for n in [_bytes(before)] if n > 0]])
    spark.conf.set(BATCH_CONF, str(least))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def _bytes(size: str | None) -> int:
    """A size as Spark writes it (``67108864b``, ``4m``); 0 for none."""
    found = SIZE.match((size or "").strip().lower())
    return int(found[1]) * 1024 ** "bkmgtp".index(found[2] or "b") if found else 0


def spread(df: DataFrame) -> DataFrame:
    """A plain scan dealt evenly, so that the per-row work uses all cores. How many splits a table comes in tells little: a
    row group is read by one task, however many splits its file is cut into, and one may hold a million rows. So the rows of
    the splits are counted, for which Parquet reads no column. Asking a frame with a shuffle would run the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    found = splits.agg(F.count("*").alias("filled"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if found["filled"] >= cores and found["most"] * found["filled"] <= UNEVEN * found["rows"]:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()))
