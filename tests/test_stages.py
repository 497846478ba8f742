from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weaksift.plans import stages as P


def named(master: str, folder: str | None = None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="app")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        P.shared_folder(named(master))
    assert P.shared_folder(named(master, "file:///shared/")) == "file:///shared/weaksift/app"


def test_stages_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "shared_folder", lambda _: f"file://{tmp_path}/stages")
    frame = P.stage(spark.range(3).toDF("id"), "ids")
    assert frame.count() == 3 and list(tmp_path.rglob("*.parquet"))
    P.clear_stages(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_one_row_group_in_many_splits_is_dealt_evenly(spark, tmp_path):
    path, cores = f"{tmp_path}/rows", spark.sparkContext.defaultParallelism
    spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= cores  # many splits, of which one holds the row group
        found = P.spread(scan)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 20_000 and len(sizes) >= cores and max(sizes) <= 2 * 20_000 / cores


def test_even_splits_are_left_as_they_are_read(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(20_000).repartition(2 * spark.sparkContext.defaultParallelism).write.option("compression", "none").parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
        scan = spark.read.parquet(path)
        assert P.spread(scan) is scan
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_an_empty_scan_can_be_spread(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert P.spread(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_a_stage_sends_small_batches_to_its_workers(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "size": [int(batch["text"].str.len().sum())]})

    before = spark.conf.get(P.BATCH_CONF)
    long = spark.range(3_000).coalesce(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    one = spark.range(1).select(F.repeat(F.lit("x"), 2 * P.BATCH_BYTES).alias("text"))
    found = P.stage(long.unionByName(one).mapInPandas(sizes, "n long, size long"), "sizes").toPandas()
    assert found["n"].sum() == 3_001 and found["size"].sum() == 30_000_000 + 2 * P.BATCH_BYTES
    assert found[found["n"] > 1]["size"].max() <= P.BATCH_BYTES + 10_000
    assert spark.conf.get(P.BATCH_CONF) == before


def test_a_smaller_batch_of_the_session_stays(spark):
    before = spark.conf.get(P.BATCH_CONF)
    try:
        spark.conf.set(P.BATCH_CONF, "1m")
        with P.small_batches(spark):
            assert P._bytes(spark.conf.get(P.BATCH_CONF)) == 1 << 20
        assert spark.conf.get(P.BATCH_CONF) == "1m"
    finally:
        spark.conf.set(P.BATCH_CONF, before)
