from __future__ import annotations

from pyspark.sql import functions as F

from weaksift.operators import history as H
from weaksift.plans.seeded import PHRASES
from weaksift.sources import raw_items as I
from weaksift.streaming import jobs as J


def pages(spark):
    hits = [(f"{i}", None, None, title, "me", "", text) for i, (_, _, title, text) in enumerate(PHRASES)]
    rows = [("q", n, "", hits[n * 4 : n * 4 + 4], 7, {}) for n in range(7)]
    return spark.createDataFrame(rows, I.DISCUSSION_PAGE)


def test_scored_stream_equals_batch(spark, tmp_path):
    folder, target = str(tmp_path / "pages"), str(tmp_path / "scored")
    pages(spark).repartition(3).write.json(folder)
    J.run_append(J.score_stream(J.discussion_stream(spark, folder, 1)), target, str(tmp_path / "check")).awaitTermination()
    columns = ["source_id", "quality_score", "kept", "relevance_score", "exclude_for_relevance"]
    streamed = spark.read.parquet(target).select(columns)
    batch = J.score_stream(I.discussion_items(I.read_discussion_pages(spark, folder))).select(columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_first_seen_across_batches_restarts_and_lineage(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "source_name string, source_id string, place long"
    earlier = spark.createDataFrame([("n", "0", 0)], schema)
    arrive = lambda ids, start: spark.createDataFrame(
        [("n", str(i), start + k) for k, i in enumerate(ids)], schema
    ).coalesce(1).write.mode("append").parquet(source)
    run = lambda: J.run_first_seen(
        J.table_stream(earlier, source, 1), target, check, "place", earlier
    ).awaitTermination()
    arrive([0, 1, 1, 2], 0)
    run()
    arrive([2, 3], 10)
    arrive([1, 3, 4], 20)
    run()  # a new query on the same checkpoint
    rows = spark.read.parquet(target)
    assert sorted(r.source_id for r in rows.collect()) == ["1", "2", "3", "4"]
    assert rows.where("source_id = '1'").first().place == 1


def test_running_state_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "log"), str(tmp_path / "states")
    log = spark.range(200).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
        F.concat(F.lit("q"), F.col("id") % 5).alias("query"),
        F.col("id").alias("page_number"),
        F.lit(2).cast("long").alias("raw_count"),
        F.lit(1).cast("long").alias("item_count"),
        (F.col("id") % 2 == 0).alias("has_more"),
    )
    log.repartition(4).write.parquet(source)
    J.run_collection_state(J.table_stream(log, source, 1), target, str(tmp_path / "check")).awaitTermination()
    streamed, batch = J.latest_state(spark, target), H.collection_state(log)
    streamed = streamed.select(batch.columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def table_files(folder, name):
    return sorted(p.name for p in (folder / name).iterdir() if p.name.startswith("part-"))


def test_running_state_is_merged_in_levels(spark, tmp_path, monkeypatch):
    """After many batches a reader opens a few folders, and sees the last state of all."""
    monkeypatch.setattr(J, "FAN", 3)
    source, target, check = tmp_path / "log", tmp_path / "states", str(tmp_path / "check")
    schema = "source string, query string, page_number long, raw_count long, item_count long, has_more boolean"
    log = []
    for batch in range(14):
        rows = [(f"s{i % 4}", f"q{(batch + i) % 5}", batch, 2, 1, (batch + i) % 2 == 0) for i in range(3)]
        log += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        if batch in (4, 13):  # restarts on the same checkpoint
            J.run_collection_state(J.table_stream(spark.createDataFrame([], schema), str(source), 1), str(target), check).awaitTermination()
    batches = 14
    folders = J.state_folders(spark, str(target))
    widths = [int(f.split("to=")[1]) - int(f.split("from=")[1].split("/")[0]) + 1 for f in folders]
    assert sum(widths) == batches and widths == [9, 3, 1, 1]
    batch = H.collection_state(spark.createDataFrame(log, schema))
    streamed = J.latest_state(spark, str(target)).select(batch.columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_first_seen_reads_nothing_again(spark, tmp_path):
    """Many batches, each with keys of all earlier ones: a batch updates its own keys' state alone, writes one file of its
    own, and the first of each key stays."""
    source, target = tmp_path / "in", tmp_path / "out"
    schema = "source_name string, source_id string, place long"
    n, size = 20, 30
    for batch in range(n):
        rows = [(None if i % 7 == 0 else "n", str(i if i < 10 else batch * size + i), batch * 100 + i) for i in range(size)]
        spark.createDataFrame(rows + rows[:5], schema).coalesce(1).write.mode("append").parquet(str(source))
    query = J.run_first_seen(J.table_stream(spark.createDataFrame([], schema), str(source), 1), str(target), str(tmp_path / "check"), "place")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == n
    assert all(p["stateOperators"][0]["numRowsUpdated"] <= size for p in progress)
    assert all(len(table_files(target, f"batch_id={b}")) <= 1 for b in range(n))
    got = spark.read.parquet(str(target))
    assert got.count() == 10 + n * 20 == got.select("source_name", "source_id").distinct().count()
    assert got.where("int(source_id) < 10").agg(F.max("place")).first()[0] < 10


def test_running_state_is_not_gathered_into_one_task(spark, tmp_path):
    """Every partition of the state writes what changed in it."""
    source, target = str(tmp_path / "log"), tmp_path / "states"
    schema = "source string, query string, page_number long, raw_count long, item_count long, has_more boolean"
    log = spark.createDataFrame([(f"s{i}", "q", 1, 2, 1, True) for i in range(200)], schema)
    log.coalesce(1).write.parquet(source)
    J.run_collection_state(J.table_stream(log, source, 1), str(target), str(tmp_path / "check")).awaitTermination()
    assert len(table_files(target / "from=0", "to=0")) > 4
    assert J.latest_state(spark, str(target)).count() == 200
