"""Incremental intake with Structured Streaming. Each job runs the column functions of the batch
code, so a finished stream equals the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weaksift.lexicons import DOMAIN
from weaksift.operators import history as H
from weaksift.operators import quality as Q
from weaksift.operators import relevance as R
from weaksift.operators.scan import clean_items, scan_items
from weaksift.sources import raw_items as I

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAN = 8  # folders of changes that are merged into one


def discussion_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw items of discussion page files as they land."""
    return I.discussion_items(_json_stream(spark, folder, I.DISCUSSION_PAGE, files_per_batch))


def question_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    return I.question_items(_json_stream(spark, folder, I.QUESTION_PAGE, files_per_batch))


def _json_stream(spark, folder, schema, files_per_batch) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def table_stream(table: DataFrame, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of ``table``'s schema as they land in ``folder``."""
    reader = table.sparkSession.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(items: DataFrame, lexicon=DOMAIN) -> DataFrame:
    """Quality and relevance of each item on arrival: stateless, so it appends and never waits."""
    assessed = Q.assess_quality(scan_items(clean_items(items).drop("text"), lexicon), lexicon)
    return R.score_relevance(assessed, lexicon).drop(
        "found_text", "found_all", "found_words", "found_excerpt", "found_excerpt_plain", "opening"
    )


def run_append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything available now, appended exactly once to a Parquet folder."""
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_first_seen(
    items: DataFrame, target: str, checkpoint: str, order: str, earlier: DataFrame | None = None, files: int = 1, provider: str | None = ROCKSDB
) -> StreamingQuery:
    """Items whose (source_name, source_id) neither this stream nor the stored lineage (``earlier``) has seen; of a
    batch's rows with one key the first by ``order``. Exact: what has been seen is keyed state of the stream, a row per
    key, so a batch costs look-ups of its own keys and nothing that was written is read again. The state also holds when
    its key first came: a key is new in the batch in which that is the time of the batch itself.

    ``provider`` keeps the state (by default RocksDB, on the executors' disks and in the checkpoint; None: what the session
    has). A batch owns the folder of its id, in ``files`` files, so a replay after a failure writes the same rows again."""
    if earlier is not None:
        items = H.drop_seen(items, earlier)
    key = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("source_name", "source_id")]
    timed = items.withColumn("_now", F.current_timestamp())  # one for the whole batch, and the same one in a replay
    seen = timed.groupBy(*key).agg(
        F.min_by(F.struct(*items.columns), order).alias("_row"), F.min("_now").alias("_first"), F.max("_now").alias("_last")
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where("_first = _last").select("_row.*")
        fresh.repartition(files).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    def start() -> StreamingQuery:
        return (
            seen.writeStream.outputMode("update")
            .foreachBatch(take)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    return _with_conf(items.sparkSession, STATE_PROVIDER, provider, start)


def _with_conf(spark: SparkSession, name: str, value: str | None, start):
    """A stream takes the session's settings as they are when it starts."""
    before = spark.conf.get(name)
    if value is not None:
        spark.conf.set(name, value)
    try:
        return start()
    finally:
        spark.conf.set(name, before)


def first_seen_within(items: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The bounded alternative: duplicates are dropped only within ``delay`` of event time."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["source_name", "source_id"])


def run_collection_state(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Running state per (source, query): each batch writes the rows that changed, and every ``FAN`` folders are merged
    into one, last wins, as soon as they are there: levels, each ``FAN`` times as wide. No step is gathered into one task: a
    ``coalesce`` here would take the state of all partitions into it."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(_span(target, batch_id, batch_id))
        width = FAN
        while (batch_id + 1) % width == 0:
            parts = [_span(target, at, at + width // FAN - 1) for at in range(batch_id + 1 - width, batch_id + 1, width // FAN)]
            merged = _latest(batch.sparkSession.read.parquet(*parts))
            merged.write.mode("overwrite").parquet(_span(target, batch_id + 1 - width, batch_id))
            width *= FAN

    return (
        H.collection_state(pages)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _span(target: str, first: int, last: int) -> str:
    return f"{target}/from={first}/to={last}"


def _latest(changes: DataFrame) -> DataFrame:
    return H.last_wins(changes, ["source", "query"], [F.desc("batch_id")])


def state_folders(spark: SparkSession, target: str) -> list[str]:
    """The folders that together hold all changes, the widest merged ones for the earliest: fewer than ``FAN`` for each
    level. A folder counts when its write has ended."""
    files = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    names = lambda p: [s.getPath().getName() for s in files.listStatus(path(p))]
    spans: dict[int, int] = {}
    for start in names(target):
        if start.startswith("from="):
            first = int(start.removeprefix("from="))
            ends = [int(n.removeprefix("to=")) for n in names(f"{target}/{start}") if n.startswith("to=")]
            spans[first] = max((e for e in ends if files.exists(path(f"{_span(target, first, e)}/_SUCCESS"))), default=-1)
    at, found = 0, []
    while spans.get(at, -1) >= at:
        found.append(_span(target, at, spans[at]))
        at = spans[at] + 1
    return found


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The last written state of every (source, query), from the folders that are not merged into others."""
    return _latest(spark.read.parquet(*state_folders(spark, target))).drop("batch_id")
