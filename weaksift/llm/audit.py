"""How filters act together: for every order of five filters, what each step removes and what it costs.

The files of the table are processed as micro-batches of one Structured Streaming query. Four filters judge a row alone.
The fifth (a text that a smaller id has too) depends on all rows: state keyed by text holds the smallest id so far, and
when a smaller one comes, the row counted as first is taken back from the counters and counted again as a copy. What the
query appends are signed counts; their sums are the counters, whatever the order of the files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weaksift.llm.common import read_table, stage, text_runs
from weaksift.plans.stages import new_path

FILTERS = "ABCDE"
COPY = 1 << 4  # the bit of E
WORDS, DISTINCT, CAPITALS = 100, 80, 10
CAPITAL = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
BATCHES = 4  # micro-batches that the files present at the start are dealt to
TEXTS = 512  # of one state entry, about
JUDGED = "part string, id long, known boolean, key binary, mask int, n long, settled boolean, bucket long"
CHANGES = "part string, id long, known boolean, mask int, n long"
STATE = [("part", pa.string()), ("id", pa.int64()), ("key", pa.binary()), ("mask", pa.int32()), ("n", pa.int64())]


def _masks(texts: pa.Array) -> np.ndarray:
    """The bits of A to D of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end splits off an empty word
    codes = words.dictionary_encode().indices.to_numpy()[filled].astype(np.int64)
    rows = rows[filled].astype(np.int64)
    n = np.bincount(rows, minlength=len(texts))
    pairs = np.unique(rows * (len(words) + 1) + codes) // (len(words) + 1)
    distinct = np.bincount(pairs, minlength=len(texts))
    points = pc.utf8_length(texts).to_numpy().astype(np.int64)
    capitals, marked = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        data = text.as_buffer().to_pybytes()
        capitals[i] = len(data) - len(data.translate(None, CAPITAL))
        marked[i] = len(data) != len(data.translate(None, MARKS))
    return (
        (n < WORDS) * 1 + (100 * distinct < DISTINCT * n) * 2 + (100 * capitals > CAPITALS * points) * 4 + marked * 8
    ).astype(np.int32)


def _judge(buckets: int):
    """Masks and keys of the rows. What a batch can settle by itself is settled: of equal texts only the rows with the
    batch's smallest id can be first, so only they, counted, go to the state of their text; the others are copies and
    go anywhere. A hot text thus sends a row per batch to its state. A row without an id is no copy of anything."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, parts, texts = batch.columns
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            keys = [hashlib.sha256(text.as_buffer()).digest() for text in texts]
            masks = np.concatenate([_masks(texts.slice(a, b - a)) for a, b in text_runs(texts)])
            rows = pd.DataFrame({"part": parts.to_pandas(), "id": pc.fill_null(ids, 0).to_numpy(), "known": known, "key": keys, "mask": masks})
            least = rows["id"].where(rows["known"], np.iinfo(np.int64).max).groupby(rows["key"], sort=False).transform("min")
            first = rows["known"] & (rows["id"] == least)
            rows["settled"] = ~first
            rows.loc[rows["known"] & ~first, "mask"] += COPY
            rows["key"] = rows["key"].where(first, None)  # so that settled rows of one id, or of none, are one row
            rows["n"] = 1
            merged = rows.groupby(["part", "id", "known", "key", "mask", "settled"], sort=False, as_index=False, dropna=False)["n"].sum()
            merged["key"] = merged["key"].where(~merged["settled"], None)
            own = np.array([int.from_bytes(k[:7], "big") if k else 0 for k in merged["key"]], np.int64) % buckets
            spread = pd.util.hash_array(merged["id"].to_numpy()).astype(np.int64) % buckets
            merged["bucket"] = np.where(merged["settled"], spread, own)
            yield pa.RecordBatch.from_pandas(
                merged[["part", "id", "known", "key", "mask", "n", "settled", "bucket"]],
                pa.schema([("part", pa.string()), ("id", pa.int64()), ("known", pa.bool_()), ("key", pa.binary()), ("mask", pa.int32()),
                           ("n", pa.int64()), ("settled", pa.bool_()), ("bucket", pa.int64())]),
                preserve_index=False,
            )

    return work


def _pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, pa.schema(STATE), preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _keep_first(bucket: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of the texts of one bucket: the rows with the smallest id of each. Gives the changes of the counters."""
    columns = ["part", "id", "known", "mask", "n"]
    fresh = []
    for chunk in chunks:
        settled = chunk["settled"].astype(bool)
        if settled.any():
            yield chunk.loc[settled, columns]
        if not settled.all():
            fresh.append(chunk.loc[~settled, [name for name, _ in STATE]])
    if not fresh:
        return
    fresh = pd.concat(fresh).groupby([name for name, _ in STATE[:-1]], sort=False, as_index=False)["n"].sum()
    held = _unpack(state.get[0]) if state.exists else fresh.iloc[:0]
    rows = pd.concat([held.assign(held=True), fresh.assign(held=False)], ignore_index=True)
    first = rows["id"] == rows.groupby("key", sort=False)["id"].transform("min")
    came, back = rows[~rows["held"]], rows[rows["held"] & ~first]
    changes = [
        came.assign(mask=came["mask"] + np.where(first[came.index], 0, COPY)),
        back.assign(n=-back["n"]),  # counted as first before, and taken back
        back.assign(mask=back["mask"] + COPY),
    ]
    yield pd.concat(changes).assign(known=True)[columns]
    left = rows[first].groupby([name for name, _ in STATE[:-1]], sort=False, as_index=False)["n"].sum()
    state.update((_pack(left),))


def run_audit_stream(
    spark: SparkSession, path: str, target: str, checkpoint: str, batches: int = BATCHES, texts: int = TEXTS
) -> StreamingQuery:
    """Processes the files of ``path`` that ``checkpoint`` has not seen yet and appends the changes of the counters (part,
    id, known, mask, n) to ``target``. The number of state entries is fixed by the rows of the first run, about one for
    ``texts`` texts; it is kept beside the checkpoint, since state can't be dealt anew."""
    table = spark.read.parquet(path)
    files = max(1, len(table.inputFiles()))
    fixed = f"{checkpoint}-buckets"
    table.agg((F.count("*") / texts + 1).cast("long").alias("buckets")).write.mode("ignore").json(fixed)  # the first run's
    buckets = spark.read.schema("buckets long").json(fixed).first()[0]
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-files // batches))
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # the table may be one file, which a stream takes by a pattern only
    rows = reader.parquet(pattern).select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    judged = rows.mapInArrow(_judge(buckets), JUDGED)
    changes = judged.groupBy("bucket").applyInPandasWithState(_keep_first, CHANGES, "held binary", "append", "NoTimeout")
    return (
        changes.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def counters(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail, in all and with a label. Changes of one
    document are summed before they meet the labels, of which a document has the largest where it has several."""
    summed = changes.groupBy("part", "id", "known", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    found = summed.join(own, F.when(F.col("known"), F.col("id")) == F.col("doc"), "left")
    sums = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def _steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of all orders, and per measure which masks it counts, and how often, as a table of 0 and 1."""
    masks = np.arange(1 << len(FILTERS))
    size = np.array([int(m).bit_count() for m in masks])
    keys, rows = [], {name: [] for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, at in enumerate(order, 1):
            bit = 1 << at
            fails, earlier = (masks & bit) > 0, (masks & before) > 0
            keys.append(("".join(FILTERS[i] for i in order), step))
            rows["kept"].append((masks & (before | bit)) == 0)
            rows["removed"].append(fails & ~earlier)
            rows["redundant"].append(fails & earlier)
            rows["unique_fails"].append(masks == bit)
            # Of the 120 orders, each of a mask's filters comes first among them equally often.
            rows["shapley"].append(fails * (120 // np.maximum(size, 1)))
            before |= bit
    return keys, {name: np.array(r, dtype=np.int64) for name, r in rows.items()}


def interaction_table(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from the counters (32 rows a part at most)."""
    entry = F.struct("n", "good", "toxic")
    by_mask = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", entry))).alias("of"))
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    number = lambda c: F.transform(every, lambda m: F.coalesce(F.element_at("of", m)[c], F.lit(0))).alias(c)
    numbers = [number(c) for c in ("n", "good", "toxic")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, tables = _steps()
        orders, steps = zip(*keys)
        for batch in batches:
            for part, n, good, toxic in zip(batch["part"], batch["n"], batch["good"], batch["toxic"]):
                columns = {name: table @ np.asarray(n) for name, table in tables.items()}
                lost = {"good_lost": tables["removed"] @ np.asarray(good), "toxic_lost": tables["removed"] @ np.asarray(toxic)}
                yield pd.DataFrame({"part": part, "filter_order": orders, "step": steps} | columns | lost)

    schema = "part string, filter_order string, step int, " + ", ".join(
        f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "shapley", "good_lost", "toxic_lost")
    )
    return by_mask.select("part", *numbers).mapInPandas(work, schema)


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, texts: int = TEXTS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, shapley, good_lost, toxic_lost.

    A null text is empty, a null lang the empty string. Rows without an id are no copies and make none; rows of one id
    and one text are one another's equals, so none is a copy of the other. Repeated label rows count once. An
    empty table gives an empty result; other columns are ignored.
    """
    target, checkpoint = new_path(spark, "audit-changes"), new_path(spark, "audit-checkpoint")
    run_audit_stream(spark, path, target, checkpoint, batches, texts).awaitTermination()
    return interaction_table(stage(counters(spark.read.schema(CHANGES).parquet(target), labels), "audit"))


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


ORACLE = r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from t
), marks as (
  select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id
), m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [
           len(words) < 100,
           100 * len(list_distinct(words)) < 80 * len(words),
           100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
           regexp_matches(text, '[#$%&*|]'),
           coalesce(least < doc_id, false)] as f
  from w left join marks using (doc_id)
), masks as (
  select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, f
), letters as (select unnest([1, 2, 3, 4, 5]) as x),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select o, list_transform(o, lambda i: substr('ABCDE', i, 1)) as names, unnest([1, 2, 3, 4, 5]) as step from orders
), judged as (
  select part, array_to_string(names, '') as filter_order, step, o[step] as filter, n, good, toxic, f[o[step]] as fails,
         list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])) as earlier,
         len(list_filter(f, lambda v: v)) as failed
  from masks, steps
), counted as (
  select part, filter_order, step, filter,
         sum(case when not fails and not coalesce(earlier, false) then n else 0 end) as kept,
         sum(case when fails and not coalesce(earlier, false) then n else 0 end) as removed,
         sum(case when fails and coalesce(earlier, false) then n else 0 end) as redundant,
         sum(case when fails and failed = 1 then n else 0 end) as unique_fails,
         sum(case when fails and not coalesce(earlier, false) then good else 0 end) as good_lost,
         sum(case when fails and not coalesce(earlier, false) then toxic else 0 end) as toxic_lost
  from judged group by all
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(sum(removed) over (partition by part, filter) as bigint) as shapley,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost
from counted
"""
