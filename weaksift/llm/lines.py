"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import numbered, stage

WINDOW = 3  # lines


def line_windows(texts: DataFrame) -> DataFrame:
    """_row, doc_id, i, h1, h2: two hashes of the three lines from line i on, for all i."""
    lines = F.split("text", "\n", -1)
    starts = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    hashes = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(*[F.get("lines", i + k) for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(F.lit("second"), *[F.get("lines", i + k) for k in range(WINDOW)]).alias("h2"),
        ),
    )
    long = texts.select("_row", "doc_id", lines.alias("lines")).where(F.size("lines") >= WINDOW)
    return long.select("_row", "doc_id", F.posexplode(hashes).alias("i", "h")).select("_row", "doc_id", "i", "h.h1", "h.h2")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """_row, starts: the lines of each row at which a window begins that was seen before, by doc_id (null last), row
    and line. Only hashes are shuffled, and summed before; a window of any frequency is one row per task."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "i")
    seen = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    seen = stage(seen.where("n > 1").select("h1", "h2", F.col("first._row").alias("row1"), F.col("first.i").alias("i1")), "seen")
    later = windows.join(seen, ["h1", "h2"]).where("_row <> row1 or i <> i1")
    return later.groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias("starts"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, gone, kept = [], [], []
        for text, starts in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            lines = text.split("\n")
            count.append(len(lines))
            if starts.is_valid:
                edge = np.zeros(len(lines) + WINDOW, np.int64)
                at = starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                covered = np.cumsum(edge)[: len(lines)] > 0
                text = "\n".join([line for line, c in zip(lines, covered) if not c])
                gone.append(int(covered.sum()))
            else:
                gone.append(0)
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "text"],
        )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left, by lines) for every row.

    Every three consecutive lines are a window. Of equal windows anywhere, the first by doc_id, row and line stays;
    each line covered by a later one is removed, overlaps once. Texts of fewer lines lose nothing; null is the empty
    text (one line); null ids come last; repeated rows are later occurrences; an empty table gives an empty result;
    other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = numbered(docs, [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")], "lines")
    starts = repeated_windows(stage(line_windows(texts), "windows"))
    rows = texts.join(starts, "_row", "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(_cut, f"doc_id {id_type}, n_lines long, n_removed long, text string")


def lines_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and digest of what is left."""
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), digest)




ORACLE = """
with lines as (
  select r, doc_id, unnest(l) as line, unnest(range(len(l))) as i
  from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
ahead as (
  select *, lead(line, 1) over w as line2, lead(line, 2) over w as line3 from lines window w as (partition by r order by i)),
placed as (
  select r, i, row_number() over (partition by line, line2, line3 order by doc_id nulls last, r, i) as k
  from ahead where line3 is not null),
gone as (
  select distinct p.r, p.i + unnest(range(3)) as i from placed p where k > 1)
select any_value(l.doc_id) as doc_id, count(*) as n_lines, count(g.i) as n_removed,
  length(coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), ''))::bigint as n_chars,
  sha256(coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '')) as kept_sha256
from lines l left join gone g on l.r = g.r and l.i = g.i group by l.r
"""
