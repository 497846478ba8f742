"""Hashed bag-of-words vectors and other vector backends."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from pyspark.sql.window import Window as W

from weaksift.functions import text as T
from weaksift.lexicons import STOP_WORDS

# Model name, version and grouping note of the artifact records, and the fields of an item's text.
HASHED = (
    "hashed-text-embedding", "v1", "pain mechanism candidate buckets plus hashed embedding cosine connected components",
)
DENSE = (
    "sentence-transformer-embedding", "v1",
    "pain mechanism candidate buckets plus transformer embedding cosine connected components",
)
SOURCE_TEXT_FIELDS = ["title", "clean_text", "relevance_reasons", "quality_reasons"]

DIMENSIONS = 64
TOKEN = "[a-z][a-z0-9-]{2,}"
LETTER_BYTES = np.array([97 <= b <= 122 for b in range(256)])
TOKEN_BYTES = LETTER_BYTES | np.array([48 <= b <= 57 or b == 45 for b in range(256)])
TOP_TERMS = 8
ROWS_TOGETHER = 2_048  # of a group whose terms are counted in one go; a larger group is counted in parts
PIECES = 16  # counts of a part that are kept before they are summed


def item_text() -> Column:
    return F.lower(
        F.concat_ws(
            " ",
            "title",
            "clean_text",
            T.join_reasons(F.col("relevance_reasons")),
            T.join_reasons(F.col("quality_reasons")),
        )
    )


def tokens(stop_words: list[str] = STOP_WORDS) -> Column:
    return F.filter(F.regexp_extract_all(item_text(), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(stop_words))


def token_slots(tokens: Column, dimensions: int = DIMENSIONS) -> Column:
    """The vector slot of every token: the first eight hex digits of its SHA-256, modulo."""
    return F.transform(
        tokens, lambda t: (F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _unit_counts(slots: pd.Series, dimensions: pd.Series) -> pd.Series:
    width = int(dimensions.iloc[0]) if len(dimensions) else DIMENSIONS
    lengths = slots.map(len).to_numpy(dtype=np.int64)
    flat = np.concatenate(slots.to_list()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(slots), dtype=np.int64), lengths)
    counts = np.bincount(row * width + flat, minlength=len(slots) * width).reshape(-1, width).astype(float)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(np.divide(counts, norm, out=counts, where=norm > 0)), index=slots.index)


def _words(texts: pa.Array, stop_words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of ``texts``: the row of each, its number, and the terms by number. What ``tokens`` finds, by the bytes: a run
    of token characters from its first letter on, if three are left."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = TOKEN_BYTES[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[offsets] = True  # a run ends with its text
    edges = np.flatnonzero(edges)
    starts, ends = edges[:-1], edges[1:]
    of_token = inside[starts]
    starts, ends = starts[of_token], ends[of_token]
    off = np.flatnonzero(~LETTER_BYTES[data[starts]])
    letters = np.append(np.flatnonzero(LETTER_BYTES[data]), len(data)) if len(off) else None
    if len(off):
        starts[off] = np.minimum(letters[np.searchsorted(letters, starts[off])], ends[off])
    long = ends - starts >= 3
    starts, ends = starts[long], ends[long]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.stack([starts, ends], axis=1).reshape(-1).astype(np.int32)  # tokens and what is between them, in turns
    pieces = pa.Array.from_buffers(pa.string(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    found = pieces.take(pa.array(np.arange(0, len(pieces), 2))).dictionary_encode()
    numbers = found.indices.to_numpy()
    stays = ~pc.is_in(found.dictionary, value_set=pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)[numbers]
    return rows[stays], numbers[stays], found.dictionary


@F.arrow_udf(ArrayType(StringType()))
def _token_lists(texts: pa.Array) -> pa.Array:
    rows, numbers, terms = _words(texts, STOP_WORDS)
    offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), terms.take(pa.array(numbers)))


@F.arrow_udf(ArrayType(DoubleType()))
def _unit_token_counts(texts: pa.Array, dimensions: pa.Array) -> pa.Array:
    """``_unit_counts`` of the slots of the tokens; the slot of a term is told once a batch."""
    width = dimensions[0].as_py() if len(dimensions) else DIMENSIONS
    rows, numbers, terms = _words(texts, STOP_WORDS)
    slots = np.array([int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % width for t in terms.to_pylist()], np.int64)
    counts = np.bincount(rows * width + slots[numbers], minlength=len(texts) * width).reshape(-1, width).astype(float)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    units = np.divide(counts, norm, out=counts, where=norm > 0)
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(units.reshape(-1)))


def token_lists() -> Column:
    """``tokens`` of the default stop words, told in Arrow batches; for whole tables of long texts."""
    return _token_lists(item_text())


def _flat(tokens: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of every token, and the tokens with each term once."""
    return pc.list_parent_indices(tokens).to_numpy().astype(np.int64), pc.list_flatten(tokens).dictionary_encode()


@F.pandas_udf(ArrayType(StringType()))
def _most_frequent(tokens: pd.Series) -> pd.Series:
    def best(values):
        return [term for term, _ in nsmallest(TOP_TERMS, Counter(values).items(), key=lambda kv: (-kv[1], kv[0]))]

    return tokens.map(best)


def hashed_vectors(items: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds ``vector``: token counts per slot, L2-normalised; no shuffle."""
    return items.withColumn("vector", _unit_token_counts(item_text(), F.lit(dimensions)))


def round_half_up(value: Column, places: int) -> Column:
    scale = 10.0**places
    return F.floor(value * scale + 0.5) / scale


def embedding_payload(items: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The sparse form of the hashed vector, with the item's top terms and token count."""
    counted = items.withColumn("_tokens", tokens()).withColumns(
        {
            "_rounded": F.transform(
                _unit_counts(token_slots(F.col("_tokens"), dimensions), F.lit(dimensions)),
                lambda v: round_half_up(v, 6),
            ),
            "top_terms": _most_frequent("_tokens"),
            "token_count": F.size("_tokens").cast("long"),
        }
    )
    entries = F.filter(
        F.transform("_rounded", lambda v, i: F.struct(i.alias("slot"), v.alias("value"))), lambda e: e["value"] != 0
    )
    return counted.withColumn("_entries", entries).select(
        *items.columns,
        F.lit("sparse_hashing").alias("embedding_type"),
        F.lit(dimensions).alias("dimensions"),
        F.col("_entries.slot").alias("nonzero_indices"),
        F.col("_entries.value").alias("values"),
        "top_terms",
        "token_count",
        _text_fields(),
    )


def dense_payload(items: DataFrame, identifier: str) -> DataFrame:
    """The whole vector of items that have one, with their top terms and token count."""
    counted = items.withColumn("_tokens", tokens())
    return counted.select(
        *items.columns,
        F.lit("dense_transformer").alias("embedding_type"),
        F.size("vector").alias("dimensions"),
        F.transform("vector", lambda v: round_half_up(v, 6)).alias("values"),
        _most_frequent("_tokens").alias("top_terms"),
        F.size("_tokens").cast("long").alias("token_count"),
        F.lit(identifier).alias("model_identifier"),
        _text_fields(),
    )


def _text_fields() -> Column:
    return F.array(*[F.lit(f) for f in SOURCE_TEXT_FIELDS]).alias("source_text_fields")


def top_terms(rows: DataFrame, keys: list[str], how_many: int = TOP_TERMS) -> DataFrame:
    """``top_terms`` per group of rows with ``tokens``, by (-count, term). Counts are
    pre-aggregated before the shuffle and only the leading terms of each task reach the rank."""
    counts = rows.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    return _leading(counts, keys, how_many)


def _leading(counts: DataFrame, keys: list[str], how_many: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "term")
    ranked = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= how_many)
    return ranked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda e: e["term"]).alias("top_terms")
    )


def top_terms_of_groups(
    rows: DataFrame, keys: list[str], size: str, spread_by: str, how_many: int = TOP_TERMS, together: int = ROWS_TOGETHER
) -> DataFrame:
    """``top_terms`` of groups without a null key, the rows of which the column ``size`` tells. The terms are counted in Arrow
    batches. Rows of a group meet in one task, where only its leading terms leave it; a group of more than ``together`` rows is
    dealt by ``spread_by`` into parts, whose counts are summed after."""
    parts = F.ceil(F.col(size) / together)
    dealt = rows.select(
        *keys, F.pmod(F.xxhash64(spread_by), parts).cast("int").alias("_part"), (parts == 1).alias("_whole"), "tokens"
    )
    group = [*keys, "_part", "_whole"]
    names = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {names[k]}" for k in keys], "term string", "n long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the group that goes on in the next batch: its key and its counts so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(name) for name in group]
            new = np.zeros(batch.num_rows, bool)
            for column in columns:
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            number, first = np.cumsum(new), np.flatnonzero(new | (np.arange(len(new)) == 0))
            parents, terms = _flat(batch.column("tokens"))
            # Entries of a group and term in the order of the groups, most frequent first, then by term.
            order = pc.sort_indices(terms.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            entries, n = np.unique(number[parents] * max(1, len(order)) + place[terms.indices.to_numpy()], return_counts=True)
            of, term = np.divmod(entries, max(1, len(order)))
            starts = np.searchsorted(of, np.arange(len(first) + 1))

            def piece(at: np.ndarray) -> pa.Table:
                return pa.table({"term": terms.dictionary.take(pa.array(order[term[at]])), "n": pa.array(n[at].astype(np.int64))})

            begin = 0
            if held is not None:
                if held[0] == [c[0].as_py() for c in columns]:
                    held[1].append(piece(np.arange(starts[0], starts[1])))
                    begin = 1
                if begin == 0 or len(first) > 1:
                    yield from _finished(*held, keys, batch.schema, how_many)
                    held = None
            last = len(first) - 1
            if last >= begin:
                held = ([c[int(first[last])].as_py() for c in columns], [piece(np.arange(starts[last], starts[last + 1]))])
            elif len(held[1]) > PIECES:
                held = (held[0], [_summed(held[1])])
            inner = np.arange(starts[begin], max(starts[begin], starts[max(begin, last)]))
            if len(inner):
                inner = inner[np.lexsort((term[inner], -n[inner], of[inner]))]
                rank = np.arange(len(inner)) - np.searchsorted(of[inner], of[inner])
                whole = columns[-1].to_numpy(zero_copy_only=False)[first[of[inner]]]
                inner = inner[~whole | (rank < how_many)]
                out, at = piece(inner), pa.array(first[of[inner]])
                arrays = [columns[i].take(at) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*arrays, *[out.column(c).combine_chunks() for c in out.column_names]], names=[*keys, "term", "n"])
        if held is not None:
            yield from _finished(*held, keys, batch.schema, how_many)

    # A part's rows come one after another, so that no more than the counts of one are held.
    sorted_rows = dealt.repartition(*keys, "_part").sortWithinPartitions(*group)
    counts = sorted_rows.mapInArrow(count, schema).groupBy(*keys, "term").agg(F.sum("n").alias("n"))
    return _leading(counts, keys, how_many)


def _summed(pieces: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(pieces)
    return table.group_by("term").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["term", "n"])


def _finished(key: list, pieces: list[pa.Table], keys: list[str], schema: pa.Schema, how_many: int) -> Iterator[pa.RecordBatch]:
    """The counts of a group or part that is complete."""
    table = _summed(pieces).sort_by([("n", "descending"), ("term", "ascending")])
    table = table.slice(0, how_many) if key[-1] else table
    if table.num_rows:
        arrays = [pa.array([value] * table.num_rows, schema.field(name).type) for name, value in zip(keys, key)]
        found = [table.column(c).combine_chunks() for c in ("term", "n")]
        yield pa.RecordBatch.from_arrays([*arrays, *found], names=[*keys, "term", "n"])


def table_vectors(vector_table: DataFrame, id_column: str, vector_column: str) -> Callable[[DataFrame], DataFrame]:
    """A backend whose vectors come ready in a table, joined by item key; normalised here.
    Items without a vector are reported by the join as missing (null vector)."""
    norm = F.sqrt(F.aggregate(vector_column, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    ready = vector_table.select(
        F.col(id_column).cast("string").alias("source_id"),
        F.transform(vector_column, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(0.0)).alias("vector"),
    )
    return lambda items: items.join(ready, "source_id", "left")


def user_vectors(encode: Callable[[list[str]], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """A backend from a user's batch encoder (texts -> matrix), run in Arrow batches."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def encoded(texts: pd.Series) -> pd.Series:
        matrix = np.asarray(encode(texts.to_list()), dtype=float)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        return pd.Series(list(np.divide(matrix, norm, out=matrix, where=norm > 0)), index=texts.index)

    return lambda items: items.withColumn("vector", encoded(item_text()))


@dataclass(frozen=True)
class Backend:
    """What makes vectors of items, and what is told of it in artifacts. ``payload`` adds the columns of an
    embedding record to items that have their ``vector``."""

    encode: Callable[[DataFrame], DataFrame]
    model: str
    version: str
    basis: str
    payload: Callable[[DataFrame], DataFrame]
    payload_fields: tuple[str, ...]
    identifier: str = ""

    def __call__(self, items: DataFrame) -> DataFrame:
        return self.encode(items)

    @property
    def label(self) -> str:
        return f"{self.model}@{self.version}" + (f":{self.identifier}" if self.identifier else "")


def backend(name: str, identifier: str = "", **options) -> Backend:
    """Backend by name: ``hashing``, ``table`` or ``function``; ``identifier`` names the model behind a
    table or function."""
    if name == "hashing":
        dimensions = options.get("dimensions", DIMENSIONS)
        fields = ("embedding_type", "dimensions", "nonzero_indices", "values", "top_terms", "token_count", "source_text_fields")
        return Backend(
            lambda items: hashed_vectors(items, **options), *HASHED, lambda items: embedding_payload(items, dimensions), fields
        )
    encoders = {"table": table_vectors, "function": user_vectors}
    if name not in encoders:
        raise ValueError(f"unsupported vector backend: {name}")
    fields = ("embedding_type", "dimensions", "values", "top_terms", "token_count", "model_identifier", "source_text_fields")
    shown = identifier or name
    return Backend(encoders[name](**options), *DENSE, lambda items: dense_payload(items, shown), fields, shown)


def cosine(left: Column, right: Column) -> Column:
    """Dot product of two normalised vectors."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
