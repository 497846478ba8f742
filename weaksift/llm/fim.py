"""Fill-in-the-middle: prefix, suffix and middle of a text in a new order, behind marks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaksift.llm.common import text_runs, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 50  # of 100 texts are transformed
SPM = 80  # of 100 transformed texts start with the suffix
SEED = 42
CUT = b"\xff"  # no byte of UTF-8, so no text holds it
EDGE = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])"  # a unit ends where white space follows something else
TOGETHER = 1 << 24  # bytes of text whose pieces and output are held at once
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def chances(doc_id: Column, seed: int = SEED) -> Column:
    """Four whole numbers below 2^32 from a hash of the id (null: of no digits), so that reruns agree."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _units(texts: pa.Array) -> pa.ListArray:
    """Each text (as bytes) as the list of its units, which concatenate to it; the empty text has none."""
    edges = pc.replace_substring_regex(texts, pattern=EDGE, replacement=b"\\1" + CUT + b"\\2")
    lists = pc.split_pattern(edges, CUT)
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar([], lists.type), lists)


def _pieces(units: pa.Array, parents: pa.Array, keep: pa.Array, rows: int) -> pa.Array:
    """The kept units of each row, joined."""
    counted = pc.value_counts(pc.filter(parents, keep))
    place = pc.index_in(pa.array(range(rows), parents.type), counted.field("values"))
    sizes = pc.fill_null(pc.take(counted.field("counts"), place), 0)
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, keep)), b"")


def _transform(texts: pa.Array, chance: pa.ListArray, rate: int, spm: int) -> list[pa.Array]:
    """The columns ``ADDED`` of a batch of texts without nulls."""
    rows = len(texts)
    data = texts.cast(pa.binary())
    lists = _units(data)
    n = pc.list_value_length(lists).cast(pa.int64())
    h = [pc.list_element(chance, i) for i in range(4)]
    remainder = lambda a, b: pc.subtract(a, pc.multiply(pc.divide(a, b), b))
    first, second = (remainder(x, pc.add(n, 1)) for x in h[:2])
    low, high = pc.min_element_wise(first, second), pc.max_element_wise(first, second)

    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pc.subtract(pc.cumulative_sum(n), n)  # number of the row's first unit
    ordinal = pc.subtract(pa.array(range(len(units)), pa.int64()), pc.take(begin, parents))
    before, after = pc.less(ordinal, pc.take(low, parents)), pc.greater_equal(ordinal, pc.take(high, parents))
    between = pc.invert(pc.or_(before, after))
    prefix, middle, suffix = (_pieces(units, parents, role, rows) for role in (before, between, after))

    mark = lambda m: pa.scalar(m.encode(), pa.binary())
    join = lambda *parts: pc.binary_join_element_wise(*parts, b"")
    psm = join(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    moved = join(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(remainder(h[2], 100), rate))
    for m in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, m))
    first_suffix = pc.less(remainder(h[3], 100), spm)
    form = pc.if_else(plain, "plain", pc.if_else(first_suffix, "spm", "psm"))
    output = pc.if_else(plain, data, pc.if_else(first_suffix, moved, psm)).cast(pa.string())
    size = lambda piece: pc.if_else(plain, None, pc.utf8_length(piece.cast(pa.string())).cast(pa.int64()))
    return [n, form, size(prefix), size(middle), output]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain)
    and output (the text in its new order).

    Units are white space with what follows it, so they concatenate to the text. The cuts, the form and its order come
    from a hash of the id. A null text is empty; an empty text, or one that holds a mark, stays plain; a null id
    has a hash of its own; repeated rows give repeated rows; an empty table gives an empty result. Columns of ``docs``
    with a name of the added ones are replaced. One pass in Arrow batches, nothing is shuffled.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    text, chance = unused(docs, "_text"), unused(docs, "_chance")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce("text", F.lit("")).alias(text), chances(F.col("doc_id"), seed).alias(chance)
    )
    added = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = T.StructType([*rows.schema.fields[: len(kept)], *T._parse_datatype_string(added).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_runs(batch.column(len(kept)), TOGETHER):
                part = batch.slice(a, b - a)
                columns = _transform(part.column(len(kept)), part.column(len(kept) + 1), rate, spm)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=schema.names)

    return rows.mapInArrow(work, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. The marks are found from the left; no piece holds one, and none can
    begin inside another."""
    after = lambda text, head: F.substr(text, F.length(head) + F.lit(len(MIDDLE) + 1))
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    head = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = after(body, head)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, second)
    text = F.when(form == "psm", F.concat(head, middle, second)).otherwise(F.concat(second, middle, head))
    return F.when(form == "plain", output).otherwise(text)


def fim_query(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
  select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
         [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in [0, 1, 2, 3]] as c
  from t
), cuts as (
  select *, cast(len(units) as bigint) as n, least(c[1] % (len(units) + 1), c[2] % (len(units) + 1)) as low,
         greatest(c[1] % (len(units) + 1), c[2] % (len(units) + 1)) as high
  from u
), pieces as (
  select doc_id, text, n, c, coalesce(array_to_string(units[1:low], ''), '') as prefix,
         coalesce(array_to_string(units[low + 1:high], ''), '') as middle,
         coalesce(array_to_string(units[high + 1:], ''), '') as suffix,
         case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c[3] % 100 >= 50 then 'plain'
              when c[4] % 100 < 80 then 'spm' else 'psm' end as form
  from cuts
)
select doc_id, n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from pieces
"""
