"""Token ids in binary files: one id array per file, document boundaries and ids by Elias-Fano codes.

A file is ``ids | boundaries | document ids | footer``. The ids are little-endian, two bytes each where the vocabulary
allows it. The boundaries (the ends of the documents in the array) and the document ids, both ascending, are kept as
Elias and Fano wrote them: the low bits of each value as they are, the rest in unary as a bit vector in which every
256th one's place is noted, so that the i-th value is found by reading a short slice (``select``). That is about two
bits and the low bits a document. The footer says where everything is, so a file is written in one go and opened by
its last bytes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.llm.common import stage, text_runs
from weaksift.llm.packing import BYTE_CHARACTERS, DIGITS, LETTERS, PLAIN_END
from weaksift.plans.stages import new_path

VOCABULARY = "byte_bpe_50k.json"
END = 0  # id after each document
KNOWN = 500_000  # units whose ids a worker remembers at most twice over, and half as many words
FILE_TOKENS = 1 << 26  # a file is closed beyond so many ids
FILE_DOCS = 1 << 18  # or so many documents
READ_DOCS = 4_096  # documents whose boundaries are read together
READ_TOKENS = 1 << 22  # ids read together
EVERY = 256  # ones of the bit vector from one noted place to the next
MAGIC = b"ELFATOK1"
FOOTER = "<12Qq8s"
MANIFEST = "part int, number int, file string, docs long, tokens long"

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# White space beyond ASCII's, and the mark of special tokens: such texts are encoded whole.
WHOLE = r"<\||[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# Tokens of the tokenizer's pattern in what has no white space but a space ahead, and letters before PLAIN_END only.
PARTS = re.compile(f" ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^ {LETTERS}{DIGITS}]+")
STANDS = {i: BYTE_CHARACTERS[i] for i in range(128)}


class Encoder:
    """Token ids of texts. The tokenizer's own pattern ends a token wherever white space follows something else, and
    looks at no context across such a place; so a text's ids are those of its units (white space and what follows
    it) one after the other, and a unit needs to be encoded once only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()  # workers are little-endian machines

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """One token of the tokenizer's pattern goes to its model at once, as the characters that stand for its bytes."""
        own = word.translate(STANDS) if word.isascii() else "".join(map(BYTE_CHARACTERS.__getitem__, word.encode()))
        ids = self.words[word] = self._pack([t.id for t in self.tokenizer.model.tokenize(own)])
        return ids

    def _unit(self, unit: str) -> bytes:
        """A unit as tokens of the tokenizer's pattern: of white space the last character stands by itself, or, a space,
        goes along with what follows; then runs of letters, of digits and of marks. Units with letters beyond the plain
        ones or with an apostrophe, which may begin a contraction, are left to the tokenizer."""
        body = unit.lstrip(" \t\n\r\x0b\x0c")
        if not body or "'" in body or not body.isascii() and max(body) >= PLAIN_END:
            return self.whole(unit)
        lead = len(unit) - len(body)
        last = lead - 1 if lead else 0
        parts = [unit[:last], unit[last:lead]] if lead and unit[last] != " " else [unit[:last]]
        if lead and unit[last] == " ":
            body = " " + body
        known, out = self.words, []
        for part in (*(p for p in parts if p), *PARTS.findall(body)):
            ids = known.get(part)
            out.append(self._word(part) if ids is None else ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _unit_ids(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units. What is remembered comes in two ages: when the younger is full it becomes the older,
        and of that only what is met again stays."""
        if len(self.units) > KNOWN:
            self.older, self.units = self.units, {}
        if len(self.words) > KNOWN // 2:
            self.words = {}
        known, older = self.units, self.older
        found = list(map(known.get, units))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            unit = units[i]
            found[i] = known[unit] = older.get(unit) or self._unit(unit)
        return found

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (no nulls)."""
        whole = pc.match_substring_regex(texts, WHOLE)
        alone = whole.to_pylist()
        units = pc.if_else(whole, "", texts)
        units = pa.concat_arrays([units])  # offsets from zero
        _, offsets, data = units.buffers()
        ends = np.frombuffer(offsets, np.int32, len(units) + 1)
        size = int(ends[-1])
        stops = np.zeros(len(units) + 1, np.int64)
        flat = np.zeros(0, np.uint8)
        if size:
            white = WHITE[np.frombuffer(data, np.uint8, size)]
            begin = np.zeros(size, dtype=bool)
            begin[1:] = white[1:] & ~white[:-1]
            begin[ends[:-1][ends[:-1] < size]] = True
            starts = np.flatnonzero(begin)
            bounds = pa.py_buffer(np.append(starts, size).astype(np.int32))
            distinct = pa.StringArray.from_buffers(len(starts), bounds, data).dictionary_encode()
            ids = self._unit_ids(distinct.dictionary.to_pylist())
            length = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            table = np.frombuffer(b"".join(ids), f"<u{self.width}")
            unit = distinct.indices.to_numpy()
            each = length[unit]
            after = np.concatenate(([0], np.cumsum(each)))
            shift = ((np.cumsum(length) - length)[unit] - after[:-1]).astype(np.int32)
            place = np.repeat(shift, each) + np.arange(after[-1], dtype=np.int32)
            flat = table[place]
            stops = after[np.searchsorted(starts, ends)]
        for i, (a, b) in enumerate(zip(stops, stops[1:])):
            yield self.whole(texts[i].as_py()) if alone[i] else flat[a:b].tobytes()


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, with what it has learned from task to task. It is kept on a module that workers import: the
    functions of this one, and what they refer to, come anew with each task."""
    import tokenizers

    return tokenizers.__dict__.setdefault("_encoders", {}).setdefault(path, None) or _learn(path)


def _learn(path: str) -> Encoder:
    import tokenizers

    tokenizers._encoders[path] = Encoder(path)
    return tokenizers._encoders[path]


class Sequence(NamedTuple):
    """Where a file keeps an ascending sequence, and in how many bits."""

    at: int
    universe: int
    low_bits: int
    upper_bytes: int


def elias_fano(values: np.ndarray, universe: int, at: int) -> tuple[Sequence, bytes]:
    """The code of ascending whole numbers from 0 to ``universe``: low bits, places of every 256th one, bit vector."""
    n = len(values)
    values = values.astype(np.uint64)
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = np.zeros((n, low_bits), np.uint8)
    for bit in range(low_bits):
        low[:, bit] = (values >> np.uint64(bit)) & np.uint64(1)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    packed = np.packbits(upper, bitorder="little")
    data = np.packbits(low.ravel(), bitorder="little").tobytes() + ones[::EVERY].astype("<u4").tobytes() + packed.tobytes()
    return Sequence(at, universe, low_bits, len(packed)), data


class Select:
    """Values of an Elias-Fano code by their numbers; ``read`` gives bytes of the file."""

    def __init__(self, read, n: int, sequence: Sequence):
        self.read, self.n = read, n
        self.at, _, self.low_bits, self.upper_bytes = sequence
        noted = self.at + -(-n * self.low_bits // 8)
        count = -(-n // EVERY)
        self.noted = np.frombuffer(read(noted, 4 * count), "<u4").astype(np.int64)
        self.upper = noted + 4 * count

    def __call__(self, first: int, last: int) -> np.ndarray:
        """The values numbered first to last (exclusive), as unsigned 64-bit numbers."""
        if last <= first:
            return np.zeros(0, np.uint64)
        block, stop = first // EVERY, -(-last // EVERY)
        begin = int(self.noted[block])
        end = int(self.noted[stop]) if stop < len(self.noted) else 8 * self.upper_bytes
        raw = np.frombuffer(self.read(self.upper + begin // 8, -(-end // 8) - begin // 8), np.uint8)
        ones = np.flatnonzero(np.unpackbits(raw, bitorder="little")) + begin // 8 * 8
        ones = ones[ones >= begin][first - block * EVERY : last - block * EVERY]
        values = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit, stop_bit = first * self.low_bits, last * self.low_bits
            raw = np.frombuffer(self.read(self.at + bit // 8, -(-stop_bit // 8) - bit // 8), np.uint8)
            bits = np.unpackbits(raw, bitorder="little")[bit % 8 :][: stop_bit - bit].reshape(-1, self.low_bits)
            for i in range(self.low_bits):
                values |= bits[:, i].astype(np.uint64) << np.uint64(i)
        return values


def _open(uri: str) -> tuple[filesystems.FileSystem, str]:
    """A file system and a path in it, of a path or URI as Spark names its folders."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return filesystems.FileSystem.from_uri(uri)


class TokenWriter:
    """One file, written front to back: ids as they come, the rest at the end."""

    def __init__(self, uri: str, width: int):
        system, path = _open(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.width, self.out = uri, width, system.open_output_stream(path)
        self.ends: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.docs = self.tokens = self.nulls = 0

    def add(self, doc_ids: pa.Array, ids: pa.Array) -> None:
        """Rows in ascending order of their ids, null last; both go on from call to call."""
        lengths = pc.binary_length(ids).to_numpy().astype(np.int64) // self.width
        self.ends.append(self.tokens + np.cumsum(lengths))
        self.ids.append(doc_ids.drop_null().to_numpy().astype(np.int64))
        self.docs += len(ids)
        self.nulls += doc_ids.null_count
        self.tokens += int(lengths.sum())
        for value in ids:
            self.out.write(value.as_buffer())

    def close(self) -> None:
        known = np.concatenate(self.ids)
        least = int(known[0]) if len(known) else 0
        at = self.tokens * self.width
        ends, data = elias_fano(np.concatenate(self.ends), self.tokens, at)
        # Differences of 64-bit numbers need 64 bits without a sign.
        above = known.view(np.uint64) - np.array(least, np.int64).view(np.uint64)
        ids, more = elias_fano(above, int(above[-1]) if len(above) else 0, at + len(data))
        self.out.write(data + more)
        self.out.write(struct.pack(FOOTER, self.width, self.docs, self.tokens, self.nulls, *ends, *ids, least, MAGIC))
        self.out.close()


class TokenReader:
    """One file, opened by its footer; any document is read by itself."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        footer = struct.unpack(FOOTER, self._read(self.file.size() - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if footer[-1] != MAGIC:
            raise ValueError(f"{uri} is no file of tokens")
        self.width, self.docs, self.tokens, nulls = footer[:4]
        self.least = footer[12]
        self.known = self.docs - nulls
        self.ends = Select(self._read, self.docs, Sequence(*footer[4:8]))
        self.doc_ids = Select(self._read, self.known, Sequence(*footer[8:12]))

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where the documents numbered first to last (exclusive) begin, and where the last one ends."""
        before = self.ends(first - 1, first) if first else np.zeros(1, np.uint64)
        return np.concatenate((before, self.ends(first, last))).astype(np.int64)

    def ids_of(self, first: int, last: int) -> pa.Array:
        """The ids of these documents, null where they had none."""
        most = min(last, self.known)
        above = self.doc_ids(first, most)
        own = (above + np.array(self.least, np.int64).view(np.uint64)).view(np.int64)
        return pa.concat_arrays([pa.array(own), pa.nulls(last - max(first, most), pa.int64())])

    def tokens_at(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def document(self, number: int) -> np.ndarray:
        """The token ids of one document, its end id included."""
        return self.tokens_at(*self.bounds(number, number + 1).tolist())

    def close(self) -> None:
        self.file.close()


def _write(path: str, end: int, folder: str, most_tokens: int, most_docs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, encoder = TaskContext.get().partitionId(), 0, None, encoder_of(path)
        last = end.to_bytes(encoder.width, "little")

        def closed() -> pa.RecordBatch:
            writer.close()
            row = [part, number, writer.uri, writer.docs, writer.tokens]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["part", "number", "file", "docs", "tokens"])

        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                if writer is None:
                    # A name of its own for each try: a file counts only if the manifest of the finished job names it.
                    writer = TokenWriter(f"{folder}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.tokens", encoder.width)
                texts = batch.column(1).slice(a, b - a)
                writer.add(batch.column(0).slice(a, b - a), pa.array([x + last for x in encoder.encode(texts)], pa.binary()))
                if writer.tokens >= most_tokens or writer.docs >= most_docs:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    return work


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end: int = END, most_tokens: int = FILE_TOKENS, most_docs: int = FILE_DOCS
) -> DataFrame:
    """Encodes every text and writes the ids in ascending doc_id order, null last, to files in ``folder`` (shared by all
    machines). Returns the manifest: part, number (the files' order), file, docs, tokens, and tokens_before.

    The order is a range partitioning of id, hash of the text and row, so rows of one id (or of none) spread over tasks
    however many they are, and only equal texts can change places from run to run. Behind it a text is encoded and
    written as it comes. A null text is empty and gives the end id alone; repeated rows are rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id().alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), row, text.alias("text"))
    keys = [F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    manifest = stage(ordered.mapInArrow(_write(path, end, folder, most_tokens, most_docs), MANIFEST), "manifest")
    before = F.sum("tokens").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    return manifest.withColumn("tokens_before", F.coalesce(before, F.lit(0)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = TokenReader(name)
            for first in range(0, reader.docs, READ_DOCS):
                last = min(first + READ_DOCS, reader.docs)
                bounds = reader.bounds(first, last)
                crcs = _crcs(reader, bounds)
                columns = [reader.ids_of(first, last), bounds[:-1] + before, np.diff(bounds), np.array(crcs, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            reader.close()


def _crcs(reader: TokenReader, bounds: np.ndarray) -> list[int]:
    """The check sum of each document's ids as 32-bit numbers. Ids are read in runs of documents, a very long
    document in parts."""
    out, at, held_from, held = [], bounds.tolist(), 0, np.zeros(0, "<u4")
    for start, end in zip(at, at[1:]):
        crc = 0
        while start < end:
            if not held_from <= start < held_from + len(held):
                held_from = start
                held = reader.tokens_at(start, min(start + READ_TOKENS, at[-1])).astype("<u4")
            stop = min(end, held_from + len(held))
            crc = zlib.crc32(held[start - held_from : stop - held_from].data, crc)
            start = stop
        out.append(crc)
    return out


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read from the files that
    the manifest names. One task per file or few."""
    files = max(1, manifest.count())
    rows = manifest.select("part", "number", "file", "tokens_before").repartitionByRange(files, "part", "number")
    return rows.select("file", "tokens_before").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every document with its place and check sum, from files written for it. Null texts are empty, repeated rows and null
    ids are documents of their own, an empty table writes no file and gives an empty result, other columns are ignored."""
    folder = new_path(docs.sparkSession, "token-files")
    return read_token_files(stage(write_token_files(docs, folder, path), "files"))
