"""Packing documents into sequences: dominance reduction, then best fit."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import ranked, stage

CAPACITY = 4096  # tokens of a sequence
END = 1  # id after each document
KNOWN = 400_000  # words whose ids a worker remembers at most, and half as many parts of words
TOGETHER = 1 << 22  # bytes of text whose words are made distinct together
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Token ids of texts as little-endian bytes. The tokenizer drops white space and looks at no context across it,
    so the ids of a text are those of its words one after the other, and a word needs to be encoded once only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @staticmethod
    def _split(word: str) -> list[str]:
        """A word as parts that the tokenizer takes one by one: runs of letters, digits, runs of marks. Words with
        letters it may change or with its contractions stay whole."""
        if word.isascii():
            word = word.lower()
        elif max(word) >= PLAIN_END or "\u0130" in word:
            return [word]
        return [word] if word.isalpha() or "'" in word else PARTS.findall(word)

    def _part(self, part: str) -> bytes:
        """The ids of a part. Runs of plain letters go to the tokenizer's model at once, in lower case and as the
        characters that stand for their bytes; normalising and splitting would leave them as they are."""
        ids = self.parts.get(part)
        if ids is None:
            if part.isalpha() and max(part) < PLAIN_END and "\u0130" not in part:
                text = part.lower()
                text = text if text.isascii() else "".join(map(BYTE_CHARACTERS.__getitem__, text.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            else:
                ids = self._ids(part).tobytes()
            self.parts[part] = ids
        return ids

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from memory where they are known."""
        if len(self.words) > KNOWN:
            self.words = {"": b""}
        if len(self.parts) > KNOWN // 2:
            self.parts = {}
        known, part = self.words, self._part
        found = list(map(known.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                own = word.lower() if word.isascii() else word
                if own.isalpha():
                    ids = part(own)
                elif own[-1] in ".," and own[:-1].isalpha() and own.isascii():
                    ids = part(own[:-1]) + part(own[-1])
                else:
                    ids = b"".join(map(part, self._split(word)))
                found[i] = known[word] = ids
        return found

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text. Words are split and made distinct by Arrow and put together again by their places."""
        whole = pc.match_substring(texts, "<|").to_pylist()  # marks of special tokens: not taken word by word
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        distinct = lists.flatten().dictionary_encode()
        ids = self._word_ids(distinct.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        word = distinct.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(size[word])))
        place = np.repeat((np.cumsum(size) - size)[word] - ends[:-1], size[word]) + np.arange(ends[-1])
        flat = table[place]
        stops = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))].tolist()
        for i, (a, b) in enumerate(zip(stops, stops[1:])):
            yield self._ids(texts[i].as_py()).tobytes() if whole[i] else flat[a:b].tobytes()


LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # those before PLAIN_END
DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PARTS = re.compile(f"[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
# The characters that byte-level tokenizers write bytes as: printable ones themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_CHARACTERS = [chr(b if b in _PRINTABLE else 256 + _OTHERS.index(b)) for b in range(256)]
PLAIN_END = "\u0250"  # letters before it stay single letters in the tokenizer's normal form, but for one
_encoders: dict[str, Encoder] = {}


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of about ``TOGETHER`` bytes."""
    run = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cut, cut[1:]) if b > a)


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which keeps what it has learned from task to task. (A function of the module: what a
    function made for a task refers to is sent along with it, so it would start anew each time.)"""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = END.to_bytes(4, "little")
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            at, piece, start, length, crc = [], [], [], [], []
            slices = (encoder.encode(part) for part in _slices(texts))
            for i, ids in enumerate(chain.from_iterable(slices)):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return work


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than a
    sequence. Null is the empty text, which is the end id alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), schema)


def reduce_instance(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Martello and Toth's reduction on lengths with counts, which it lowers. Returns fixed sets (number of sequences,
    [(length, times)]).

    A set with the item j dominates all others with j if its other items can stand in for theirs: j alone if nothing
    fits with it; j with an item that fills the rest; j with the longest item that fits, if no three items with j fit
    and no two that fit are longer together than that one. Longest items come first; what is fixed leaves the instance.
    """
    fixed = []
    present = sorted(count)
    for length in sorted(count, reverse=True):
        while count.get(length):
            room = capacity - length
            own, times = count[length], None
            if own == 1:  # j itself is no partner
                del present[bisect_left(present, length)]
            at = bisect_right(present, room) - 1
            partner = present[at] if at >= 0 else 0
            if partner and partner != room:
                few = np.array(present[: at + 1])
                two = few + few[np.maximum(np.searchsorted(few, room - few, side="right") - 1, 0)]
                if 3 * present[0] <= room or (two[two <= room] > partner).any():
                    partner = None  # nothing dominates
            if own == 1:
                insort(present, length)
            if partner is None:
                break
            if not partner:
                times, items = own, [(length, 1)]
            elif partner == length:
                times, items = own // 2, [(length, 2)]
            else:
                times, items = min(own, count[partner]), [(length, 1), (partner, 1)]
            fixed.append((times, items))
            for item, n in items:
                count[item] -= times * n
                if not count[item]:
                    del count[item], present[bisect_left(present, item)]
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of lengths with counts, longest first: each item goes to the fullest sequence that has room. Items of
    a length and sequences of a kind are handled together, so the work depends on the lengths, not on the items."""
    open_rooms: list[int] = []
    kinds: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def add(room: int, times: int, items: list[tuple[int, int]]) -> None:
        if times:
            if room not in kinds:
                insort(open_rooms, room)
                kinds[room] = []
            kinds[room].append((times, items))

    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                each = capacity // length
                add(capacity - each * length, left // each, [(length, each)])
                if left % each:
                    add(capacity - (left % each) * length, 1, [(length, left % each)])
                break
            room = open_rooms[at]
            times, items = kinds[room].pop()
            if not kinds[room]:
                del kinds[room], open_rooms[at]
            each = room // length
            full = min(times, left // each)
            add(room - each * length, full, [*items, (length, each)])
            left -= full * each
            times -= full
            if times and left:
                add(room - left * length, 1, [*items, (length, left)])
                times, left = times - 1, 0
            add(room, times, items)
    return [kind for room in kinds.values() for kind in room]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the items of each length go: the items ranked from ``first`` on, ``each`` to a sequence from ``sequence``
    on, at ``offset``. Its rows depend on the number of different lengths, ``capacity`` at most."""
    count = {int(k): int(v) for k, v in histogram.items()}
    kinds = reduce_instance(count, capacity) + best_fit(count, capacity)
    rows, sequence, ranks = [], 0, dict.fromkeys(histogram, 0)
    for times, items in kinds:
        offset = 0
        for length, each in items:
            rows.append((length, ranks[length], each, sequence, offset))
            ranks[length] += times * each
            offset += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; a stage) with sequence_id and offset.

    The packing depends on the lengths alone: their histogram (``capacity`` rows at most) is solved on the driver, and
    the plan says for the r-th piece of a length where it goes. Pieces are ranked per length by a range-partitioned
    sort, so a length may hold any number of them.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = plan(histogram, capacity)
    by_length = {k: tuple(g[c].to_numpy(np.int64) for c in ("first", "each", "sequence", "offset")) for k, g in where.groupby("length")}
    order = [F.asc_nulls_last("doc_id"), F.asc("piece"), F.asc("ids_crc32")]
    placed = ranked(pieces, "length", order, "length", "pieces-ranked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            ranks = batch.column(5).to_numpy() - 1
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first, each, begin, at = by_length[length]
                slot = np.searchsorted(first, ranks[own], side="right") - 1
                inside = ranks[own] - first[slot]
                sequence[own] = begin[slot] + inside // each[slot]
                offset[own] = at[slot] + inside % each[slot] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    fields = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return placed.select(*columns, "_rank").mapInArrow(work, f"{fields}, sequence_id long, offset long")


def packing_query(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and offset. Null texts are empty, repeated rows and null ids
    are packed as rows of their own, an empty table gives an empty result, other columns are ignored."""
    return pack(stage(token_pieces(docs, path, capacity), "pieces"), capacity)
