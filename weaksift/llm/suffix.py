"""Removal of repeated byte strings with suffix arrays over shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.llm.common import numbered, stage

LENGTH = 200  # bytes of a repeated string
ANCHOR = 64  # bytes of an anchor
SHARD = 1 << 21  # bytes that share a suffix array, but for one anchor's strings, which stay together
HOT = 12_000  # strings of one anchor beyond which their windows are dealt out one by one
BUCKETS = 4096  # symbols up to which a reduced string is sorted by induction


def gram_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a power of two) from each position on."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        step, factor = 1, 0xD6E8FEB86659FD93
        while step < size:
            h = h[:-step] * np.uint64(factor) + h[step:]
            h ^= h >> np.uint64(32)
            factor = (factor * 0xBF58476D1CE4E5B9 + 2) % (1 << 64) | 1
            step *= 2
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` positions, the position of its least hash (by the upper 32 bits, leftmost)."""
    n = len(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    full[:n] = key
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


# ---- suffix arrays: induced sorting -------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last is not)."""
    n = len(s)
    up = np.zeros(n, dtype=bool)
    if n > 1:
        differs = np.flatnonzero(s[1:] != s[:-1])
        if len(differs):
            at = np.searchsorted(differs, np.arange(differs[-1] + 1))
            nxt = differs[at]
            up[: differs[-1] + 1] = s[nxt] < s[nxt + 1]
    return up


def _deal(sa: np.ndarray, s: np.ndarray, rows: np.ndarray, heads: np.ndarray, down: bool) -> None:
    """Puts suffixes, in order, at the growing ends of their buckets."""
    if not len(rows):
        return
    symbols = s[rows]
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(first, len(ordered)))
    inside = np.arange(len(ordered)) - np.repeat(first, size)
    own = ordered[first]
    place = np.repeat(heads[own], size)
    sa[place - 1 - inside if down else place + inside] = rows[order]
    heads[own] += -size if down else size


def _induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, starts: np.ndarray, counts_up: np.ndarray) -> np.ndarray:
    """The suffix array induced from the leftmost-smaller suffixes in ``lms`` order: bucket by bucket from the left for
    the larger suffixes, then from the right for the smaller ones, each bucket in as few vector steps as it has runs."""
    n, k = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int32)
    tails = starts[1:].copy()
    _deal(sa, s, lms[::-1], tails, True)
    heads = starts[:-1].copy()
    last = np.array([n - 1], dtype=lms.dtype)
    _deal(sa, s, last, heads, False)
    present = np.flatnonzero(starts[1:] > starts[:-1])
    for c in present:
        lo = starts[c]
        while lo < heads[c]:
            own, lo = sa[lo : heads[c]], heads[c]
            own = own[own > 0] - 1
            _deal(sa, s, own[~up[own]], heads, False)
        if counts_up[c]:
            own = sa[starts[c + 1] - counts_up[c] : starts[c + 1]]
            own = own[own > 0] - 1
            _deal(sa, s, own[~up[own]], heads, False)
    tails = starts[1:].copy()
    for c in present[::-1]:
        hi = starts[c + 1]
        while hi > tails[c]:
            own, hi = sa[tails[c] : hi][::-1], tails[c]
            own = own[own > 0] - 1
            _deal(sa, s, own[up[own]], tails, True)
        own = sa[starts[c] : starts[c + 1] - counts_up[c]][::-1]
        own = own[own > 0] - 1
        _deal(sa, s, own[up[own]], tails, True)
    return sa


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of many symbols: ranks of twice as many symbols in each round."""
    n, step = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        key = (rank + 1) << 32
        key[:-step or None] |= rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of whole numbers below ``symbols`` by induced sorting. Leftmost-smaller substrings are sorted by
    induction and named; the string of their names is sorted the same way where it has few symbols, else (its buckets
    would hold a suffix or two) by doubling; their order induces the rest."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    if symbols > BUCKETS:
        return _doubling(s)
    up = _types(s)
    counts = np.bincount(s, minlength=symbols)
    starts = np.concatenate(([0], np.cumsum(counts)))
    counts_up = np.bincount(s[up], minlength=symbols)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if not len(lms):
        return _induce(s, up, lms.astype(np.int64), starts, counts_up)
    sa = _induce(s, up, lms, starts, counts_up)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]].astype(np.int64)
    ends = np.append(lms[1:], n - 1)  # of each substring, inclusive
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    size = (ends - lms)[number[ordered]]
    same = size[1:] == size[:-1]
    same &= (ordered[1:] + size[1:] < n - 1) & (ordered[:-1] + size[:-1] < n - 1)
    left = np.flatnonzero(same)
    t = 0
    while len(left):
        a, b = ordered[left], ordered[left + 1]
        equal = (s[a + t] == s[b + t]) & (up[a + t] == up[b + t])
        same[left[~equal]] = False
        left = left[equal & (size[left] > t)]
        t += 1
    names = np.concatenate(([0], np.cumsum(~same)))
    reduced = np.empty(len(lms), np.int64)
    reduced[number[ordered]] = names
    if names[-1] + 1 < len(lms):
        ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _induce(s, up, ordered, starts, counts_up)


def common_prefixes(s: np.ndarray, sa: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, what its suffix shares with the one before it in ``sa``, within
    their strings. A string's positions are taken in order, as the value drops by one at most from each to the next;
    all strings take their steps together."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    stop = np.empty(n, np.int64)
    stop[:] = np.repeat(ends, np.diff(np.append(begins, n)))
    out = np.zeros(n, np.int32)
    at, most, shared = begins.astype(np.int64), ends, np.zeros(len(begins), np.int64)
    while len(at):
        other = before[at]
        i, j = at + shared, other + shared
        fits = (other >= 0) & (i < most) & (j < stop[other])
        grows = fits & (s[np.minimum(i, n - 1)] == s[np.minimum(j, n - 1)])
        done = ~grows
        out[at[done]] = shared[done]
        shared = np.where(grows, shared + 1, np.maximum(shared - 1, 0))
        at = at + done
        going = at < most
        if not going.all():
            at, most, shared = at[going], most[going], shared[going]
    return out


def repeated_starts(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, the positions whose ``length`` bytes start anywhere else in the strings too."""
    joined = b"\0".join(strings) + b"\0"
    s = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ends = begins + size
    s[ends] = 0  # between strings, smaller than any byte
    sa = suffix_array(s, 257)
    shared = common_prefixes(s, sa, begins, ends)
    twice = shared >= length
    before = np.full(len(s), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    twice[before[np.flatnonzero(twice)]] = True
    return [np.flatnonzero(twice[b:e]) for b, e in zip(begins, ends)]


# ---- the operator -------------------------------------------------------------------------------------------------


def _runs(length: int, anchor: int):
    """Runs of windows with one anchor: _row, start, windows, the anchor's hash and a hash of all the run's bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, grams, kinds = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                if len(data) < length:
                    continue
                h = gram_hashes(np.frombuffer(data, np.uint8), anchor)
                at = window_anchors(h, length - anchor + 1)
                cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                stop = np.append(cut[1:], len(at))
                rows.append(np.full(len(cut), row, np.int64))
                starts.append(cut)
                sizes.append(stop - cut)
                grams.append(h[at[cut]])
                kinds += [xxhash.xxh3_64_intdigest(data[a : b - 1 + length]) for a, b in zip(cut.tolist(), stop.tolist())]
            if rows:
                columns = [*map(np.concatenate, (rows, starts, sizes)), np.concatenate(grams).view(np.int64), np.array(kinds, np.uint64).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_row", "start", "windows", "gram", "kind"])

    return work


def _slices(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                out = []
                for row, text, wanted in zip(some.column(0).to_pylist(), some.column(1), some.column(2).to_pylist()):
                    data = text.as_buffer().to_pybytes()
                    out += [(w["gram"], w["hot"], w["n"], row, w["start"], data[w["start"] : w["start"] + w["windows"] - 1 + length]) for w in wanted]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["gram", "hot", "n", "_row", "start", "data"])

    return work


def _spans(found: list[tuple[int, int, np.ndarray]], length: int) -> pa.RecordBatch:
    """Covered bytes of the positions found in strings (_row, start, positions)."""
    rows, lows, highs = [], [], []
    for row, start, at in found:
        if len(at):
            cut = np.flatnonzero(np.concatenate(([True], np.diff(at) > length)))
            lows.append(at[cut] + start)
            highs.append(at[np.append(cut[1:] - 1, len(at) - 1)] + start + length)
            rows.append(np.full(len(cut), row, np.int64))
    columns = [np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64) for c in (rows, lows, highs)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_row", "low", "high"])


def _sharded(length: int, shard: int):
    """Strings sorted by anchor, gathered into shards that no anchor is split over."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, bytes]] = []
        size, gram = 0, None

        def solve() -> pa.RecordBatch:
            found = repeated_starts([h[3] for h in held], length)
            out = _spans([(h[0], h[1], f) for h, f in zip(held, found) if h[2]], length)
            held.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if row["gram"] != gram and size >= shard:
                    yield solve()
                    size = 0
                gram = row["gram"]
                held.append((row["_row"], row["start"], row["n"] == 1, row["data"]))
                size += len(row["data"])
        if held:
            yield solve()

    return work


def _windows(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows, at, high, low, n = [], [], [], [], []
                for r in batch.slice(lo, 256).to_pylist():
                    for i in range(len(r["data"]) - length + 1):
                        digest = xxhash.xxh3_128_intdigest(r["data"][i : i + length])
                        rows.append(r["_row"])
                        at.append(r["start"] + i)
                        high.append((digest >> 64) - (1 << 63))
                        low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                        n.append(r["n"])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows, at, high, low, n)], names=["_row", "low", "w1", "w2", "n"])

    return work


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """_row, low, high: byte ranges of ``texts`` (_row, text; a stage) covered by strings of ``length`` bytes that start
    more than once anywhere.

    Every window of ``length`` bytes has an anchor, its part of ``anchor`` bytes with the least hash, so equal windows
    have equal anchors. Windows in a row with one anchor are a run. A run whose anchor occurs once has no repeats. A run
    whose bytes occur more than once is covered as a whole. The other runs of repeated anchors go, one of each kind, to
    shards by anchor, and each shard finds what repeats by its suffix array. An anchor with more than ``hot`` kinds of
    runs would make too large a shard; the windows of these are counted one by one.
    """
    spark_runs = "_row long, start long, windows long, gram long, kind long"
    runs = stage(texts.select("_row", "text").mapInArrow(_runs(length, anchor), spark_runs), "runs")
    twice = runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    runs = stage(runs.join(stage(twice, "anchors"), "gram"), "repeated-runs")
    kinds = runs.groupBy("gram", "kind").agg(
        F.count("*").alias("n"), F.max("windows").alias("windows"), F.max(F.struct("_row", "start")).alias("one")
    )
    kinds = stage(kinds.select("gram", "kind", "n", "windows", "one._row", "one.start"), "kinds")
    whole = runs.join(kinds.where("n > 1").select("gram", "kind"), ["gram", "kind"])
    whole = whole.select("_row", F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1 + length).alias("high"))

    mixed = kinds.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1")
    mixed = stage(mixed.select("gram", (F.col("d") > hot).alias("hot")), "mixed")
    asked = kinds.join(mixed, "gram").groupBy("_row").agg(F.collect_list(F.struct("gram", "hot", "n", "start", "windows")).alias("wanted"))
    cut = texts.select("_row", F.col("text").cast("binary").alias("text")).join(stage(asked, "asked"), "_row").select("_row", "text", "wanted")
    strings = stage(cut.mapInArrow(_slices(length), "gram long, hot boolean, n long, _row long, start long, data binary"), "strings")
    cool = strings.where("not hot").repartition("gram").sortWithinPartitions("gram")
    found = cool.mapInArrow(_sharded(length, shard), "_row long, low long, high long")
    windows = strings.where("hot").mapInArrow(_windows(length), "_row long, low long, w1 long, w2 long, n long")
    many = windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1")
    dealt = windows.where("n = 1").join(many, ["w1", "w2"]).select("_row", "low", (F.col("low") + length).alias("high"))
    return whole.unionByName(found).unionByName(dealt)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, spans, digest, kept = [], [], [], [], []
        for text, low, high in zip(batch.column(1), batch.column(2), batch.column(3)):
            data = text.as_buffer().to_pybytes()
            size.append(len(data))
            if low.is_valid:
                order = np.argsort(low.values.to_numpy(), kind="stable")
                lows = low.values.to_numpy()[order]
                tops = np.maximum.accumulate(high.values.to_numpy()[order])
                cut = np.flatnonzero(np.concatenate(([True], lows[1:] > tops[:-1])))
                begin, end = lows[cut], tops[np.append(cut[1:] - 1, len(tops) - 1)]
                data = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
            else:
                begin = end = np.empty(0, np.int64)
            gone.append(int((end - begin).sum()))
            spans.append(len(begin))
            digest.append(hashlib.sha256(data).hexdigest())
            kept.append(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in (size, gone, spans)], pa.array(digest), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for every row.

    Each byte covered by a string of ``length`` bytes that also starts elsewhere, in any row, is removed; strings are
    those of the input, and overlaps count. Null is the empty text; repeated rows are covered as far as they are long
    enough; null ids are rows like others; very long texts are cut by windows, never as a whole; an empty table gives an
    empty result; other columns are ignored.
    """
    texts = numbered(docs, [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")], "bytes")
    spans = stage(repeated_spans(texts, length, anchor, shard, hot), "spans")
    per_row = spans.groupBy("_row").agg(F.collect_list(F.struct("low", "high")).alias("s"))
    per_row = per_row.select("_row", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    rows = texts.select("_row", "doc_id", F.col("text").cast("binary").alias("text")).join(per_row, "_row", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.select("doc_id", "text", "low", "high").mapInArrow(_removed, schema)


def suffix_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
