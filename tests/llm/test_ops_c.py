"""Near duplicates and repeated byte strings: brute force, edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from weaksift.llm import graph, near, suffix

DOCS = "doc_id long, text string, lang string, id long, key string, component long, _row long"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, "k", 2, 3) for r in rows], DOCS)


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def plain_near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for w in s:
            for j in at[w]:
                seen[j] += 1
            at[w].append(i)
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), least, least == d))
    return out


def near_result(spark, frame):
    return sorted((tuple(r) for r in near.near_duplicates(frame).collect()), key=repr)


def test_components(spark):
    rnd = random.Random(6)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near_to = defaultdict(set)
    for a, b in links:
        near_to[a].add(b)
        near_to[b].add(a)
    for start in near_to:
        seen, todo = {start}, [start]
        while todo:
            for y in near_to[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if len(seen) > 1:
            assert got[start] == min(seen)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk,minor", [(1 << 21, 1 << 19), (600, 200)])
def test_near_brute_force(spark, monkeypatch, chunk, minor):
    monkeypatch.setattr(near, "CHUNK", chunk)
    monkeypatch.setattr(near, "MINOR", minor)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([6, 20, 80, 200]))]
        for _ in range(rnd.choice([1, 4, 40])):
            own = [rnd.choice(words) if rnd.random() < rnd.choice([0, 0.02, 0.05, 0.1]) else w for w in text]
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "One"), (9004, "one "), (None, "one"), (9005, "a b"), (9006, "A\nB"), (9007, "a b c"), (9007, "a b c"), (None, "x y"), (9008, "É é"), (9009, "é é"), (9010, "q r s t " * 20_000)]
    assert near_result(spark, frame_of(spark, rows)) == sorted(plain_near(rows), key=repr)
    assert near.near_duplicates(frame_of(spark, [])).count() == 0


@pytest.mark.parametrize("n,m", [(1000, 1000), (1000, 850), (50, 45)])
def test_near_refuses_less_than_the_bands(n, m):
    """By an exact sum over the registers that are equal, larger and smaller, at the threshold."""
    k = len(near.FACTOR)
    equal, more = np.array([(e, g) for e in range(k + 1) for g in range(k + 1 - e)]).T
    counts = np.stack([equal, more, k - equal - more])
    shared = 0.8 * (n + m) / 1.8
    chance = np.array([0.8, (n - shared) / (n + m - shared), (m - shared) / (n + m - shared)])
    factorials = np.concatenate(([0], np.cumsum(np.log(np.arange(1, k + 1)))))
    log = factorials[k] - factorials[counts].sum(axis=0) + (counts * np.log(chance)[:, None]).sum(axis=0)
    refused = ~near.likely(equal, more, np.full(len(equal), n), np.full(len(equal), m))
    assert np.exp(log[refused]).sum() < (1 - 0.8**near.ROWS) ** near.BANDS


def test_near_stage_repeated_and_null_ids(spark):
    """Of a group's rows one stays: the first with the smallest id, a null id only if there is no other."""
    texts = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcd"}
    near_ = {x: t + " end" for x, t in texts.items()}
    rows = [(7, texts["a"]), (7, near_["a"]), (9, texts["a"]), (None, texts["b"]), (None, near_["b"]), (None, texts["c"]), (4, near_["c"]), (4, texts["c"])]
    rows += [(5, texts["d"]), (None, None), (None, ""), (5, " ")]
    left = near.near_stage(frame_of(spark, rows).coalesce(1))
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert got == sorted([rows[0], rows[3], rows[6], *rows[8:]], key=repr)


def test_near_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert near_result(spark, table) == sorted(plain_near(rows), key=repr)
    left = near.near_stage(table.withColumn("_row", F.lit(1)), 2).drop("_row")
    assert left.columns == table.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _, _, kept in plain_near(rows) if kept)


def plain_repeats(rows, length):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rnd = random.Random(8)
    for _ in range(300):
        k = rnd.choice([1, 2, 3, 20])
        s = [rnd.randint(0, k) for _ in range(rnd.randint(1, 60))]
        expected = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix.suffix_array(np.array(s, np.int16), k + 1).tolist() == expected
        assert suffix.suffix_array(np.array(s, np.int64), suffix.BUCKETS + 1).tolist() == expected
    for text in (b"a" * 500, b"ab" * 300, b"ba" * 300 + b"b"):
        s = np.frombuffer(text, np.uint8).astype(np.int16)
        assert suffix.suffix_array(s, 256).tolist() == sorted(range(len(s)), key=lambda i: text[i:])


@pytest.mark.parametrize("shard,hot", [(1 << 21, 12_000), (40, 12_000), (60, 2)])
def test_repeats_brute_force(spark, shard, hot):
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abé ") for _ in range(rnd.choice([10, 14, 30, 60]))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choice("cdefgh") for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "z" * 300), (203, "z" * 13), (None, "short"), (None, rows[5][1]), (204, rows[5][1]), (204, rows[5][1]), (205, "xy" * 4000), (206, "q" * 15)]
    got = suffix.remove_repeats(frame_of(spark, rows), length=16, anchor=8, shard=shard, hot=hot).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_repeats(rows, 16), key=repr)


def test_repeats_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in suffix.suffix_query(table).collect()) == sorted(plain_repeats(rows, 200))
    assert suffix.suffix_query(table.limit(0)).count() == 0
