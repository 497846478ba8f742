"""The stages one after the other against brute-force versions of each."""

from __future__ import annotations

import math
import re
from collections import Counter

import corpus_pipeline
from test_ops_a import lower, plain_targets

from weaksift.llm import mixing, packing
from weaksift.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(mixing.WORD, text or "")


def five(text):
    """Stands for the text's five-word shingles as two-word ones of a new text."""
    own = words(lower(text))
    return [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    frames = {"": docs.toPandas()}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == COLUMNS
        frames[name] = docs.toPandas()

    raw, known = frames[""], frames["language_id"]
    assert set(known["doc_id"]) == {i for i, t in zip(raw["doc_id"], raw["text"]) if t and any(c.isalpha() for c in t)}
    top = {}
    for i, t in zip(known["doc_id"], known["text"]):
        top[lower(t)] = max(i, top.get(lower(t), i))
    exact = frames["exact_dedup"]
    assert set(exact["doc_id"]) == set(top.values()) and len(exact) == len(top)

    sets = [frozenset(five(t)) for t in exact["text"]]
    ids = exact["doc_id"].tolist()
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    near = frames["near_dedup"]
    assert sorted(near["doc_id"]) == sorted(i for i in ids if find(i) == i)

    sizes = Counter()
    for s, t in zip(near["source"], near["text"]):
        sizes[s] += len(words(t))
    mixed = frames["mixing"]
    got = Counter()
    for s, t in zip(mixed["source"], mixed["text"]):
        got[s] += len(words(t))
    for s, target in plain_targets(sizes).items():
        assert abs(got[s] - target) <= 1
    whole = dict(zip(near["doc_id"], near["text"]))
    assert all(whole[i].startswith(t) for i, t in zip(mixed["doc_id"], mixed["text"]))
    assert max(Counter(mixed["doc_id"]).values()) <= 2

    packed = frames["packing"]
    assert Counter(packed[packed["piece"] == 0]["doc_id"]) == Counter(mixed["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert packed["sequence_id"].nunique() <= 1.02 * math.ceil(packed["length"].sum() / packing.CAPACITY) + 1


def test_pipeline_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


