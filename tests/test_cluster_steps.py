"""What the steps of the clusters send and write: rounds of a forest, rings to visit, terms of clusters."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weaksift.operators import clusters as C
from weaksift.operators import forest as G
from weaksift.operators import similarity as S
from weaksift.plans.stages import stage


def test_what_few_edges_the_rounds_leave_is_one_task(spark, monkeypatch):
    """A round that leaves few edges is the last, and the forest weighs what that of one task weighs."""
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 300, 900), rng.integers(0, 300, 900), rng.integers(1, 40, 900) / 40)]
    frame = spark.createDataFrame(edges, G.FOREST_SCHEMA)
    names = []
    monkeypatch.setattr(G, "stage", lambda df, name: names.append(name) or stage(df, name))
    whole = G.spanning_forest(frame, 2_000).toPandas()
    assert "chosen" not in names
    part = G.spanning_forest(frame, 600).toPandas()
    assert names.count("chosen") == 1
    assert len(part) == len(whole) and np.isclose(part.w.sum(), whole.w.sum())


def test_rings_that_leave_no_room_are_not_visited():
    """Against the angles and levels of every row and ring, one by one."""
    rng = np.random.default_rng(9)
    steps = np.array([0.5, 0.8, 0.9])
    matrix = rng.random((30, 6)) ** 2
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    pivots = matrix[:8]
    sims = S.rounded(matrix, pivots)
    best, near = sims.argmax(axis=1), sims.max(axis=1)
    joined = np.stack([np.zeros(8, int), np.arange(8) // 4 * 4, np.arange(8)])
    own = SimpleNamespace(ids=np.arange(8), matrix=pivots, joined=joined, cell=best, low=S._angles(near), high=S._angles(near))
    found = S._needed(pd.DataFrame({"cell": best, "near": near, "vector": list(matrix)}), own, steps)
    for i in range(30):
        for j in range(30):
            gap = max(0.0, abs(S._angles(sims[i, best[j]]) - S._angles(near[j])) - S.SLACK)
            levels = [k for k in range(3) if np.cos(gap) + 1e-6 >= steps[k]]
            both = [k for k in levels if near[j] + 1e-6 >= steps[k]]
            must = any(near[i] < steps[k] for k in levels) or (
                best[i] < best[j] and any(joined[k, best[i]] != joined[k, best[j]] for k in both)
            )
            assert found[i, j] == must


def test_roll_up_writes_the_tokens_of_an_item_once(spark, monkeypatch):
    """However many thresholds there are, and with repeated and null ids counted as the join of members and items has them."""
    items = spark.createDataFrame(
        [("1", "alpha beta alpha"), ("2", "beta gamma"), ("2", "delta gamma"), (None, "lost words")], "item_id string, clean_text string"
    ).select(
        "*", *[F.lit("s").alias(c) for c in ("source_id", "source_type", "title", "bucket")], F.lit(1).alias("batch_index"),
        *[F.array().cast("array<string>").alias(c) for c in ("relevance_reasons", "quality_reasons")], F.lit(3).alias("relevance_score"),
    )
    members = spark.range(3).select(
        ((F.col("id") + 1) / 10).alias("threshold"), F.lit("b").alias("bucket"), F.lit(1).alias("cluster_index"), F.lit("cluster-b").alias("cluster_id"),
    ).crossJoin(spark.createDataFrame([("1", 3), ("2", 2), ("2", 2), (None, 1)], "item_id string, relevance_score int"))
    written = {}

    def counted(df, name):
        out = stage(df, name)
        if "tokens" in out.columns:
            written[name] = out.count()
        return out

    monkeypatch.setattr(C, "stage", counted)
    monkeypatch.setattr(C, "member_fingerprint", lambda: F.sha2("clean_text", 256))
    rows = C.cluster_rollup(members, items).collect()
    assert sum(written.values()) <= items.count()
    assert len(rows) == 3 and all(r["item_count"] == 5 for r in rows)
    assert all(r["top_terms"] == ["gamma", "beta", "alpha", "delta"] for r in rows)
