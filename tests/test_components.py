"""Similarity components against brute force, through every path of the algorithm."""

from __future__ import annotations

import numpy as np
import pytest

from weaksift.operators.components import components, connected_items, cut, items_of_forest, similarity_forest, spanning_forest
from weaksift.operators.similarity import comparisons


def brute_force(vectors: np.ndarray, buckets: list[str], threshold: float) -> list[int]:
    near = np.floor(vectors @ vectors.T * 1e9 + 0.5) / 1e9 >= threshold
    near &= np.equal.outer(np.array(buckets), np.array(buckets))
    np.fill_diagonal(near, True)
    label = np.arange(len(vectors))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(vectors))])
        if (new == label).all():
            return new.tolist()
        label = new


def random_vectors(seed: int, n: int, dims: int = 16) -> np.ndarray:
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims))
    vectors[: n // 3] = vectors[0]  # a third of all rows are copies
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[-1] = 0.0  # an item without tokens
    return vectors


@pytest.mark.parametrize(
    "options",
    [
        {},  # every item of a bucket is an anchor
        {"anchors_per_bucket": 4},  # the residue is sent to every task
        {"anchors_per_bucket": 4, "max_anchors": 8, "block": 16},  # the residue is compared in blocks
        {"anchors_per_bucket": 4, "max_anchors": 6, "block": 16},  # the anchor sample itself is cut
    ],
)
def test_connected_items_equal_brute_force(spark, options):
    vectors = random_vectors(7, 160)
    buckets = ["a" if i % 5 else "b" for i in range(len(vectors))]
    thresholds = [0.3, 0.5, 0.62]
    rows = [(i, b, v.tolist()) for i, (b, v) in enumerate(zip(buckets, vectors))]
    frame = spark.createDataFrame(rows, "node long, bucket string, vector array<double>")
    found = connected_items(frame, thresholds, **options).toPandas()
    assert len(found) == len(vectors) * len(thresholds)
    for t, threshold in enumerate(thresholds):
        mine = found[found.t == t].sort_values("node").component.tolist()
        expected = brute_force(vectors, buckets, threshold)
        pairs = set(zip(mine, expected))
        assert len(pairs) == len(set(mine)) == len(set(expected))


def test_threshold_only_splits_clusters(spark):
    vectors = random_vectors(11, 80)
    frame = spark.createDataFrame(
        [(i, "a", v.tolist()) for i, v in enumerate(vectors)], "node long, bucket string, vector array<double>"
    )
    found = connected_items(frame, [0.3, 0.6], anchors_per_bucket=8).toPandas()
    low = found[found.t == 0].set_index("node").component
    high = found[found.t == 1].set_index("node").component
    assert (low.groupby(high).nunique() == 1).all()


@pytest.mark.parametrize("few_edges", [0, 1000])
def test_components_of_chain_star_and_pair(spark, few_edges):
    chain = [(0, i, i + 1) for i in range(40)]
    star = [(0, 100, 100 + i) for i in range(1, 30)]
    other_graph = [(1, 5, 6), (1, 6, 7), (1, 9, 9)]
    edges = spark.createDataFrame(chain + star + other_graph, "t int, src long, dst long")
    found = {(r.t, r.node): r.component for r in components(edges, few_edges).collect()}
    assert all(found[(0, i)] == 0 for i in range(41))
    assert all(found[(0, 100 + i)] == 100 for i in range(30))
    assert found[(1, 7)] == 5 and found[(1, 9)] == 9
    assert len(found) == 41 + 30 + 4


def test_components_without_edges(spark):
    edges = spark.createDataFrame([], "t int, src long, dst long")
    assert components(edges).count() == 0
    assert components(edges, few_edges=-1).count() == 0


def test_threshold_must_be_positive(spark):
    frame = spark.createDataFrame([(1, "a", [1.0])], "node long, bucket string, vector array<double>")
    with pytest.raises(ValueError):
        connected_items(frame, [0.0])


def plain_components(nodes, edges):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few_edges", [0, 1_000_000])
def test_spanning_forest_and_its_cuts(spark, few_edges):
    """By joins as by one task: the edges of a forest, of the largest weight, that answers every threshold."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 150, 600), rng.integers(0, 150, 600), rng.integers(1, 12, 600) / 10)]
    edges += [(1000, 1001 + i, 0.5) for i in range(300)] + [(2000 + i, 2001 + i, 0.1 + i % 9 / 10) for i in range(60)] + [(7, 7, 9.0), (1, 2, 0.1), (2, 1, 0.3)]
    frame = spark.createDataFrame(edges, "src long, dst long, w double")
    forest = spanning_forest(frame, few_edges)
    rows = [tuple(r) for r in forest.collect()]
    nodes = {n for a, b, _ in edges if a != b for n in (a, b)}
    apart = len(set(plain_components(nodes, [e[:2] for e in edges if e[0] != e[1]]).values()))
    assert len(rows) == len(nodes) - apart
    taken, best = [], 0.0
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        label = plain_components(nodes, taken) if a != b else {}
        if a != b and label[a] != label[b]:
            taken.append((a, b))
            best += w
    assert sum(w for _, _, w in rows) == pytest.approx(best)
    thresholds = [0.5, 1.2, 0.1, 0.85]
    got = {(r.t, r.node): r.component for r in cut(forest, thresholds, few_edges).collect()}
    for t, threshold in enumerate(thresholds):
        label = plain_components(nodes, [(a, b) for a, b, w in edges if a != b and w >= threshold])
        assert {n: got[(t, n)] for n in nodes} == label


def test_forest_of_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    for few_edges in (0, 10):
        assert spanning_forest(none, few_edges).count() == 0 and cut(none, [0.5], few_edges).count() == 0


def clustered_vectors(seed, clusters, size, dims=64, spread=0.012):
    """Points close around centers, some of them copies, and a few that lie alone."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dims))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    vectors = np.repeat(centers, size, axis=0) + spread * rng.normal(size=(clusters * size, dims))
    vectors[::7] = vectors[0]
    vectors[::50] = rng.normal(size=vectors[::50].shape)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def vector_frame(spark, vectors, bucket="a"):
    return spark.createDataFrame([(i, bucket, v.tolist()) for i, v in enumerate(vectors)], "node long, bucket string, vector array<double>")


def test_one_forest_answers_every_level(spark):
    """Thresholds of the levels, in any order and number, without another look at the vectors."""
    vectors = clustered_vectors(3, 20, 15, dims=12, spread=0.12)
    frame = vector_frame(spark, vectors).cache()
    levels = [0.3, 0.5, 0.62, 0.8, 0.9, 0.97]
    forest = similarity_forest(frame, levels, anchors_per_bucket=12, block=40).cache()
    for thresholds in ([0.62], [0.9, 0.3, 0.8], levels):
        found = items_of_forest(frame, forest, thresholds).toPandas()
        for t, threshold in enumerate(thresholds):
            mine = found[found.t == t].sort_values("node").component.tolist()
            expected = brute_force(vectors, ["a"] * len(vectors), threshold)
            assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


@pytest.mark.parametrize("levels", [[0.8], [0.9], [0.4], [0.12, 0.5, 0.8, 0.9]])
def test_comparisons_grow_below_the_square(spark, levels):
    """Four times the points of clustered data: far from sixteen times the compared pairs."""
    counted = []
    for clusters, size in ((25, 40), (50, 80)):
        vectors = clustered_vectors(8, clusters, size)
        frame = vector_frame(spark, vectors).cache()
        work = comparisons(frame, levels)
        counted.append((len(vectors), work["with_pivots"] + work["with_visitors"]))
        if clusters == 25:
            found = connected_items(frame, levels).toPandas()
            for t, threshold in enumerate(levels):
                mine = found[found.t == t].sort_values("node").component.tolist()
                expected = brute_force(vectors, ["a"] * len(vectors), threshold)
                assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))
    (n, few), (m, many) = counted
    assert many < 11 * few and many < 0.15 * m * m, counted


def test_copies_are_compared_once(spark):
    """However many copies there are, only one of them meets the others."""
    one, two = np.eye(16)[:2]
    frame = vector_frame(spark, [one] * 500 + [two] * 300 + [np.zeros(16)] * 3).cache()
    assert comparisons(frame, [0.5])["points"] == 2
    found = connected_items(frame, [0.5]).toPandas()
    assert found.groupby("component").size().tolist() == [500, 300, 1, 1, 1]
