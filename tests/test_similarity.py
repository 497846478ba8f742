"""Blocks of points that meet: how often a point is sent, and what a product in single precision may not decide."""

from __future__ import annotations

import numpy as np

from weaksift.operators import similarity as S
from weaksift.operators.components import connected_items


def frame(spark, vectors):
    return spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(vectors)], "node long, bucket string, vector array<double>")


def test_points_without_clusters_are_sent_a_few_times_and_add_few_links(spark):
    """Where no bound excludes a pair, a point must not be sent again for every few thousand others, and a meeting of two
    blocks must not answer with a link a pair."""
    rng = np.random.default_rng(2)
    vectors = rng.random((5_000, 24)) ** 3
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    levels = [0.12, 0.5, 0.8, 0.9]
    points, _ = S._points(frame(spark, vectors))
    hung, _, cells = S._hang(points, levels, S.ANCHORS_PER_BUCKET, S.MAX_ANCHORS, S.BLOCK)
    visits = S._visits(hung, levels, cells)
    assert visits.count() <= len(vectors)
    assert S._compare(hung, visits, levels, cells, S.BLOCK).count() <= 2 * len(vectors)


def test_single_precision_decides_no_link(spark):
    """Cosines that differ from the threshold by less than a float can tell."""
    turned = lambda cosine: [cosine, float(np.sqrt(1 - cosine * cosine))]
    for cosine, components in ((0.9, 1), (0.9 - 4e-9, 2), (0.9 - 2e-7, 2), (0.9 + 4e-9, 1)):
        found = connected_items(frame(spark, np.array([[1.0, 0.0], turned(cosine)])), [0.5, 0.9], anchors_per_bucket=0).toPandas()
        assert found[found.t == 1].component.nunique() == components
        assert found[found.t == 0].component.nunique() == 1
