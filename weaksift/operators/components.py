"""Connected components of the "cosine >= threshold" graph inside each bucket, exact, without listing its pairs: a spanning
forest of the similarity graph (``similarity``), cut at each threshold (``forest``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.operators.forest import components, cut, spanning_forest
from weaksift.operators.similarity import similarity_forest

__all__ = ["components", "connected_items", "cut", "items_of_forest", "similarity_forest", "spanning_forest"]


def connected_items(vectors: DataFrame, thresholds: list[float], **options) -> DataFrame:
    """``vectors`` has ``node`` (unique long), ``bucket`` and ``vector`` (unit length or zero); it is
    read a few times, so it should be a stage table.
    Returns ``t`` (position in ``thresholds``), ``node`` and ``component`` (one node of it)."""
    if any(threshold <= 0 for threshold in thresholds):
        raise ValueError("thresholds must be positive")
    return items_of_forest(vectors, similarity_forest(vectors, thresholds, **options), thresholds)


def items_of_forest(vectors: DataFrame, forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """The same from a forest made before, whose levels hold the thresholds: no vector is compared again. Items without an
    edge are components of their own."""
    every = vectors.select(F.explode(F.lit(list(range(len(thresholds))))).alias("t"), "node")
    return every.join(cut(forest, thresholds), ["t", "node"], "left").select("t", "node", F.coalesce("component", "node").alias("component"))
