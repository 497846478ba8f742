"""Pairwise agreement of clusters with reviewed labels, for one or many thresholds and backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def predicted_labels(members: DataFrame, keys: list[str]) -> DataFrame:
    """One cluster per source_id; if it is in several, the last in cluster order wins."""
    return members.groupBy(*keys, "source_id").agg(
        F.max_by("cluster_id", F.struct("bucket", "cluster_index")).alias("predicted")
    )


def _pairs(count: Column) -> Column:
    wide = count.cast("decimal(19,0)")
    return wide * (wide - 1) / 2


def pair_counts(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """``labelled`` has ``gold`` and ``predicted``. No pair is formed: the counts of pairs follow
    from the contingency table, which is linear in the items."""
    cells = labelled.groupBy(*keys, "gold", "predicted").agg(F.count("*").alias("n"))
    by = lambda column: cells.groupBy(*keys, column).agg(F.sum("n").alias("n"))
    total = lambda table, name: table.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias(name))
    everything = cells.groupBy(*keys).agg(F.sum("n").alias("labeled_item_count"))
    return (
        everything.withColumn("pair_count", _pairs(F.col("labeled_item_count")))
        .join(total(cells, "true_positive_pairs"), keys)
        .join(total(by("predicted"), "predicted_positive_pairs"), keys)
        .join(total(by("gold"), "gold_positive_pairs"), keys)
        .select(
            *keys,
            "labeled_item_count",
            *[
                F.col(c).cast("long").alias(c)
                for c in ("true_positive_pairs", "predicted_positive_pairs", "gold_positive_pairs", "pair_count")
            ],
        )
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Half-up to four places in whole numbers; 0 when the denominator is 0."""
    top, bottom = numerator.cast("decimal(30,0)"), denominator.cast("decimal(30,0)")
    ten_thousandths = F.call_function("div", top * 20000 + bottom, F.nullif(bottom, F.lit(0)) * 2)
    return F.coalesce(ten_thousandths.cast("double") / 10000.0, F.lit(0.0))


def pair_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; F1 is 2TP / (predicted + gold), so it comes from unrounded values."""
    hit, predicted, gold = (
        F.col(c) for c in ("true_positive_pairs", "predicted_positive_pairs", "gold_positive_pairs")
    )
    return counts.withColumns(
        {
            "pairwise_precision": _ratio(hit, predicted),
            "pairwise_recall": _ratio(hit, gold),
            "pairwise_f1": _ratio(hit * 2, predicted + gold),
        }
    )


def evaluate(members: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``members``: keys, source_id, cluster_id, bucket, cluster_index. ``labels``: source_id, gold.
    One row of metrics per key (backend and threshold, say)."""
    predicted = predicted_labels(members, keys)
    metrics = pair_metrics(pair_counts(predicted.join(labels, "source_id"), keys))
    clusters = members.select(*keys, "cluster_id").distinct().groupBy(*keys).agg(
        F.count("*").alias("predicted_cluster_count")
    )
    empty = {
        c: 0
        for c in (
            "labeled_item_count", "true_positive_pairs", "predicted_positive_pairs", "gold_positive_pairs",
            "pair_count", "pairwise_precision", "pairwise_recall", "pairwise_f1",
        )
    }
    return clusters.join(metrics, keys, "left").fillna(empty)


def missing_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Reviewed source ids that no cluster holds."""
    return labels.select("source_id").distinct().join(members, "source_id", "left_anti")


def best_result(results: DataFrame, keys: list[str] = []) -> DataFrame:
    """Best threshold per key: F1, recall, precision (rounded), fewer clusters, then the first."""
    order = [
        F.desc("pairwise_f1"), F.desc("pairwise_recall"), F.desc("pairwise_precision"),
        F.asc("predicted_cluster_count"), F.asc("threshold"),
    ]
    w = W.partitionBy(*keys).orderBy(*order)  # a handful of thresholds per key
    return results.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def best_backend(results: DataFrame) -> DataFrame:
    """The backend whose best threshold has the best F1, recall, precision; the first on a tie."""
    best = best_result(results, ["backend_ord", "embedding_backend", "embedding_model"])
    return best.orderBy(
        F.desc("pairwise_f1"), F.desc("pairwise_recall"), F.desc("pairwise_precision"), "backend_ord"
    ).limit(1)


def evaluation_rows(results: DataFrame) -> DataFrame:
    """The flat rows of an evaluation, a sweep or a comparison."""
    return results.select(
        "embedding_backend",
        "embedding_model",
        F.col("threshold").alias("cluster_similarity_threshold"),
        "predicted_cluster_count",
        "labeled_item_count",
        "pairwise_precision",
        "pairwise_recall",
        "pairwise_f1",
        "true_positive_pairs",
        "predicted_positive_pairs",
        "gold_positive_pairs",
        "pair_count",
    )
