from __future__ import annotations

from itertools import combinations

import pytest

from weaksift.operators import evaluate as A


def brute(gold: dict, predicted: dict):
    ids = sorted(gold.keys() & predicted.keys())
    pairs = list(combinations(ids, 2))
    same_gold = [gold[a] == gold[b] for a, b in pairs]
    same_predicted = [predicted[a] == predicted[b] for a, b in pairs]
    return sum(map(all, zip(same_gold, same_predicted))), sum(same_predicted), sum(same_gold), len(pairs)


CASES = {
    "mixed": ({str(i): f"g{i % 3}" for i in range(20)}, {str(i): f"c{i % 4}" for i in range(5, 25)}),
    "one cluster": ({str(i): f"g{i % 2}" for i in range(6)}, {str(i): "c" for i in range(6)}),
    "all alone": ({str(i): "g" for i in range(4)}, {str(i): f"c{i}" for i in range(4)}),
    "no shared ids": ({"a": "g"}, {"b": "c"}),
    "one item": ({"a": "g"}, {"a": "c"}),
}


@pytest.mark.parametrize("name", CASES)
def test_metrics_equal_pair_by_pair_counting(spark, name):
    gold, predicted = CASES[name]
    members = spark.createDataFrame(
        [(0.5, k, c, c, 1) for k, c in predicted.items()],
        "threshold double, source_id string, cluster_id string, bucket string, cluster_index long",
    )
    labels = spark.createDataFrame(list(gold.items()), "source_id string, gold string")
    row = A.evaluate(members, labels, ["threshold"]).first()
    hit, said, real, pairs = brute(gold, predicted)
    assert (row.true_positive_pairs, row.predicted_positive_pairs, row.gold_positive_pairs, row.pair_count) == (hit, said, real, pairs)
    ratio = lambda a, b: a / b if b else 0.0
    precision, recall = ratio(hit, said), ratio(hit, real)
    assert row.pairwise_precision == pytest.approx(precision, abs=6e-5)
    assert row.pairwise_recall == pytest.approx(recall, abs=6e-5)
    assert row.pairwise_f1 == pytest.approx(ratio(2 * precision * recall, precision + recall), abs=6e-5)
    assert {r.source_id for r in A.missing_labels(members, labels).collect()} == gold.keys() - predicted.keys()


def test_last_cluster_wins_for_a_shared_source_id(spark):
    rows = [(0.5, "s", "cluster-a-2", "a", 2), (0.5, "s", "cluster-b", "b", 1), (0.5, "s", "cluster-a-1", "a", 1)]
    members = spark.createDataFrame(rows, "threshold double, source_id string, cluster_id string, bucket string, cluster_index long")
    assert A.predicted_labels(members, ["threshold"]).first().predicted == "cluster-b"


def test_best_result_prefers_f1_then_recall_then_fewer_clusters(spark):
    schema = (
        "backend_ord int, embedding_backend string, embedding_model string, threshold double, pairwise_f1 double, "
        "pairwise_recall double, pairwise_precision double, predicted_cluster_count long"
    )
    rows = [(1, "h", "m", 0.1, 0.5, 0.6, 0.4, 9), (1, "h", "m", 0.2, 0.5, 0.6, 0.4, 3), (1, "h", "m", 0.3, 0.4, 1.0, 1.0, 1), (2, "t", "m", 0.3, 0.5, 0.6, 0.4, 1)]
    results = spark.createDataFrame(rows, schema)
    assert A.best_result(results.where("backend_ord = 1")).first().threshold == 0.2
    assert A.best_backend(results).first().embedding_backend == "h"
