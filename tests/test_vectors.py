from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaksift.operators import vectors as V


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("i1", "s1", "CRM sync", "the crm sync fails, crm-sync again", ["business_scope_terms:crm"], ["q:x"]),
        ("i2", "s2", "", "", [], []),
        ("i3", "s3", "é", "ab the a1 Zapier zapier", ["low_positive_relevance"], []),
    ]
    return spark.createDataFrame(
        rows,
        "item_id string, source_id string, title string, clean_text string, relevance_reasons array<string>, quality_reasons array<string>",
    )


def slot(token: str) -> int:
    return int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % 64


def test_hashed_vector_counts_tokens_without_stop_words(items):
    vectors = {r.item_id: r.vector for r in V.hashed_vectors(items).collect()}
    counts = [0.0] * 64
    for token in ["crm", "sync", "crm", "sync", "fails", "crm-sync", "business", "crm"]:
        counts[slot(token)] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    assert vectors["i1"] == pytest.approx([c / norm for c in counts])
    assert vectors["i2"] == [0.0] * 64
    assert len(vectors["i3"]) == 64


def test_known_slot():
    assert slot("crm") == 47


def test_payload_is_sparse_and_rounded(items):
    row = V.embedding_payload(items).where("item_id = 'i1'").first()
    assert row.token_count == 8 and row.dimensions == 64
    assert row.top_terms == ["crm", "sync", "business", "crm-sync", "fails"]
    assert row.nonzero_indices == sorted(row.nonzero_indices) and all(round(v, 6) == v for v in row["values"])


def test_backends_by_name(spark, items):
    table = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<float>").withColumn(
        "vec_id", F.lit("s1")
    )
    by_table = V.backend("table", vector_table=table, id_column="vec_id", vector_column="embedding")(items)
    found = {r.item_id: r.vector for r in by_table.collect()}
    assert found["i1"] == pytest.approx([0.6, 0.8]) and found["i2"] is None
    lengths = lambda texts: np.array([[len(t), 0.0] for t in texts])
    by_function = V.backend("function", encode=lengths)(items).where("item_id = 'i1'").first()
    assert by_function.vector == [1.0, 0.0]
    assert len(V.backend("hashing", dimensions=16)(items).first().vector) == 16
    with pytest.raises(ValueError):
        V.backend("unknown")


def test_cosine(spark):
    row = spark.range(1).select(
        V.cosine(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(1.0), F.lit(0.0))).alias("c")
    ).first()
    assert row.c == pytest.approx(0.6)
