"""Quality, relevance and signals on rows whose outcome was worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weaksift.lexicons import DOMAIN
from weaksift.operators import history as H
from weaksift.operators import quality as Q
from weaksift.operators import signals as S
from weaksift.operators import vectors as V
from weaksift.plans import evidence as E
from weaksift.plans.seeded import PHRASES
from weaksift.plans.stages import stage
from weaksift.sources.raw_items import with_defaults

# Phrase number -> quality score, kept, relevance score, kept for relevance (phrases alone).
EXPECTED = {
    0: (4, True, 10, True), 1: (5, True, 18, True), 2: (2, True, 11, True), 3: (5, True, 13, True),
    4: (2, True, 11, True), 5: (4, True, 9, True), 6: (5, True, 9, True), 7: (2, False, None, None),
    8: (3, False, None, None), 9: (2, False, None, None), 10: (0, False, None, None), 11: (2, False, None, None),
    12: (0, False, None, None), 13: (0, False, None, None), 14: (2, True, -21, False), 15: (4, True, 13, True),
    16: (4, True, 10, True), 17: (3, True, -31, False), 18: (4, True, 10, True), 19: (3, True, -19, False),
    20: (5, True, -15, False), 21: (4, True, -1, False), 22: (3, True, -17, False), 23: (4, True, -4, False),
}


def items(spark, rows):
    """rows: (source_type, rating, title, text)"""
    numbered = [(i + 1, *row) for i, row in enumerate(rows)]
    frame = spark.createDataFrame(numbered, "source_index long, source_type string, rating string, title string, text string")
    return with_defaults(frame.withColumns({"source_id": F.col("source_index").cast("string"), "run_id": F.lit("r")}))


@pytest.fixture(scope="module")
def phrases(spark):
    assessed = stage(E.assess_items(items(spark, PHRASES)), "assessed")
    return assessed, stage(E.prepare_items(assessed), "prepared")


def test_scores_of_the_phrase_bank(phrases):
    assessed, prepared = phrases
    quality = {r.source_index - 1: r for r in assessed.collect()}
    relevance = {r.source_index - 1: r for r in prepared.collect()}
    for k, (score, kept, points, relevant) in EXPECTED.items():
        assert (quality[k].quality_score, quality[k].kept) == (score, kept), k
        if kept:
            assert (relevance[k].relevance_score, not relevance[k].exclude_for_relevance) == (points, relevant), k


def test_reasons_are_explained(phrases):
    assessed, prepared = phrases
    quality = {r.source_index - 1: r for r in assessed.collect()}
    relevance = {r.source_index - 1: r for r in prepared.collect()}
    assert quality[7].exclude_reasons[0].startswith("job_or_careers_language:full-time, apply now, salary range, benefits")
    assert quality[8].exclude_reasons == ["job_or_careers_language:remote_with_job_context"]
    assert quality[11].exclude_reasons == ["company_self_description"]
    assert quality[12].quality_reasons == ["low_user_evidence_signal"]
    assert quality[3].quality_reasons[2] == "has_customer_rating"  # a rating of "0" is a rating
    codes = lambda k: [p.split(":")[0] for p in relevance[k].relevance_penalties]
    assert codes(15) == ["promotion_with_some_user_pain"]
    assert codes(16) == ["link_drop_density"]
    assert codes(19) == ["engineering_heavy_weak_venture_context", "missing_business_workflow_or_tool_context_anchor"]
    assert codes(25) == ["technical_detail_needs_stronger_operational_pain"]
    assert codes(26) == ["api_or_debug_detail_weak_business_context"]


def test_item_numbers_count_items_that_relevance_drops(phrases):
    _, prepared = phrases
    rows = prepared.orderBy("source_index").collect()
    assert [r.item_no for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.item_id == f"{r.source_type}-{r.item_no}" for r in rows)


def test_edge_cases(spark):
    rows = [
        ("discussion", "", "", ""),
        ("review", "", "Hiring", "A remote job: we are hiring, apply with the form, it is hard to fill."),
        (None, "", "t", "short"),
        ("forum", "", "t", "short"),
        ("discussion", "", "", "I need this but"),
    ]
    assessed = stage(E.assess_items(items(spark, rows)), "assessed")
    out = {r.source_index: r for r in assessed.collect()}
    assert out[1].exclude_reasons == ["empty_text", "discussion_text_not_comment_like"]
    assert [r.split(":")[0] for r in out[2].exclude_reasons[:2]] == ["job_or_careers_language"] * 2
    assert out[3].kept and out[4].kept  # no score gate for other source types
    histogram = Q.reason_histogram(assessed, "exclude_reasons").collect()
    assert {r.reason_code: r.reason_count for r in histogram}["job_or_careers_language"] == 2


def test_marker_at_the_end_of_the_text_needs_its_own_space(spark):
    text = "eight words here are needed for a comment. i"
    rows = [("discussion", "", "", text), ("discussion", "", "", text + " x")]
    out = {r.source_index: r for r in E.assess_items(items(spark, rows)).collect()}
    assert "comment_like_length_or_style" not in out[1].quality_reasons
    assert "comment_like_length_or_style" in out[2].quality_reasons


def test_conversational_hits_are_joined_untrimmed(spark):
    out = E.assess_items(items(spark, [("forum", "", "", "i like our crm, we tried")])).first()
    assert out.quality_reasons[0] == "conversational_language:i , we , our"


def test_signals_see_the_excerpt_only(spark):
    filler = "word " * 60
    rows = [("review", "1", "CRM sync", f"We use a crm and the setup fails. {filler} The integration is slow.")]
    prepared = E.prepare_items(stage(E.assess_items(items(spark, rows)), "assessed"))
    scored = {r.category: r for r in S.score_signals(E.relevant(prepared)).collect()}
    barrier = scored["adoption_barriers"]
    assert barrier.matched_terms == ["setup", "integration"]  # terms come from the whole text
    # The excerpt holds setup and sync (2 each) and one strong term (3); integration lies beyond it.
    assert barrier.signal_relevance_score == barrier.relevance_score + 4 + 3


@pytest.mark.parametrize("parts", [1, 5])
def test_order_partitions_and_batch_size_do_not_matter(spark, parts):
    raw = items(spark, PHRASES)
    columns = ["item_id", "relevance_score", "source_id", "bucket"]
    run = lambda rows, size: stage(E.prepare_items(stage(E.assess_items(rows, size), "assessed")).select(columns), "prepared")
    base = run(raw, 500)
    other = run(raw.orderBy(F.desc("source_id")).repartition(parts), 1)
    assert base.exceptAll(other).isEmpty() and other.exceptAll(base).isEmpty()


def test_empty_input(spark):
    raw = items(spark, [("review", "", "", "")]).limit(0)
    run = E.run_evidence(raw, "empty")
    assert run["prepared_items"].isEmpty() and run["evidence_rows"].isEmpty() and run["clusters"].isEmpty()
    summary = run["category_summaries"].collect()
    assert len(summary) == 7 and all(r.evidence_count == 0 for r in summary)
    assert run["relevance_summary"].first()[0] == 0
    notes = [r.ord for r in run["uncertainty_notes"].orderBy("ord").collect()]
    assert notes == [1, 2, 4, 5]
    assert [r.ord for r in run["implication_notes"].collect()] == [1]


def test_run_evidence_adds_up(spark):
    run = E.run_evidence(items(spark, PHRASES), "run-1", batch_size=5)
    total = run["filtering_summary"].where("source_type IS NULL").first()
    assert total.raw_items == len(PHRASES) == total.kept_items + total.excluded_items
    batches = run["processing_batches"].collect()
    assert len(batches) == -(-len(PHRASES) // 5) and sum(b.raw_items for b in batches) == len(PHRASES)
    n = run["prepared_items"].count()
    assert sum(b.relevance_prepared for b in batches) == n == run["members"].count()
    assert run["relevance_excluded_items"].count() == total.kept_items - n
    assert run["model_artifacts"].count() == 2 * n + run["clusters"].count()
    assert {len(r.input_hash) for r in run["model_artifacts"].collect()} == {64}
    volume = run["volume"].first()
    assert volume.evidence_rows == run["evidence_rows"].count() > 0
    assert sum(r.evidence_count for r in run["category_summaries"].collect()) == volume.evidence_rows
    assert run["memo"].where("ord = 0").count() == 7


def test_a_run_is_saved_and_read_back_as_it_is(spark, tmp_path):
    root = str(tmp_path / "store")
    log = spark.createDataFrame([("s", "q", 1, 5, 4, True), ("s", "q", 2, 5, 4, False)], E.PAGE_LOG)
    first = E.run_evidence(items(spark, PHRASES), "run-1", batch_size=5, created_at="2026-01-01", pages=log)
    H.save_run(first, root)
    H.save_run(E.run_evidence(items(spark, PHRASES[:4]), "run-2", resume_from="run-1", created_at="2026-01-02"), root)
    H.save_run(E.run_evidence(items(spark, PHRASES[:3]), "run-2", resume_from="run-1", created_at="2026-01-03"), root)
    stored = {name: H.read_table(spark, root, name) for name in H.TABLE_KEYS}
    assert [(r.run_id, r.generated_at_utc) for r in H.list_runs(stored["runs"]).collect()] == [("run-2", "2026-01-03"), ("run-1", "2026-01-01")]
    assert stored["raw_items"].where("run_id = 'run-2'").count() == 3
    assert stored["evidence_rows"].where("run_id = 'run-1'").count() == first["evidence_rows"].count() > 0
    chain = H.chain_runs(H.lineage(stored["runs"], "run-2"))
    counts = {r["name"]: r["n"] for r in H.table_counts(stored, chain).collect()}
    assert counts["raw_items"] == len(PHRASES) + 3 and counts["collection_pages"] == 2 and counts["processing_batches"] >= 2
    assert stored["collection_states"].first().completed


def test_a_users_own_category_and_bucket_are_kept(spark):
    lexicon = DOMAIN | {"signal.my_cat": ["invoice", "manual", "spreadsheet"], "bucket.my_bucket": ["manual", "spreadsheet", "invoice"]}
    run = E.run_evidence(items(spark, PHRASES), "run-1", lexicon=lexicon)
    found = run["evidence_rows"].where("category = 'my_cat'")
    assert found.count() > 0 and found.first().category_title == "my_cat"
    summary = {r.category: r for r in run["category_summaries"].collect()}
    assert summary["my_cat"].evidence_count == found.count() and summary["my_cat"].title == "my_cat" and len(summary) == 8
    assert {r.section for r in run["memo"].where("title = 'my_cat'").collect()} == {13}
    labels = {r.bucket: r.label for r in run["clusters"].collect()}
    assert labels.get("my_bucket", "my_bucket") == "my_bucket" and None not in labels.values()


def test_artifacts_tell_the_backend_and_the_grouping(spark):
    import json

    import numpy as np

    function = V.backend("function", identifier="lengths", encode=lambda texts: np.array([[len(t), 1.0] for t in texts]))
    for backend, dimensions in ((V.backend("hashing"), 64), (function, 2)):
        run = E.run_evidence(items(spark, PHRASES), "run-1", vectors=backend)
        found = run["model_artifacts"].collect()
        embedding = [r for r in found if r.artifact_type == "embedding"]
        assert len(embedding) == run["prepared_items"].count() > 0
        assert {(r.model_name, r.model_version) for r in embedding} == {(backend.model, "v1")}
        payload = json.loads(embedding[0].artifact)
        assert payload["dimensions"] == dimensions and payload["source_text_fields"] == V.SOURCE_TEXT_FIELDS
        assert payload["embedding_type"] == ("sparse_hashing" if dimensions == 64 else "dense_transformer")
        for r in (r for r in found if r.artifact_type == "evidence_cluster"):
            cluster = json.loads(r.artifact)
            assert cluster["embedding_model"] == backend.label and cluster["grouping_basis"] == backend.basis
            assert cluster["embedding_dimensions"] == dimensions and cluster["similarity_threshold"] == 0.12
            first = cluster["member_similarity_to_representative"][0]
            assert first["item_id"] == cluster["representative_item_ids"][0] and len(cluster["member_similarity_to_representative"]) <= 10
