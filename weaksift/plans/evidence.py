"""The whole evidence run: raw items in, a dict of result DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.functions import text as T
from weaksift.lexicons import DOMAIN
from weaksift.operators import clusters as C
from weaksift.operators import labels as L
from weaksift.operators import quality as Q
from weaksift.operators import relevance as R
from weaksift.operators import signals as S
from weaksift.operators import summaries as U
from weaksift.operators import vectors as V
from weaksift.operators.history import collection_state
from weaksift.operators.numbering import batch_of, dense_positions
from weaksift.operators.scan import clean_items, scan_items
from weaksift.plans.stages import stage
from weaksift.sources.raw_items import source_counts

BATCH_SIZE = 500
PAGE_LOG = "source string, query string, page_number long, raw_count long, item_count long, has_more boolean"

# Model names of the artifact records.
CLASSIFIER = ("heuristic-signal-classifier", "v1")
EMBEDDER = V.HASHED[:2]

ARTIFACT_COLUMNS = [
    "run_id", "batch_index", "item_id", "source_id", "artifact_type", "model_name", "model_version",
    "input_hash", "artifact", "created_at",
]


def assess_items(raw: DataFrame, batch_size: int = BATCH_SIZE, lexicon=DOMAIN) -> DataFrame:
    """Raw items (with a 1-based ``source_index``) cleaned, scanned and judged for quality. The raw
    text is not carried on."""
    scanned = scan_items(clean_items(raw).drop("text"), lexicon)
    return Q.assess_quality(scanned, lexicon).withColumn("batch_index", batch_of(F.col("source_index"), batch_size))


def prepare_items(assessed: DataFrame, lexicon=DOMAIN) -> DataFrame:
    """Kept items numbered in source order (also those that relevance sets aside, so the batch size never
    changes an id), then scored for relevance and tagged. ``assessed`` is a stage table; scoring needs no
    shuffle. The numbers come first: a join above the scores would have Spark reason about all of them."""
    kept = dense_positions(assessed.where("kept"), "source_index", "item_no")
    scored = R.score_relevance(kept.drop("kept", "exclude_reasons", "opening", "has_sentence_mark"), lexicon)
    return L.tag_items(scored, lexicon).withColumn(
        "item_id", F.concat(F.coalesce("source_type", F.lit("source")), F.lit("-"), F.col("item_no").cast("string"))
    )


def relevant(prepared: DataFrame) -> DataFrame:
    return prepared.where(~F.col("exclude_for_relevance"))


def classification_artifacts(items: DataFrame, created_at: str = "") -> DataFrame:
    payload = F.to_json(
        F.struct(
            "primary_label", "labels", "relevance_score", "quality_score",
            T.join_reasons(F.col("relevance_reasons")).alias("relevance_reasons"),
            T.join_reasons(F.col("relevance_penalties")).alias("relevance_penalties"),
        )
    )
    return _artifacts(items, "classification", CLASSIFIER, L.item_fingerprint(), payload, created_at)


def embedding_artifacts(items: DataFrame, created_at: str = "", backend: V.Backend | None = None) -> DataFrame:
    """``items`` need their ``vector`` for a backend other than hashing."""
    backend = backend or V.backend("hashing")
    payload = F.to_json(F.struct(*backend.payload_fields))
    return _artifacts(
        backend.payload(items), "embedding", (backend.model, backend.version), L.item_fingerprint(), payload, created_at
    )


def cluster_artifacts(rollup: DataFrame, run_id: str, created_at: str = "") -> DataFrame:
    payload = F.to_json(F.struct(*[c for c in rollup.columns if c not in ("input_hash", "batch_index")]))
    named = rollup.select(
        F.lit(run_id).alias("run_id"), "batch_index", F.col("cluster_id").alias("item_id"),
        F.col("cluster_id").alias("source_id"), "input_hash", payload.alias("artifact"),
    )
    return _artifacts(named, "evidence_cluster", C.CLUSTERER, F.col("input_hash"), F.col("artifact"), created_at)


def _artifacts(rows, kind, model, fingerprint, payload, created_at) -> DataFrame:
    return rows.select(
        "run_id", "batch_index", "item_id", "source_id",
        F.lit(kind).alias("artifact_type"),
        F.lit(model[0]).alias("model_name"),
        F.lit(model[1]).alias("model_version"),
        fingerprint.alias("input_hash"),
        payload.alias("artifact"),
        F.lit(created_at).alias("created_at"),
    )


def run_evidence(
    raw: DataFrame,
    run_id: str,
    batch_size: int = BATCH_SIZE,
    threshold: float = C.DEFAULT_THRESHOLD,
    lexicon=DOMAIN,
    vectors=None,
    created_at: str = "",
    resume_from: str = "",
    theme: str = "",
    pages: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One run over raw items with ``source_index``. The text is read twice in all: once by the
    scan, once by the vectors; every other step reads the staged tables.

    Every table of ``history.TABLE_KEYS`` is in the result, with ``run_id``, so ``history.save_run``
    takes it as it is; what else is there is a view of them. ``created_at`` is the time of the run,
    ``resume_from`` the run it goes on from, ``pages`` the page log of its collectors, if any.
    """
    assessed = stage(assess_items(raw.withColumn("run_id", F.lit(run_id)), batch_size, lexicon), "assessed")
    prepared = stage(prepare_items(assessed, lexicon), "prepared")
    items = relevant(prepared)
    backend = vectors or V.backend("hashing")
    columns = ["item_no", "item_id", "bucket", "relevance_score", "vector"]
    narrow = stage(backend(items).select(*columns), "vectors")  # the text stays where it is
    members = stage(C.assign_clusters(narrow, [threshold]), "clusters")
    rollup = stage(C.cluster_rollup(members, items), "rollup")
    dimensions = narrow.agg(F.max(F.size("vector"))).first()[0] or 0
    grouped = C.with_grouping(rollup, C.member_similarity(members, narrow), backend.label, backend.basis, dimensions)
    embedded = items if backend.model == V.HASHED[0] else items.join(narrow.select("item_id", "vector"), "item_id")
    evidence = stage(S.evidence_rows(items, lexicon), "evidence")
    summary = U.category_summary(evidence)
    volume = U.volume_summary(items, evidence)
    judged = assessed.select("source_index", "batch_index", "kept").join(
        prepared.select("source_index", "exclude_for_relevance"), "source_index", "left"
    )
    artifacts = classification_artifacts(items, created_at).unionByName(
        embedding_artifacts(embedded, created_at, backend)
    ).unionByName(cluster_artifacts(grouped, run_id, created_at))
    own = lambda rows: rows.withColumn("run_id", F.lit(run_id))
    pages = raw.sparkSession.createDataFrame([], PAGE_LOG) if pages is None else pages
    diagnostics = source_counts(raw).select(
        F.col("source_type").alias("source_key"), F.to_json(F.struct("items", "fallback_items")).alias("diagnostics_json")
    )
    run_row = volume.select(
        F.lit(run_id).alias("run_id"),
        F.lit(created_at).alias("generated_at_utc"),
        F.lit(theme).alias("venture_category"),
        F.lit(resume_from).alias("resume_from_run_id"),
        "total_items_analyzed",
        "evidence_rows",
        "demo_fallback_items",
    )
    return {
        "runs": run_row,
        "collector_diagnostics": own(diagnostics),
        "raw_items": own(raw),
        "collection_pages": own(pages),
        "collection_states": own(collection_state(pages)),
        "assessed": assessed,
        "prepared_items": items,
        "relevance_excluded_items": prepared.where("exclude_for_relevance"),
        "excluded_items": own(Q.excluded_log(assessed)),
        "filtering_summary": Q.filtering_summary(assessed),
        "exclusion_reasons": Q.reason_histogram(assessed.where(~F.col("kept")), "exclude_reasons"),
        "relevance_summary": R.relevance_summary(prepared),
        "processing_batches": own(U.batch_summary(judged)),
        "members": members,
        "clusters": rollup,
        "evidence_rows": evidence,
        "category_summaries": own(summary),
        "volume": volume,
        "uncertainty_notes": U.uncertainty_notes(volume),
        "implication_notes": U.implication_notes(summary),
        "memo": U.memo_sections(summary),
        "model_artifacts": artifacts,
    }
