"""Evidence rows: one per item and signal category, scored and filtered on the excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.functions import matching as M
from weaksift.functions import text as T
from weaksift.lexicons import CATEGORY_TITLES, DOMAIN, group_names
from weaksift.operators.relevance import MIN_RELEVANCE, context_flags

MATCHED_TERMS = 6

EVIDENCE_COLUMNS = [
    "run_id", "category", "category_title", "matched_terms", "evidence_excerpt", "item_id",
    "source_type", "source_name", "source_id", "source_url", "title", "created_at", "rating",
    "quality_score", "quality_reasons", "relevance_score", "signal_relevance_score",
    "relevance_reasons", "relevance_penalties", "is_demo_fallback", "fallback_label",
    "fallback_reason", "item_no", "category_ord",
]


def candidate_signals(items: DataFrame, lexicon: dict[str, list[str]] = DOMAIN) -> DataFrame:
    """One row per item and category with at least one term in the text (substring rule).
    ``category_ord`` is the place of the category in extraction order."""
    groups = [
        F.struct(
            F.lit(ord_).alias("category_ord"),
            F.lit(name).alias("category"),
            M.pick(F.col("found_text"), lexicon[f"signal.{name}"]).alias("matched_terms"),
        )
        for ord_, name in enumerate(group_names(lexicon, "signal."))
    ]
    return items.withColumn("_signals", F.array(*groups)).select(
        *items.columns, F.inline(F.filter("_signals", lambda s: F.size(s["matched_terms"]) > 0))
    ).withColumn("matched_terms", F.slice("matched_terms", 1, MATCHED_TERMS))


def score_signals(items: DataFrame, lexicon: dict[str, list[str]] = DOMAIN) -> DataFrame:
    """All candidate signals with ``signal_relevance_score`` and ``keep_signal``. What depends
    only on the excerpt is computed once per item, before the item fans out by category."""
    found = F.col("found_excerpt")
    count = lambda terms: F.size(M.pick(found, terms))
    per_item = items.withColumns(
        {
            "evidence_excerpt": T.excerpt(F.col("clean_text")),
            **context_flags("found_excerpt", "found_excerpt_plain", lexicon, "_x_"),
            "_x_promotion": M.any_found(found, lexicon["promotion"]),
            "_x_cultural": M.any_found(found, lexicon["cultural_quote"]),
            "_x_technical": count(lexicon["technical_detail"]),
            "_x_allowed": M.any_found(found, lexicon["technical_allowance"]),
            "_x_adoption": count(lexicon["adoption"]) * 2 + count(lexicon["strong_adoption"]) * 3,
            "_x_dissatisfaction": count(lexicon["dissatisfaction"]) * 2
            + count(lexicon["strong_dissatisfaction"]) * 3,
            "_x_scope": count(lexicon["business_scope"] + lexicon["workflow_friction"]),
            "_x_technical_grade": M.any_found(found, lexicon["technical_direct_context"])
            | (
                M.any_found(found, lexicon["technical_setup_context"])
                & M.any_found(
                    found,
                    lexicon["workflow_friction"] + lexicon["practical_tool"] + lexicon["business_scope"],
                )
            ),
        }
    )
    rows = candidate_signals(per_item, lexicon)
    scored = rows.withColumn("signal_relevance_score", _signal_score())
    return scored.withColumn("keep_signal", _keep()).withColumn(
        "category_title", F.coalesce(_title(), F.col("category"))
    )


def evidence_rows(items: DataFrame, lexicon: dict[str, list[str]] = DOMAIN) -> DataFrame:
    return score_signals(items, lexicon).where("keep_signal").select(*EVIDENCE_COLUMNS)


def _title() -> Column:
    title = F.lit(None).cast("string")
    for category, text in CATEGORY_TITLES.items():
        title = F.when(F.col("category") == category, F.lit(text)).otherwise(title)
    return title


def _signal_score() -> Column:
    pain, anchored = F.col("_x_concrete_pain"), F.col("_x_anchored")
    points = lambda condition, value: F.when(condition, value).otherwise(0)
    return (
        F.coalesce(F.col("relevance_score"), F.lit(0))
        + points(F.col("category") == "adoption_barriers", F.col("_x_adoption"))
        + points(F.col("category") == "dissatisfaction_current_solutions", F.col("_x_dissatisfaction"))
        + points(F.col("category") == "recurring_problem_signals", F.col("_x_scope"))
        + points((F.col("category") == "unmet_needs") & ~F.col("_x_unmet_context"), F.lit(-12))
        + points(F.col("_x_promotion") & ~pain, F.lit(-8))
        + points(F.col("_x_cultural") & ~anchored, F.lit(-14))
        + points(~anchored, F.lit(-10))
        + F.when((F.col("_x_technical") >= 3) & ~F.col("_x_allowed"), -8)
        .when((F.col("_x_technical") >= 5) & ~pain, -6)
        .otherwise(0)
    )


def _keep() -> Column:
    discussion = F.coalesce(F.col("source_type"), F.lit("")) == "discussion"
    return (
        F.col("_x_anchored")
        & ((F.col("category") != "unmet_needs") | F.col("_x_unmet_context"))
        & (~discussion | F.col("_x_discussion_grade"))
        & (~F.col("_x_promotion") | F.col("_x_concrete_pain"))
        & ((F.col("_x_technical") < 5) | F.col("_x_technical_grade"))
        & (F.col("signal_relevance_score") >= MIN_RELEVANCE)
    )
