"""Relevance scoring of kept items, with reasons and penalties.

Each lexicon becomes one array of hits; the rules are sums of conditions over
those arrays. The same conditions serve the per-signal score, which reads the
excerpt instead of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.functions import matching as M
from weaksift.lexicons import DOMAIN

MIN_RELEVANCE = 4

HIT_LISTS = [
    "business_scope", "workflow_friction", "practical_tool", "ai_operational", "adoption",
    "dissatisfaction", "promotion", "cultural_quote", "technical_detail",
    "generic_enterprise", "quote",
]


def context_flags(found: str, found_plain: str, lexicon: dict[str, list[str]], prefix: str) -> dict[str, Column]:
    """The shared predicates. ``found`` follows the word rule, ``found_plain`` holds padded
    substrings (the actor tests look for a term between spaces)."""
    word, plain = F.col(found), F.col(found_plain)
    scope = M.any_found(word, lexicon["business_scope"] + lexicon["workflow_friction"] + lexicon["practical_tool"])
    process = M.any_found(word, lexicon["workflow_friction"] + lexicon["practical_tool"])
    pain = M.any_found(word, lexicon["adoption"] + lexicon["dissatisfaction"])
    anchor = M.any_found(word, lexicon["context_anchor"])
    concrete = scope & pain & M.any_found(plain, lexicon["pain_actors"])
    unmet = (
        M.any_found(word, lexicon["unmet_need"])
        & anchor
        & (process | M.any_found(word, lexicon["unmet_need_setting"]))
    )
    return {
        f"{prefix}anchored": anchor,
        f"{prefix}concrete_pain": concrete,
        f"{prefix}unmet_context": unmet,
        f"{prefix}discussion_grade": concrete | unmet | (anchor & pain & process),
    }


def score_relevance(items: DataFrame, lexicon: dict[str, list[str]] = DOMAIN) -> DataFrame:
    """Adds ``relevance_score``, ``relevance_reasons``, ``relevance_penalties`` and
    ``exclude_for_relevance`` to scanned items."""
    hits = items.withColumns(
        {
            **{f"_{name}": M.pick(F.col("found_words"), lexicon[name]) for name in HIT_LISTS},
            **context_flags("found_words", "found_all", lexicon, "_"),
            "_first_person": M.any_found(F.col("found_all"), lexicon["first_person_actors"])
            & M.any_found(F.col("found_all"), lexicon["adoption"] + lexicon["dissatisfaction"]),
            "_scope_escape": M.any_found(F.col("found_all"), lexicon["generic_scope_escape"]),
            "_link_drop": (F.col("link_count") >= 2)
            | ((F.col("link_count") == 1) & (F.greatest(F.lit(1), F.col("word_count")) < 35)),
            "_is_review": F.coalesce(F.col("source_type"), F.lit("")) == "review",
            "_is_discussion": F.coalesce(F.col("source_type"), F.lit("")) == "discussion",
        }
    ).withColumns({f"_n_{name}": F.size(f"_{name}") for name in HIT_LISTS})
    n = lambda name: F.col(f"_n_{name}")
    has = lambda name: n(name) > 0
    flagged = hits.withColumn("_context", has("business_scope") | has("workflow_friction") | has("practical_tool"))

    gains, losses = _gains(n, has), _losses(n, has)
    scored = flagged.withColumns(
        {
            "relevance_score": sum((F.when(c, p).otherwise(0) for c, p, _ in gains + losses), F.lit(0)),
            "_reasons": F.array_compact(F.array(*[F.when(c, text) for c, _, text in gains])),
            "relevance_penalties": F.array_compact(F.array(*[F.when(c, text) for c, _, text in losses])),
        }
    )
    return scored.select(
        *items.columns,
        "relevance_score",
        F.when(F.size("_reasons") > 0, F.col("_reasons"))
        .otherwise(F.array(F.lit("low_positive_relevance")))
        .alias("relevance_reasons"),
        "relevance_penalties",
        (
            ~F.col("_anchored")
            | (F.col("_is_discussion") & ~F.col("_discussion_grade"))
            | (has("promotion") & ~F.col("_concrete_pain"))
            | ((n("technical_detail") >= 5) & ~F.col("_concrete_pain"))
            | (F.col("relevance_score") < MIN_RELEVANCE)
        ).alias("exclude_for_relevance"),
    )


def _gains(n, has) -> list[tuple[Column, Column, Column]]:
    """(condition, points, reason), in report order."""
    capped = lambda name, per_hit, cap: F.least(F.lit(cap), n(name) * per_hit)
    reason = lambda code, name, first: M.reason(code, F.col(f"_{name}"), first)
    return [
        (has("business_scope"), capped("business_scope", 3, 9), reason("business_scope_terms", "business_scope", 6)),
        (
            has("workflow_friction"),
            capped("workflow_friction", 2, 8),
            reason("workflow_friction_terms", "workflow_friction", 6),
        ),
        (has("practical_tool"), capped("practical_tool", 2, 5), reason("practical_tool_terms", "practical_tool", 6)),
        (
            has("ai_operational") & (has("business_scope") | has("workflow_friction")),
            capped("ai_operational", 1, 3),
            reason("ai_operational_terms", "ai_operational", 4),
        ),
        (has("adoption"), capped("adoption", 1, 5), reason("adoption_terms", "adoption", 6)),
        (has("dissatisfaction"), capped("dissatisfaction", 1, 4), reason("dissatisfaction_terms", "dissatisfaction", 6)),
        (F.col("_first_person"), F.lit(2), F.lit("first_person_or_team_problem")),
        (F.col("_is_review") & F.col("_context"), F.lit(1), F.lit("implementation_feedback_source")),
    ]


def _losses(n, has) -> list[tuple[Column, Column, Column]]:
    pain, anchored, context = F.col("_concrete_pain"), F.col("_anchored"), F.col("_context")
    technical = n("technical_detail")
    reason = lambda code, name, first: M.reason(code, F.col(f"_{name}"), first)
    complaint = has("adoption") | has("dissatisfaction")

    # The technical rules form a chain: the first that holds applies.
    chain = [
        ((technical >= 5) & ~pain, -10, "engineering_heavy_weak_venture_context", 6),
        ((technical >= 3) & ~context, -8, "low_level_technical_debugging", 5),
        (
            (technical >= 2) & ~(has("business_scope") | has("workflow_friction")),
            -5,
            "api_or_debug_detail_weak_business_context",
            5,
        ),
        ((technical >= 4) & context & ~pain, -3, "technical_detail_needs_stronger_operational_pain", 5),
    ]
    technical_points = F.lit(0)
    technical_reason = F.lit(None).cast("string")
    for condition, points, code, first in reversed(chain):
        technical_points = F.when(condition, F.lit(points)).otherwise(technical_points)
        technical_reason = F.when(condition, reason(code, "technical_detail", first)).otherwise(technical_reason)

    return [
        (has("promotion") & pain, F.lit(-4), reason("promotion_with_some_user_pain", "promotion", 4)),
        (has("promotion") & ~pain, F.lit(-11), reason("founder_launch_or_self_promotion", "promotion", 4)),
        (F.col("_link_drop"), F.lit(-4), F.lit("link_drop_density")),
        (
            has("cultural_quote") & anchored,
            F.lit(-5),
            reason("cultural_or_quote_reference_with_context", "cultural_quote", 4),
        ),
        (
            has("cultural_quote") & ~anchored,
            F.lit(-14),
            reason("cultural_or_quote_reference_no_operational_context", "cultural_quote", 4),
        ),
        (F.lit(True), technical_points, technical_reason),
        (
            has("generic_enterprise") & ~F.col("_scope_escape"),
            F.lit(-4),
            reason("generic_enterprise_weak_scope", "generic_enterprise", 4),
        ),
        (has("quote") & ~(complaint | anchored), F.lit(-7), reason("off_topic_or_quote_like", "quote", 3)),
        (~anchored, F.lit(-10), F.lit("missing_business_workflow_or_tool_context_anchor")),
        (anchored & ~context & ~complaint, F.lit(-4), F.lit("weak_operational_tool_relevance")),
    ]


def relevance_profile(prepared: DataFrame) -> DataFrame:
    """One row: kept and filtered counts with the score range of the kept (0 when none)."""
    kept = ~F.col("exclude_for_relevance")
    return prepared.agg(
        F.count_if(kept).alias("kept_items"),
        F.count_if(~kept).alias("relevance_filtered_items"),
        F.coalesce(F.min(F.when(kept, F.col("relevance_score"))), F.lit(0)).alias("min_relevance_score"),
        F.coalesce(F.max(F.when(kept, F.col("relevance_score"))), F.lit(0)).alias("max_relevance_score"),
    )


def relevance_summary(prepared: DataFrame) -> DataFrame:
    return prepared.agg(
        F.count("*").alias("evidence_candidates_after_quality_filter"),
        F.count_if(~F.col("exclude_for_relevance")).alias("evidence_candidates_after_relevance_filter"),
        F.count_if("exclude_for_relevance").alias("relevance_filtered_items"),
    )
