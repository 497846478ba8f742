"""Quality decision: keep user-like text, set aside job ads, promotion and listings, and say why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.functions import matching as M
from weaksift.functions import text as T
from weaksift.lexicons import DOMAIN

MIN_SCORE = 2  # score gate of the two known source types


def assess_quality(scanned: DataFrame, lexicon: dict[str, list[str]] = DOMAIN) -> DataFrame:
    """Adds ``quality_score``, ``quality_reasons``, ``exclude_reasons`` and ``kept``."""
    hits = scanned.withColumns(
        {
            "_job": M.pick(F.col("found_all"), lexicon["job"]),
            "_promo": M.pick(F.col("found_all"), lexicon["promotional"]),
            "_directory": M.pick(F.col("found_all"), lexicon["directory"]),
            "_talk": M.pick(F.col("found_all"), lexicon["conversational"]),
            "_quality": M.pick(F.col("found_all"), lexicon["quality"]),
            "_is_review": F.coalesce(F.col("source_type"), F.lit("")) == "review",
            "_is_discussion": F.coalesce(F.col("source_type"), F.lit("")) == "discussion",
            "_rated": F.coalesce(F.col("rating"), F.lit("")) != "",
            "_comment_like": _comment_like(lexicon),
            "_review_like": _review_like(lexicon),
            "_self_description": _self_description(lexicon),
            "_remote_job": M.any_found(F.col("found_all"), lexicon["remote"])
            & M.any_found(F.col("found_all"), lexicon["remote_job_context"]),
        }
    )
    scored = hits.withColumns({"quality_score": _score(), "_reasons": _reasons()})
    excluded = scored.withColumn("exclude_reasons", _exclude_reasons())
    return excluded.select(
        *scanned.columns,
        "quality_score",
        F.when(F.size("_reasons") > 0, F.col("_reasons"))
        .otherwise(F.array(F.lit("low_user_evidence_signal")))
        .alias("quality_reasons"),
        "exclude_reasons",
        (F.size("exclude_reasons") == 0).alias("kept"),
    )


def _comment_like(lexicon) -> Column:
    return (
        F.col("word_count").between(8, 220)
        & F.col("has_sentence_mark")
        & _inside_text(lexicon["opinion_markers"])
    )


def _inside_text(terms: list[str]) -> Column:
    """Terms tested on the bare text: the padding must not complete one. The scan pads the
    text with a space on each side, so a term that ends in a space needs one more check."""
    plain = [t for t in terms if t == t.rstrip(" ")]
    tailed = [t for t in terms if t != t.rstrip(" ")]
    found = M.any_found(F.col("found_text"), plain)
    if tailed:
        lowered = F.lower(F.col("clean_text"))
        found = found | F.when(
            M.any_found(F.col("found_text"), tailed),
            F.exists(M.literal_array(tailed), lambda term: F.contains(lowered, term)),
        ).otherwise(F.lit(False))
    return found


def _review_like(lexicon) -> Column:
    return F.col("word_count").between(6, 260) & (
        M.any_found(F.col("found_text"), lexicon["experience_markers"])
        | M.any_found(F.col("found_text"), lexicon["quality"])
    )


def _self_description(lexicon) -> Column:
    opening = F.lit(False)
    for start in lexicon["company_openings"]:
        opening = opening | F.startswith(F.col("opening"), F.lit(start))
    return (
        opening
        & M.any_found(F.col("found_text"), lexicon["promotional"])
        & ~M.any_found(F.col("found_text"), lexicon["customer_voice"])
    )


def _score() -> Column:
    one = lambda condition: condition.cast("int")
    return (
        one(F.size("_talk") > 0)
        + F.least(F.lit(2), F.size("_quality"))
        + one(F.col("_is_review") & F.col("_rated"))
        + one(F.col("_is_discussion") & F.col("_comment_like"))
        + one(F.col("_is_review") & F.col("_review_like"))
    )


def _reasons() -> Column:
    talk = F.concat(
        F.lit("conversational_language:"), F.trim(F.array_join(F.slice("_talk", 1, 3), ", "))
    )
    return F.array_compact(
        F.array(
            F.when(F.size("_talk") > 0, talk),
            F.when(F.size("_quality") > 0, M.reason("venture_signal_language", F.col("_quality"), 5)),
            F.when(F.col("_is_review") & F.col("_rated"), F.lit("has_customer_rating")),
            F.when(F.col("_is_discussion") & F.col("_comment_like"), F.lit("comment_like_length_or_style")),
            F.when(F.col("_is_review") & F.col("_review_like"), F.lit("review_like_experience_statement")),
        )
    )


def _exclude_reasons() -> Column:
    low = F.col("quality_score") < MIN_SCORE
    return F.array_compact(
        F.array(
            F.when(F.size("_job") > 0, M.reason("job_or_careers_language", F.col("_job"), 4)),
            F.when(F.col("_remote_job"), F.lit("job_or_careers_language:remote_with_job_context")),
            F.when(F.size("_promo") >= 2, M.reason("promotional_or_landing_copy", F.col("_promo"), 4)),
            F.when(F.size("_directory") > 0, M.reason("directory_or_listing_snippet", F.col("_directory"), 4)),
            F.when(F.col("_self_description"), F.lit("company_self_description")),
            F.when(F.col("clean_text") == "", F.lit("empty_text")),
            F.when(F.col("_is_discussion") & low, F.lit("discussion_text_not_comment_like")),
            F.when(F.col("_is_review") & low, F.lit("review_text_not_customer_feedback_like")),
        )
    )


def excluded_log(assessed: DataFrame) -> DataFrame:
    """The log row of every item set aside."""
    return assessed.where(~F.col("kept")).select(
        "source_index",
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        "source_name",
        "source_id",
        "source_url",
        "title",
        T.excerpt(F.col("clean_text"), 220).alias("text_excerpt"),
        "kept",
        "quality_score",
        "quality_reasons",
        "exclude_reasons",
        "is_demo_fallback",
    )


def filtering_summary(assessed: DataFrame) -> DataFrame:
    """Counts of raw, kept and excluded rows per source type, with a total row (null type)."""
    return (
        assessed.withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))
        .rollup("source_type")
        .agg(
            F.count("*").alias("raw_items"),
            F.count_if("kept").alias("kept_items"),
            F.count_if(~F.col("kept")).alias("excluded_items"),
        )
    )


def reason_histogram(rows: DataFrame, reasons: str) -> DataFrame:
    """How often each reason code occurs; a row can count one code twice."""
    return (
        rows.select(F.explode(reasons).alias("reason"))
        .groupBy(F.substring_index("reason", ":", 1).alias("reason_code"))
        .agg(F.count("*").alias("reason_count"))
    )
