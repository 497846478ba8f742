"""Labels, cluster buckets and fingerprints of prepared items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaksift.functions import matching as M
from weaksift.functions import text as T
from weaksift.lexicons import DOMAIN, GENERAL_BUCKET, group_names


def tag_items(prepared: DataFrame, lexicon: dict[str, list[str]] = DOMAIN) -> DataFrame:
    """Adds ``labels``, ``primary_label`` and ``bucket``.

    Labels look at title, text and relevance reasons; buckets also at quality reasons. The
    scan already knows the terms of title + text, so only the reasons are searched here, with
    as many characters before them as a term could reach back.
    """
    label_groups, bucket_groups = group_names(lexicon, "label."), group_names(lexicon, "bucket.")
    terms = list(
        dict.fromkeys(
            [t for g in label_groups for t in lexicon[f"label.{g}"]]
            + [t for g in bucket_groups for t in lexicon[f"bucket.{g}"]]
        )
    )
    reach = max((len(t) for t in terms), default=1)
    tail = F.lower(
        F.concat(
            F.right(F.concat("title", F.lit(" "), "clean_text"), F.lit(reach)),
            F.lit(" "),
            T.join_reasons(F.col("relevance_reasons")),
        )
    )
    found = (
        prepared.withColumn("_tail", tail)
        .withColumn(
            "_long_tail", F.concat("_tail", F.lit(" "), F.lower(T.join_reasons(F.col("quality_reasons"))))
        )
        .withColumns(
            {
                "_label_found": F.array_union("found_all", M.substring_hits(F.col("_tail"), terms)),
                "_bucket_found": F.array_union("found_all", M.substring_hits(F.col("_long_tail"), terms)),
            }
        )
    )
    labels = F.array_compact(
        F.array(
            *[
                F.when(M.any_found(F.col("_label_found"), lexicon[f"label.{g}"]), F.lit(g))
                for g in label_groups
            ],
            F.when(F.col("source_type") == "review", F.lit("implementation_feedback")),
        )
    )
    return found.withColumns({"labels": labels, "_best": _best_bucket(lexicon, bucket_groups)}).select(
        *prepared.columns,
        "labels",
        F.when(F.size("labels") > 0, F.element_at("labels", 1))
        .otherwise(F.lit("general_signal"))
        .alias("primary_label"),
        F.when(F.col("_best.n") > 0, F.col("_best.bucket")).otherwise(F.lit(GENERAL_BUCKET)).alias("bucket"),
    )


def _best_bucket(lexicon, groups: list[str]) -> Column:
    """The group with most terms found; the earlier group wins a tie; none found is general."""
    counts = [
        F.struct(
            F.size(M.pick(F.col("_bucket_found"), lexicon[f"bucket.{g}"])).alias("n"),
            F.lit(-i).alias("priority"),
            F.lit(g).alias("bucket"),
        )
        for i, g in enumerate(groups)
    ]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("priority"), F.lit(GENERAL_BUCKET).alias("bucket"))
    return F.array_max(F.array(none, *counts))


def item_fingerprint() -> Column:
    """SHA-256 of the newline-joined fields an artifact depends on."""
    fields = F.concat_ws(
        "\n",
        "source_id",
        "title",
        "clean_text",
        F.col("relevance_score").cast("string"),
        T.join_reasons(F.col("relevance_reasons")),
        T.join_reasons(F.col("relevance_penalties")),
    )
    return F.sha2(fields, 256)


def member_fingerprint() -> Column:
    """SHA-256 of one member's line in a cluster fingerprint."""
    return F.sha2(
        F.concat_ws("|", "item_id", "source_id", "title", "clean_text", F.col("relevance_score").cast("string")), 256
    )
