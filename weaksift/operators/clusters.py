"""Evidence clusters: connected items of a bucket, numbered, rolled up and listed.

A cluster may hold most of the data, so its members are rows, not an array. Only
what is bounded by definition (five representatives, eight terms, ten
similarities) is collected per cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.functions import text as T
from weaksift.lexicons import BUCKET_LABELS, BUCKET_OPPORTUNITIES
from weaksift.operators.components import connected_items, items_of_forest, similarity_forest
from weaksift.operators.labels import member_fingerprint
from weaksift.operators.numbering import global_rank
from weaksift.operators.vectors import HASHED, cosine, round_half_up, token_lists, top_terms_of_groups
from weaksift.plans.stages import stage

DEFAULT_THRESHOLD = 0.12
REPRESENTATIVES = 5
SIMILARITIES = 10

# Model names and grouping notes of the artifact records.
CLUSTERER = ("heuristic-evidence-clusterer", "v2")
HASHED_MODEL = f"{HASHED[0]}@{HASHED[1]}"
HASHED_BASIS = HASHED[2]

CLUSTER = ["threshold", "bucket", "cluster_index", "cluster_id"]


def item_forest(items: DataFrame, levels: list[float], **options) -> DataFrame:
    """The similarity forest of ``items`` (``item_no``, ``bucket``, ``vector``; a stage), for any thresholds out of ``levels``."""
    return similarity_forest(items.select(F.col("item_no").alias("node"), "bucket", "vector"), levels, **options)


def assign_clusters(
    items: DataFrame, thresholds: list[float] = [DEFAULT_THRESHOLD], forest: DataFrame | None = None, **options
) -> DataFrame:
    """``items`` has ``item_no``, ``item_id``, ``bucket``, ``vector`` and ``relevance_score``.
    Returns one row per threshold and item with its cluster. With a ``forest`` (``item_forest``) no vector is compared."""
    nodes = items.select(F.col("item_no").alias("node"), "item_id", "bucket", "relevance_score", "vector")
    narrow = stage(nodes if forest is None else nodes.drop("vector"), "nodes")
    if forest is None:
        found = connected_items(narrow, thresholds, **options)
    else:
        found = items_of_forest(narrow, forest, thresholds)
    by_threshold = F.element_at(F.lit([float(t) for t in thresholds]), F.col("t") + 1).alias("threshold")
    members = stage(
        found.join(narrow.drop("vector"), "node").select(
            by_threshold, "bucket", "component", "node", "item_id", "relevance_score"
        ),
        "members",
    )
    clusters = members.groupBy("threshold", "bucket", "component").agg(
        F.max("relevance_score").alias("_best"), F.min("item_id").alias("_least")
    )
    numbered = global_rank(
        clusters, ["threshold", "bucket"], [F.desc("_best"), F.asc("_least")], "cluster_index"
    )
    per_bucket = numbered.groupBy("threshold", "bucket").agg(F.count("*").alias("_clusters"))
    named = numbered.join(per_bucket, ["threshold", "bucket"]).select(
        "threshold", "bucket", "component", F.col("cluster_index").cast("long"), _cluster_id().alias("cluster_id")
    )
    return members.join(named, ["threshold", "bucket", "component"]).select(
        *CLUSTER, "item_id", F.col("node").alias("item_no"), "relevance_score"
    )


def _cluster_id() -> Column:
    plain = F.concat(F.lit("cluster-"), "bucket")
    return F.when(F.col("_clusters") == 1, plain).otherwise(F.concat(plain, F.lit("-"), F.col("cluster_index").cast("string")))


def _lookup(values: dict[str, str], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key))


def leading_members(members: DataFrame, how_many: int = SIMILARITIES) -> DataFrame:
    """The first members of each cluster by (-score, item_id); ``place`` 1 represents it. The rank
    filter also runs before the shuffle, so a giant cluster sends a few rows per task."""
    w = W.partitionBy("threshold", "cluster_id").orderBy(F.desc("relevance_score"), "item_id")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= how_many)


def member_similarity(members: DataFrame, items: DataFrame) -> DataFrame:
    """Similarity of the first ten members to the representative of their cluster."""
    leading = leading_members(members).join(items.select("item_id", "vector"), "item_id")
    head = leading.where("place = 1").select("threshold", "cluster_id", F.col("vector").alias("_head"))
    return leading.join(head, ["threshold", "cluster_id"]).select(
        "threshold", "cluster_id", "place", "item_id",
        round_half_up(cosine(F.col("_head"), F.col("vector")), 4).alias("similarity"),
    )


def with_grouping(rollup: DataFrame, similarity: DataFrame, model: str, basis: str, dimensions: int) -> DataFrame:
    """The roll-up with what its clusters were made by, for their artifacts. ``similarity``: the rows of
    ``member_similarity``, ten a cluster at most."""
    entry = F.struct("item_id", "similarity").alias("entry")
    listed = similarity.groupBy("threshold", "cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", entry))), lambda e: e["entry"]).alias("member_similarity_to_representative")
    )
    return rollup.join(listed, ["threshold", "cluster_id"], "left").select(
        *rollup.columns,
        "member_similarity_to_representative",
        F.col("threshold").alias("similarity_threshold"),
        F.lit(model).alias("embedding_model"),
        F.lit(dimensions).alias("embedding_dimensions"),
        F.lit(basis).alias("grouping_basis"),
    )


def cluster_rollup(members: DataFrame, items: DataFrame) -> DataFrame:
    """One row per cluster. ``items`` are the tagged items with ``vector`` and ``batch_index``."""
    # What a branch needs of the text is derived before the join, so the text itself never moves.
    facts = items.select(
        "item_id",
        "source_id",
        "source_type",
        "batch_index",
        token_lists().alias("tokens"),
        T.compact(F.col("clean_text")).alias("excerpt"),
        F.conv(F.substring(member_fingerprint(), 1, 15), 16, 10).cast("decimal(38,0)").alias("_number"),
    )
    facts = stage(facts, "facts")  # a row an item; with the members its tokens would be written once a threshold
    details = stage(members.join(facts.drop("tokens"), "item_id"), "details")
    key = ["threshold", "cluster_id"]
    by_type = details.groupBy(*CLUSTER, "source_type").agg(
        F.count("*").alias("n"),
        F.sum("relevance_score").alias("_total"),
        F.max("relevance_score").alias("_most"),
        F.min("batch_index").alias("_batch"),
        F.sum("_number").alias("_hash_sum"),
    )
    counts = by_type.groupBy(*CLUSTER).agg(  # one entry per source type
        F.sum("n").alias("item_count"),
        F.sum("_total").alias("_total"),
        F.max("_most").alias("max_relevance_score"),
        F.min("_batch").alias("batch_index"),
        F.sum("_hash_sum").alias("_hash_sum"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("source_type", "n"))),
            lambda e: F.concat(e["source_type"], F.lit("="), e["n"].cast("string")),
        ).alias("source_mix"),
    )
    leading = leading_members(details, REPRESENTATIVES)
    in_order = lambda name: F.transform(
        F.array_sort(F.collect_list(F.struct("place", name))), lambda e: e[name]
    )
    representatives = leading.groupBy(*key).agg(  # at most five rows each
        in_order("item_id").alias("representative_item_ids"),
        in_order("source_id").alias("representative_source_ids"),
        in_order("excerpt").alias("evidence_excerpts"),
    )
    sizes = members.groupBy(*key).agg(F.count("*").alias("_size"))
    worded = members.select(*key, "item_id").join(sizes, key).join(facts.select("item_id", "tokens"), "item_id")
    terms = top_terms_of_groups(worded, key, "_size", "item_id")
    # Half-up average to two places in whole numbers, so that no binary fraction decides a tie.
    cents = F.call_function("div", F.col("_total") * 200 + F.col("item_count"), F.col("item_count") * 2)
    return (
        counts.join(representatives, key)
        .join(terms, key, "left")
        .select(
            *CLUSTER,
            F.coalesce(_lookup(BUCKET_LABELS, "bucket"), "bucket").alias("label"),
            F.coalesce(_lookup(BUCKET_OPPORTUNITIES, "bucket"), F.lit("")).alias("product_opportunity"),
            "item_count",
            "representative_item_ids",
            "representative_source_ids",
            "source_mix",
            (cents / 100.0).alias("average_relevance_score"),
            "max_relevance_score",
            F.coalesce("top_terms", F.array().cast("array<string>")).alias("top_terms"),
            "evidence_excerpts",
            "batch_index",
            _fingerprint().alias("input_hash"),
        )
    )


def _fingerprint() -> Column:
    """A cluster's fingerprint must not need its members in one place, so it combines their own
    fingerprints by a sum, which has no order."""
    return F.sha2(
        F.concat_ws("\n", "cluster_id", F.col("item_count").cast("string"), F.col("_hash_sum").cast("string")), 256
    )


def cluster_table(rollup: DataFrame, model: str = HASHED_MODEL, basis: str = HASHED_BASIS) -> DataFrame:
    """The flat export of the roll-up."""
    return rollup.select(
        "cluster_id",
        F.col("bucket").alias("cluster_key"),
        "label",
        "product_opportunity",
        "item_count",
        F.when(F.size("source_mix") == 0, "none").otherwise(F.array_join("source_mix", ", ")).alias("source_mix"),
        "average_relevance_score",
        "max_relevance_score",
        F.array_join("top_terms", ", ").alias("top_terms"),
        F.array_join("representative_item_ids", ", ").alias("representative_item_ids"),
        F.array_join("representative_source_ids", ", ").alias("representative_source_ids"),
        F.lit(basis).alias("grouping_basis"),
        F.lit(model).alias("embedding_model"),
        F.col("threshold").alias("similarity_threshold"),
    )


def review_rows(members: DataFrame, items: DataFrame, rollup: DataFrame) -> DataFrame:
    """The sheet a reviewer labels: one row per member, its bucket as the proposed label."""
    terms = rollup.select("threshold", "cluster_id", F.array_join("top_terms", ", ").alias("top_terms"))
    return (
        members.join(items.drop("bucket", "relevance_score", "item_no"), "item_id")
        .join(terms, ["threshold", "cluster_id"])
        .select(
            "source_id",
            "item_id",
            F.col("cluster_id").alias("current_cluster_id"),
            F.col("bucket").alias("current_cluster_key"),
            F.col("bucket").alias("reviewed_cluster_label"),
            "source_type",
            "source_name",
            "title",
            "relevance_score",
            "source_url",
            "top_terms",
            T.compact(F.col("clean_text"), 320).alias("text_excerpt"),
        )
    )


def missing_members(members: DataFrame, items: DataFrame) -> DataFrame:
    """Members whose item is unknown; a review sheet needs this to be empty."""
    return members.join(items.select("item_id"), "item_id", "left_anti")


def label_template(review: DataFrame) -> DataFrame:
    """source_id -> label; of several rows the last in sheet order wins."""
    return review.groupBy("source_id").agg(
        F.max_by("reviewed_cluster_label", F.struct("current_cluster_key", "item_id")).alias("label")
    )
