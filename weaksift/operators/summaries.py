"""Roll-ups of items, batches and evidence, and the notes that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.lexicons import CATEGORY_TITLES

TOP_TERMS = 5
EXAMPLES = 3
SMALL_SAMPLE = 10

# Memo sections and note texts.
SECTION_NUMBERS = {
    "recurring_problem_signals": 6, "unmet_needs": 7, "adoption_barriers": 8,
    "dissatisfaction_current_solutions": 9, "differentiation_opportunities": 10,
    "community_traction_clues": 11, "competing_solution_mentions": 12,
}
NO_EVIDENCE = "No strong heuristic evidence found in this run."
DIRECTIONAL_NOTE = "The evidence is directional and should be treated as weak-signal input for diligence questions."
COUNT_NOTE = "A higher evidence count means more heuristic matches, not higher investment quality."
FALLBACK_NOTE = (
    " item(s) came from built-in fallback records because one or more live public endpoints were unavailable."
)
SMALL_NOTE = "The analyzed sample is small; results are useful for demo framing but not market validation."
EMPTY_NOTE = (
    "No heuristic evidence rows were extracted; expand the query or source coverage before interpreting results."
)
IMPLICATIONS = {
    "recurring_problem_signals": "Recurring operational-pain language can help shape diligence questions around pain intensity, workflow frequency, and buyer urgency.",
    "unmet_needs": "Unmet-need evidence may indicate spaces where current solutions are incomplete or poorly matched to user expectations.",
    "adoption_barriers": "Adoption barriers should be tested directly because friction can limit traction even when demand exists.",
    "differentiation_opportunities": "Differentiation clues can inform product wedge hypotheses and competitive positioning questions.",
    "competing_solution_mentions": "Competitor mentions suggest the evaluator should map alternatives, switching costs, and perceived gaps.",
}
NO_IMPLICATION = "This run did not surface enough evidence to support strong venture-evaluation implications."


def batch_summary(items: DataFrame, keys: list[str] = ["batch_index"]) -> DataFrame:
    """``items``: every raw item with ``batch_index``, ``source_index``, ``kept`` and, for kept
    ones, ``exclude_for_relevance``. One row per batch (of a run, with ``run_id`` among the keys)."""
    return items.groupBy(*keys).agg(
        F.lit("completed").alias("status"),
        F.min("source_index").alias("raw_item_start_index"),
        F.max("source_index").alias("raw_item_end_index"),
        F.count("*").alias("raw_items"),
        F.count_if("kept").alias("quality_candidates"),
        F.count_if(~F.col("kept")).alias("quality_excluded"),
        F.count_if(F.col("kept") & ~F.col("exclude_for_relevance")).alias("relevance_prepared"),
        F.count_if(F.col("kept") & F.col("exclude_for_relevance")).alias("relevance_excluded"),
    )


def volume_summary(prepared: DataFrame, evidence: DataFrame) -> DataFrame:
    volume = prepared.agg(
        F.count("*").alias("total_items_analyzed"),
        F.count_if(F.col("source_type") == "discussion").alias("discussion_items"),
        F.count_if(F.col("source_type") == "review").alias("review_items"),
        F.count_if("is_demo_fallback").alias("demo_fallback_items"),
    )
    return volume.join(F.broadcast(evidence.agg(F.count("*").alias("evidence_rows"))))  # one row each


def evidence_order() -> list:
    """Score first; ties in the order the evidence was extracted."""
    return [F.desc("signal_relevance_score"), F.asc("item_no"), F.asc("category_ord")]


def categories(spark, titles: dict[str, str] = CATEGORY_TITLES) -> DataFrame:
    rows = [(i, name, title) for i, (name, title) in enumerate(titles.items(), start=1)]
    return spark.createDataFrame(rows, "summary_ord int, category string, title string")


def category_terms(evidence: DataFrame, how_many: int = TOP_TERMS) -> DataFrame:
    """Top matched terms per category; equal counts in first-seen order of the sorted evidence."""
    seen = evidence.select(
        "category", "signal_relevance_score", "item_no", F.posexplode("matched_terms").alias("pos", "term")
    )
    counts = seen.groupBy("category", "term").agg(
        F.count("*").alias("n"),
        F.min(F.struct((-F.col("signal_relevance_score")).alias("s"), "item_no", "pos")).alias("first"),
    )
    w = W.partitionBy("category").orderBy(F.desc("n"), "first")  # one row per lexicon term
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= how_many)


def category_examples(evidence: DataFrame, how_many: int = EXAMPLES) -> DataFrame:
    """The best evidence rows of each category. The rank filter also runs before the shuffle."""
    w = W.partitionBy("category").orderBy(*evidence_order())
    return evidence.withColumn("place", F.row_number().over(w)).where(F.col("place") <= how_many)


def category_summary(evidence: DataFrame, titles: dict[str, str] = CATEGORY_TITLES) -> DataFrame:
    """One row per category: those with a title, also without evidence, then any other that the evidence
    has (a user's lexicon may name its own), by name and with the name as title."""
    counts = evidence.groupBy("category").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(F.col("source_type") == "discussion").alias("discussion_count"),
        F.count_if(F.col("source_type") == "review").alias("review_count"),
    )
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda e: e[value])
    terms = category_terms(evidence).groupBy("category").agg(ordered("term").alias("top_terms"))
    examples = category_examples(evidence).groupBy("category").agg(
        ordered("evidence_excerpt").alias("example_evidence"),
        ordered("signal_relevance_score").alias("example_scores"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    found = F.concat(
        F.lit("Found "), F.col("evidence_count").cast("string"), F.lit(" evidence item(s). Common indicators: "),
        F.array_join("top_terms", ", "), F.lit("."),
    )
    later = F.row_number().over(W.partitionBy(F.col("summary_ord").isNull()).orderBy("category")) + len(titles)  # a row per category
    return (
        categories(evidence.sparkSession, titles)
        .join(counts, "category", "full_outer")
        .withColumn("summary_ord", F.coalesce("summary_ord", later))
        .withColumn("title", F.coalesce("title", "category"))
        .join(terms, "category", "left")
        .join(examples, "category", "left")
        .select(
            "summary_ord",
            "category",
            "title",
            zero("evidence_count"),
            zero("discussion_count"),
            zero("review_count"),
            none("top_terms", "array<string>"),
            F.coalesce(found, F.lit(NO_EVIDENCE)).alias("summary"),
            none("example_evidence", "array<string>"),
            none("example_scores", "array<int>"),
        )
    )


def section_summary(summary: DataFrame) -> DataFrame:
    """The flat export of the category summary."""
    return summary.select(
        "category", "title", "evidence_count", "discussion_count", "review_count",
        F.array_join("top_terms", ", ").alias("top_terms"), "summary",
    )


def uncertainty_notes(volume: DataFrame) -> DataFrame:
    """Notes by rule from the one-row volume summary."""
    note = lambda ord_, condition, text: F.when(condition, F.struct(F.lit(ord_).alias("ord"), text.alias("note")))
    always = F.lit(True)
    notes = F.array_compact(
        F.array(
            note(1, always, F.lit(DIRECTIONAL_NOTE)),
            note(2, always, F.lit(COUNT_NOTE)),
            note(
                3,
                F.col("demo_fallback_items") > 0,
                F.concat(F.col("demo_fallback_items").cast("string"), F.lit(FALLBACK_NOTE)),
            ),
            note(4, F.col("total_items_analyzed") < SMALL_SAMPLE, F.lit(SMALL_NOTE)),
            note(5, F.col("evidence_rows") == 0, F.lit(EMPTY_NOTE)),
        )
    )
    return volume.select(F.inline(notes))


def implication_notes(summary: DataFrame) -> DataFrame:
    """One note per category with evidence, in rule order; a default when there is none."""
    spark = summary.sparkSession
    rules = spark.createDataFrame(
        [(i, c, text) for i, (c, text) in enumerate(IMPLICATIONS.items(), start=1)],
        "ord int, category string, note string",
    )
    hits = rules.join(summary.where("evidence_count > 0").select("category"), "category", "left_semi").select("ord", "note")
    default = hits.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(1).alias("ord"), F.lit(NO_IMPLICATION).alias("note")
    )
    return hits.unionByName(default)


def memo_sections(summary: DataFrame) -> DataFrame:
    """The memo's evidence sections as rows: the sentence (ord 0), then the scored examples."""
    number = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in SECTION_NUMBERS.items() for x in pair]), F.col("category")),
        F.col("summary_ord") + (min(SECTION_NUMBERS.values()) - 1),
    )
    examples = F.transform(
        F.arrays_zip("example_scores", "example_evidence"),
        lambda e, i: F.struct(
            (i + 1).cast("int").alias("ord"),
            F.concat(
                F.lit("Evidence (score "), e["example_scores"].cast("string"), F.lit("): "), e["example_evidence"]
            ).alias("text"),
        ),
    )
    head = F.array(F.struct(F.lit(0).alias("ord"), F.col("summary").alias("text")))
    return summary.select(number.alias("section"), "title", F.inline(F.concat(head, examples)))
