"""Inputs of the registered queries, all derived from the given tables. What several queries
share is staged once per session and table folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weaksift.lexicons import DOMAIN
from weaksift.operators import clusters as C
from weaksift.operators import components as K
from weaksift.operators import history as H
from weaksift.operators import signals as S
from weaksift.operators import summaries as U
from weaksift.operators import vectors as V
from weaksift.plans import evidence as E
from weaksift.plans.seeded import native_items, seeded_items
from weaksift.plans.stages import new_path, spread, stage
from weaksift.sources import raw_items as R
from weaksift.streaming import jobs as J

BATCH = 100
RAW_ITEM_FACTS = [
    "source_type", "source_name", "source_id", "source_url", "title", "source_index", "is_demo_fallback", "product_theme",
]
THRESHOLDS = [0.12, 0.5, 0.8, 0.9]
NATIVE_THRESHOLDS = [0.8, 0.95]
DENSE_THRESHOLDS = [0.3, 0.35, 0.4]
TURNS_PER_PAGE = 4
QUESTIONS_PER_PAGE = 10

# A user's own lexicon: the default lists, with those below replaced by terms of the given texts.
CORPUS = DOMAIN | {
    "job": ["license", "copyright"],
    "promotional": ["###", "$$$", "%%%", "&&&"],
    "directory": ["@", "token ="],
    "conversational": ["the ", "und ", "que ", "les "],
    "quality": ["tion", "heit", "ment", "stupid", "clown", "trash"],
    "opinion_markers": ["the ", "de ", "der "],
    "experience_markers": [" the ", " of ", "and"],
    "business_scope": ["the", "der", "que", "les"],
    "workflow_friction": ["heit", "ción", "tionre", "andthe"],
    "practical_tool": ["ing", "ung", "ment"],
    "context_anchor": ["the", "der", "que", "les", "trash", "idiot"],
    "adoption": ["and", "und", "la", "et"],
    "dissatisfaction": ["stupid", "idiot", "trash", "clown", "dumb"],
    "pain_actors": [" the ", " de ", " der "],
    "first_person_actors": [" in ", " en "],
    "technical_detail": ["token", "sk", "key", "api", "http", "license"],
    "promotion": ["permission is hereby", "###"],
    "quote": ["!!"],
    "label.noise": ["###", "$$$", "***"],
    "signal.rude_words": ["stupid", "idiot", "trash", "clown", "dumb"],
    "signal.word_endings": ["heit", "ción", "tionre", "andthe"],
    "bucket.germanic": ["und ", "der ", "the "],
    "bucket.romance": ["que ", "les ", "la "],
}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return seeded_items(self.spark, self.sf_dir).drop("content_key")

    @property
    def keyed(self) -> DataFrame:
        """Raw items whose source id is their document's content, so that copies share one."""
        return seeded_items(self.spark, self.sf_dir).withColumn("source_id", F.col("content_key"))

    @cached_property
    def assessed(self) -> DataFrame:
        return stage(E.assess_items(spread(self.raw), BATCH), "assessed")

    @cached_property
    def native_assessed(self) -> DataFrame:
        """The documents as they are, judged with a lexicon of terms they hold."""
        return stage(E.assess_items(spread(native_items(self.spark, self.sf_dir)), BATCH, CORPUS), "native")

    @cached_property
    def native_prepared(self) -> DataFrame:
        return stage(E.prepare_items(self.native_assessed, CORPUS), "native-prepared")

    @cached_property
    def prepared(self) -> DataFrame:
        return stage(E.prepare_items(self.assessed), "prepared")

    @property
    def native_items(self) -> DataFrame:
        return E.relevant(self.native_prepared)

    @cached_property
    def native_evidence(self) -> DataFrame:
        return stage(S.evidence_rows(self.native_items, CORPUS), "native-evidence")

    @cached_property
    def native_rollup(self) -> DataFrame:
        facts = ("item_no", "item_id", "bucket", "relevance_score", "vector")  # no text is written again
        vectors = stage(V.hashed_vectors(self.native_items).select(*facts), "native-vectors")
        members = stage(C.assign_clusters(vectors, NATIVE_THRESHOLDS), "native-clusters")
        return stage(C.cluster_rollup(members, self.native_items), "native-rollup")

    @property
    def items(self) -> DataFrame:
        return E.relevant(self.prepared)

    @cached_property
    def evidence(self) -> DataFrame:
        return stage(S.evidence_rows(self.items), "evidence")

    @cached_property
    def summary(self) -> DataFrame:
        return stage(U.category_summary(self.evidence), "summary")

    @cached_property
    def vectors(self) -> DataFrame:
        return stage(V.hashed_vectors(self.items), "vectors")

    @cached_property
    def forest(self) -> DataFrame:
        """The similarity forest of all items, which answers every threshold."""
        return C.item_forest(self.vectors, THRESHOLDS)

    @cached_property
    def members(self) -> DataFrame:
        return stage(C.assign_clusters(self.vectors, THRESHOLDS, self.forest), "clusters")

    @cached_property
    def rollup(self) -> DataFrame:
        return stage(C.cluster_rollup(self.members, self.items), "rollup")

    @cached_property
    def artifacts(self) -> DataFrame:
        items = self.items
        default = self.rollup.where(F.col("threshold") == C.DEFAULT_THRESHOLD)
        return stage(
            E.classification_artifacts(items)
            .unionByName(E.embedding_artifacts(items))
            .unionByName(E.cluster_artifacts(default, "run-00")),
            "artifacts",
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Reviewed labels: the given quality mark of a document."""
        return self.read("labels").select(
            F.col("doc_id").cast("string").alias("source_id"),
            F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("gold"),
        )

    def with_source(self, members: DataFrame) -> DataFrame:
        return members.join(self.items.select("item_id", "source_id"), "item_id")

    @cached_property
    def table_members(self) -> DataFrame:
        """Clusters of the same items by the given ``embeddings`` (no vector: alone)."""
        dims = F.array_repeat(F.lit(0.0), 64)
        backend = V.backend(
            "table", vector_table=self.read("embeddings"), id_column="vec_id", vector_column="embedding"
        )
        items = backend(self.items).withColumn("vector", F.coalesce("vector", dims))
        return stage(C.assign_clusters(items, DENSE_THRESHOLDS), "table-clusters")

    @cached_property
    def dense(self) -> DataFrame:
        """Components of the whole ``embeddings`` table."""
        nodes = self.read("embeddings").select(
            F.col("vec_id").alias("node"),
            F.lit("all").alias("bucket"),
            F.transform("embedding", lambda v: v.cast("double")).alias("vector"),
        )
        found = K.connected_items(stage(nodes, "nodes"), DENSE_THRESHOLDS)
        threshold = F.element_at(F.lit(DENSE_THRESHOLDS), F.col("t") + 1)
        return stage(found.select(threshold.alias("threshold"), "node", "component"), "dense")

    @cached_property
    def discussion_pages(self) -> DataFrame:
        """Page files of a few turns each, written and read as JSON."""
        turns = self.read("conversations").withColumn("page", F.floor(F.col("turn") / TURNS_PER_PAGE).cast("int"))
        ids = F.concat_ws("-", "conv_id", "turn")
        hit = F.struct(
            F.col("turn"),
            ids.alias("objectID"),
            F.when(F.col("role") == "assistant", F.col("conv_id").cast("string")).alias("story_id"),
            F.when(F.col("role") == "user", F.concat(F.lit("c"), "conv_id")).alias("parent_id"),
            F.lit(None).cast("string").alias("story_title"),
            F.col("role").alias("author"),
            F.lit("").alias("created_at"),
            F.col("text").alias("comment_text"),
        )
        last = turns.groupBy("conv_id").agg((F.max("page") + 1).alias("nbPages"))
        pages = (
            turns.groupBy("conv_id", "page")  # at most TURNS_PER_PAGE turns
            .agg(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h.dropFields("turn")).alias("hits"))
            .join(last, "conv_id")
            .select(
                F.concat(F.lit("conv-"), "conv_id").alias("query"),
                F.col("page").alias("page_number"),
                F.concat(F.lit("https://pages.example/"), "conv_id", F.lit("?page="), "page").alias("request_url"),
                F.create_map(F.lit("page"), F.col("page").cast("string")).alias("request_params"),
                "hits",
                "nbPages",
            )
        )
        pages.write.json(self.discussion_folder)
        return R.read_discussion_pages(self.spark, self.discussion_folder)

    @cached_property
    def discussion_folder(self) -> str:
        return new_path(self.spark, "discussion-pages")

    @cached_property
    def question_pages(self) -> DataFrame:
        page = F.floor(F.col("page_id") / QUESTIONS_PER_PAGE).cast("int")
        question = F.struct(
            F.col("page_id").alias("question_id"),
            F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
            F.col("html").alias("body"),
            F.col("url").alias("link"),
            F.struct(F.regexp_extract("url", "https?://([^/]+)", 1).alias("display_name")).alias("owner"),
            F.split(F.regexp_extract("html", 'lang="([^"]*)"', 1), "-").alias("tags"),
            (F.length("html") % 7).cast("long").alias("score"),
            (F.col("page_id") * 3600 + 1700000000).alias("creation_date"),
        )
        pages = (
            self.read("pages")
            .groupBy(page.alias("page_number"))  # at most QUESTIONS_PER_PAGE questions
            .agg(F.array_sort(F.collect_list(question)).alias("items"))
            .select(
                F.lit("html pages").alias("query"),
                "page_number",
                F.create_map(F.lit("page"), F.col("page_number").cast("string")).alias("request_params"),
                "items",
                (F.col("page_number") % 3 < 2).alias("has_more"),
            )
        )
        pages.write.json(self.question_folder)
        return R.read_question_pages(self.spark, self.question_folder)

    @cached_property
    def question_folder(self) -> str:
        return new_path(self.spark, "question-pages")

    @cached_property
    def streamed_items(self) -> DataFrame:
        """Discussion pages read and scored as a stream."""
        self.discussion_pages  # writes the page files
        target, checkpoint = new_path(self.spark, "stream-scored"), new_path(self.spark, "stream-checkpoint")
        scored = J.score_stream(J.discussion_stream(self.spark, self.discussion_folder))
        J.run_append(scored, target, checkpoint).awaitTermination()
        return self.spark.read.parquet(target)

    @property
    def page_log(self) -> DataFrame:
        """A collector's page log out of ``events``: user = source, type = query, day = page."""
        k = F.get_json_object("props", "$.k").cast("int")
        return (
            self.read("events")
            .groupBy(
                F.concat(F.lit("user-"), "user_id").alias("source"),
                F.col("event_type").alias("query"),
                F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("page_number"),
            )
            .agg(
                F.count("*").alias("raw_count"),
                F.count_if(F.col("value") > 10).alias("item_count"),
                F.max_by(k >= 50, "event_id").alias("has_more"),
            )
        )

    @cached_property
    def runs(self) -> DataFrame:
        """One run per document source, each resuming from the one before."""
        number = F.regexp_extract("run_id", r"(\d+)", 1)
        totals = self.items.groupBy("run_id").agg(
            F.count("*").alias("total_items_analyzed"), F.count_if("is_demo_fallback").alias("demo_fallback_items")
        )
        evidence = self.evidence.groupBy("run_id").agg(F.count("*").alias("evidence_rows"))
        themes = self.raw.groupBy("run_id").agg(F.min("product_theme").alias("venture_category"))
        zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
        return stage(
            themes.join(totals, "run_id", "left")
            .join(evidence, "run_id", "left")
            .select(
                "run_id",
                F.date_format(
                    F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int")), "yyyy-MM-dd'T00:00:00+00:00'"
                ).alias("generated_at_utc"),
                "venture_category",
                F.when(number.cast("int") > 0, F.concat(F.lit("run-"), F.lpad((number.cast("int") - 1).cast("string"), 2, "0")))
                .otherwise("")
                .alias("resume_from_run_id"),
                zero("total_items_analyzed"),
                zero("evidence_rows"),
                zero("demo_fallback_items"),
            ),
            "runs",
        )

    @cached_property
    def lineage(self) -> DataFrame:
        """The lineage of run-09: half of all runs."""
        return H.lineage(self.stored("runs"), "run-09")

    @cached_property
    def chain(self) -> list[str]:
        return H.chain_runs(self.lineage)

    @cached_property
    def store(self) -> str:
        """All runs saved, after an earlier save of some of them that left too much behind."""
        root = new_path(self.spark, "store")
        early = ["run-03", "run-12"]
        first = {name: rows.where(F.col("run_id").isin(early)) for name, rows in self.run_tables.items() if name in ("raw_items", "evidence_rows")}
        doubled = first["raw_items"].unionByName(first["raw_items"].withColumn("source_id", F.concat(F.lit("old-"), "source_id")))
        H.save_run(first | {"raw_items": doubled}, root)
        H.save_run(self.run_tables | {"runs": self.runs}, root)
        return root

    def stored(self, name: str) -> DataFrame:
        return H.read_table(self.spark, self.store, name)

    @cached_property
    def two_runs(self) -> str:
        """A store of two whole runs: the items with odd numbers, then, going on from it, those with even ones. The second
        was saved before, with fewer items and another parent."""
        root = new_path(self.spark, "two-runs")
        half = lambda odd: spread(self.raw.where(F.col("source_index") % 2 == int(odd)))
        H.save_run(E.run_evidence(half(True), "first", BATCH, created_at="2026-01-01", theme="t1"), root)
        early = half(False).where("source_index % 4 = 0")
        H.save_run(E.run_evidence(early, "second", BATCH, created_at="2026-01-02", resume_from="none", theme="t2"), root)
        H.save_run(E.run_evidence(half(False), "second", BATCH, created_at="2026-01-03", resume_from="first", theme="t2"), root)
        return root

    @cached_property
    def two_chain(self) -> list[str]:
        return H.chain_runs(H.lineage(H.read_table(self.spark, self.two_runs, "runs"), "second"))

    @cached_property
    def run_tables(self) -> dict[str, DataFrame]:
        judged = self.assessed.select("run_id", "source_index", "batch_index", "kept").join(
            self.prepared.select("source_index", "exclude_for_relevance"), "source_index", "left"
        )
        batches = U.batch_summary(judged, ["run_id", "batch_index"])
        user = F.regexp_extract("source", r"(\d+)", 1).cast("int")
        pages = self.page_log.withColumn("run_id", F.concat(F.lit("run-"), F.lpad((user % 20).cast("string"), 2, "0")))
        return {
            "raw_items": self.assessed.select("run_id", *RAW_ITEM_FACTS),
            "prepared_items": self.items,
            "excluded_items": self.assessed.where(~F.col("kept")).select("run_id", "source_index", "source_id", "exclude_reasons"),
            "relevance_excluded_items": self.prepared.where("exclude_for_relevance"),
            "evidence_rows": self.evidence,
            "processing_batches": batches,
            "model_artifacts": self.artifacts,
            "collection_pages": pages,
            "collection_states": H.collection_state(pages, ["run_id", "source", "query"]),
        }


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, str(sf_dir))
    return _OPEN[key]
