"""Raw items and collected pages as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weaksift.functions import text as X
from weaksift.operators.numbering import first_by_rank, global_rank

_STRINGS = [
    "source_type", "source_name", "source_id", "source_url", "title", "author", "created_at",
    "collected_at", "product_theme", "query_theme", "text", "reviewed_product", "rating",
]
_TAIL_STRINGS = ["fallback_label", "fallback_reason"]

RAW_ITEM = T.StructType(
    [T.StructField(name, T.StringType()) for name in _STRINGS]
    + [T.StructField("is_demo_fallback", T.BooleanType())]
    + [T.StructField(name, T.StringType()) for name in _TAIL_STRINGS]
)
RAW_COLUMNS = RAW_ITEM.names

DISCUSSION_HIT = (
    "struct<objectID:string,story_id:string,parent_id:string,story_title:string,author:string,"
    "created_at:string,comment_text:string>"
)
DISCUSSION_PAGE = f"query string, page_number int, request_url string, hits array<{DISCUSSION_HIT}>, nbPages int, request_params map<string,string>"

QUESTION = (
    "struct<question_id:bigint,title:string,body:string,link:string,"
    "owner:struct<display_name:string>,tags:array<string>,score:bigint,creation_date:bigint>"
)
QUESTION_PAGE = (
    f"query string, page_number int, request_params map<string,string>, items array<{QUESTION}>, has_more boolean"
)


# Source names, page-source keys, default titles and link patterns.
DISCUSSION_SOURCE = "Hacker News Algolia comments"
DISCUSSION_PAGE_SOURCE = "source1_discussion"
DISCUSSION_TITLE = "Hacker News discussion"
DISCUSSION_LINK = "https://news.ycombinator.com/item?id="
QUESTION_SOURCE = "Stack Overflow public questions"
QUESTION_PAGE_SOURCE = "source2_stackoverflow_questions"
QUESTION_TITLE = "Stack Overflow question"
QUESTION_LINK = "https://stackoverflow.com/"


def read_raw_items(spark: SparkSession, path: str, json_lines: bool = True) -> DataFrame:
    """Raw items from JSON. ``json_lines`` files split across tasks; a file that is one JSON
    list (``json_lines=False``) is read whole by one task. Bad rows land in ``_corrupt_record``."""
    schema = T.StructType(RAW_ITEM.fields + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", not json_lines).json(path)


def with_defaults(items: DataFrame) -> DataFrame:
    """Any frame with some of the raw-item columns, completed: missing text is '' and a
    missing flag false. ``source_type`` stays null when unknown; each step has its own default."""
    have = set(items.columns)
    columns = []
    for field in RAW_ITEM.fields:
        if field.name not in have:
            value = F.lit(None).cast(field.dataType)
        else:
            value = F.col(field.name).cast(field.dataType)
        if field.name != "source_type":
            value = F.coalesce(value, F.lit(False) if field.name == "is_demo_fallback" else F.lit(""))
        columns.append(value.alias(field.name))
    extra = [name for name in items.columns if name not in RAW_COLUMNS and name != "_corrupt_record"]
    return items.select(*extra, *columns)


def with_timestamps(items: DataFrame) -> DataFrame:
    """``created_ts`` and ``collected_ts`` beside the ISO strings; null when not a timestamp."""
    return items.withColumns(
        {
            "created_ts": F.try_to_timestamp("created_at"),
            "collected_ts": F.try_to_timestamp("collected_at"),
        }
    )


def read_discussion_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DISCUSSION_PAGE).json(path)


def read_question_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_PAGE).json(path)


def _or_default(col: Column, default) -> Column:
    """The value, or the default when it is null or empty."""
    return F.when(F.coalesce(col, F.lit("")) != "", col).otherwise(default)


def discussion_items(pages: DataFrame, product_theme: str = "", collected_at: str = "") -> DataFrame:
    """One raw item per hit with text; a hit's story is the story, else the parent, else itself."""
    hit = F.col("hit")
    own_id = F.coalesce(hit["objectID"], F.lit(""))
    story = _or_default(hit["story_id"], _or_default(hit["parent_id"], own_id))
    rows = pages.select("query", "page_number", F.posexplode("hits").alias("position", "hit")).select(
        F.lit("discussion").alias("source_type"),
        F.lit(DISCUSSION_SOURCE).alias("source_name"),
        own_id.alias("source_id"),
        F.concat(F.lit(DISCUSSION_LINK), story).alias("source_url"),
        _or_default(hit["story_title"], F.lit(DISCUSSION_TITLE)).alias("title"),
        _or_default(hit["author"], F.lit("unknown")).alias("author"),
        _or_default(hit["created_at"], F.lit("")).alias("created_at"),
        F.lit(collected_at).alias("collected_at"),
        F.lit(product_theme).alias("product_theme"),
        F.col("query").alias("query_theme"),
        _or_default(hit["comment_text"], F.lit("")).alias("text"),
        "page_number",
        "position",
    )
    return with_defaults(rows.where(F.regexp_replace("text", X.SPACE, "") != ""))


def question_items(pages: DataFrame, product_theme: str = "", collected_at: str = "") -> DataFrame:
    """One raw item per question: title and cleaned body as text, tags, score as the rating."""
    question = F.col("question")
    title = X.decode_entities(F.coalesce(question["title"], F.lit(QUESTION_TITLE)), passes=1)
    # Without a time zone, so that the session's own does not matter.
    utc = F.timestamp_add("SECOND", question["creation_date"], F.lit("1970-01-01").cast("timestamp_ntz"))
    created = F.when(F.coalesce(question["creation_date"], F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    )
    rows = (
        pages.select("query", "page_number", F.posexplode("items").alias("position", "question"))
        .withColumns({"_title": title, "_body": X.clean_markup_simple(question["body"])})
        .select(
            F.lit("review").alias("source_type"),
            F.lit(QUESTION_SOURCE).alias("source_name"),
            F.coalesce(question["question_id"].cast("string"), F.lit("unknown-question")).alias("source_id"),
            _or_default(question["link"], F.lit(QUESTION_LINK)).alias("source_url"),
            F.col("_title").alias("title"),
            F.coalesce(question["owner"]["display_name"], F.lit("unknown")).alias("author"),
            created.alias("created_at"),
            F.lit(collected_at).alias("collected_at"),
            F.lit(product_theme).alias("product_theme"),
            F.col("query").alias("query_theme"),
            F.concat("_title", F.lit(". "), "_body").alias("text"),
            F.coalesce(F.array_join(question["tags"], ", "), F.lit("")).alias("reviewed_product"),
            F.coalesce(question["score"].cast("string"), F.lit("")).alias("rating"),
            "page_number",
            "position",
        )
    )
    return with_defaults(rows.where(F.regexp_replace("text", X.SPACE, "") != ""))


def _request_params() -> Column:
    """What a page was asked for with, as stored with it."""
    return F.coalesce("request_params", F.create_map().cast("map<string,string>")).alias("request_params")


def discussion_page_log(pages: DataFrame) -> DataFrame:
    """Counts of each page without its items. More pages follow while the page has hits and is
    not the last of ``nbPages`` (unknown: this page is the last)."""
    usable = F.filter("hits", lambda h: F.regexp_replace(F.coalesce(h["comment_text"], F.lit("")), X.SPACE, "") != "")
    raw_count = F.coalesce(F.size("hits"), F.lit(0))
    return pages.select(
        F.lit(DISCUSSION_PAGE_SOURCE).alias("source"),
        "query",
        "page_number",
        F.coalesce("request_url", F.lit("")).alias("request_url"),
        _request_params(),
        raw_count.cast("long").alias("raw_count"),
        F.size(usable).cast("long").alias("item_count"),
        (
            (F.col("page_number") + 1 < F.coalesce("nbPages", F.col("page_number") + 1)) & (raw_count > 0)
        ).alias("has_more"),
    )


def question_page_log(pages: DataFrame) -> DataFrame:
    """Same for question pages; every question has text, because a title is never empty."""
    raw_count = F.coalesce(F.size("items"), F.lit(0))
    return pages.select(
        F.lit(QUESTION_PAGE_SOURCE).alias("source"),
        "query",
        "page_number",
        F.lit("").alias("request_url"),
        _request_params(),
        raw_count.cast("long").alias("raw_count"),
        raw_count.cast("long").alias("item_count"),
        (F.coalesce("has_more", F.lit(False)) & (raw_count > 0)).alias("has_more"),
    )


def page_plan(queries: DataFrame, max_items: int, page_size: int = 0, max_pages: int = 0) -> DataFrame:
    """Page size and page count per query: an even share of ``max_items``, pages of 1 to 100."""
    share = F.greatest(F.lit(1), F.ceil(F.lit(max_items) / F.col("query_count"))).cast("long")
    size = F.greatest(F.lit(1), F.least(F.lit(100), F.lit(page_size) if page_size else F.col("share"))).cast("long")
    total = queries.agg(F.count("*").alias("query_count"))  # one row
    return (
        queries.join(F.broadcast(total))
        .withColumn("share", share)
        .withColumn("page_size", size)
        .select(
            *queries.columns,
            "page_size",
            F.greatest(
                F.lit(1), F.lit(max_pages) if max_pages else F.ceil(F.col("share") / F.col("page_size"))
            ).cast("long").alias("max_pages"),
        )
    )


def first_per_source_id(items: DataFrame, order: list[str]) -> DataFrame:
    """In-source dedupe: the first row of each (source_type, source_id) in page order. The rank
    filter also runs before the shuffle, so a much-repeated id leaves one row per task."""
    w = W.partitionBy("source_type", "source_id").orderBy(*order)
    return items.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def cap_per_source(items: DataFrame, order: list[str], max_items: int) -> DataFrame:
    """The first ``max_items`` rows of each source type (null is one) by a total order of columns, the
    run's item cap. Any cap and any number of rows of a type take the same path."""
    return first_by_rank(items, ["source_type"], order, max_items)


def with_source_index(items: DataFrame, order: list[str]) -> DataFrame:
    """1-based ``source_index`` over all raw rows in intake order (a total order of columns)."""
    return global_rank(items, [], [F.asc(name) for name in order], "source_index")


def collected(*sources: DataFrame) -> DataFrame:
    """Raw items of several sources in one frame, the raw-item columns only."""
    union = sources[0].select(RAW_COLUMNS)
    for items in sources[1:]:
        union = union.unionByName(items.select(RAW_COLUMNS))
    return union


def source_counts(items: DataFrame) -> DataFrame:
    """Counts by source type for a local intake, with the items marked as fallback."""
    return items.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(
        F.count("*").alias("items"), F.count_if("is_demo_fallback").alias("fallback_items")
    )


def queries_to_collect(queries: DataFrame, resume_points: DataFrame) -> DataFrame:
    """The queries a resumed run still has to collect, with their next page."""
    return queries.join(resume_points, ["source", "query"], "inner")


def enabled_sources(items: DataFrame, discussion: bool = True, review: bool = True) -> DataFrame:
    wanted = [name for name, on in (("discussion", discussion), ("review", review)) if on]
    return items.where(F.col("source_type").isin(wanted)) if wanted else items.limit(0)
