"""The registered queries: each a function of (spark, table folder), most with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weaksift import lexicons as X
from weaksift.functions import matching as M
from weaksift.functions import text as T
from weaksift.operators import clusters as C
from weaksift.operators import evaluate as A
from weaksift.operators import history as H
from weaksift.operators import labels as L
from weaksift.operators import numbering as N
from weaksift.operators import quality as Q
from weaksift.operators import relevance as R
from weaksift.operators import signals as S
from weaksift.operators import summaries as U
from weaksift.operators import vectors as V
from weaksift.plans import evidence as E
from weaksift.plans import oracle as O
from weaksift.plans.seeded import seeded_items
from weaksift.plans.stages import new_path, spread
from weaksift.plans.tables import CORPUS, NATIVE_THRESHOLDS, Tables, tables
from weaksift.sources import raw_items as I
from weaksift.streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def text_of(column: str, separator: str = "; ") -> Column:
    return F.array_join(column, separator).alias(column)


def whole(column: str) -> Column:
    return F.col(column).cast("long").alias(column)


ASSESSED = O.with_(O.SEEDED, O.ASSESSED)
PREPARED = O.with_(O.SEEDED, O.ASSESSED, O.PREPARED)
EVIDENCE = O.with_(O.SEEDED, O.ASSESSED, O.PREPARED, O.EVIDENCE)
SUMMARY = O.with_(O.SEEDED, O.ASSESSED, O.PREPARED, O.EVIDENCE, O.SUMMARY)
VECTORS = O.with_(O.SEEDED, O.ASSESSED, O.PREPARED, O.VECTORS)
_MEMBERS = (O.SEEDED, O.ASSESSED, O.PREPARED, O.VECTORS, O.clusters("vectors", O.THRESHOLDS))
MEMBERS = O.with_(*_MEMBERS)
ROLLUP = O.with_(*_MEMBERS, O.ROLLUP)


# -- sources ------------------------------------------------------------------------------------


@query(
    "raw_items",
    O.with_(O.SEEDED)
    + """SELECT source_index, run_id, source_type, source_name, source_id, source_url, title, author, product_theme,
    query_theme, rating, is_demo_fallback, md5(text) AS text_md5 FROM seeded""",
)
def raw_items(t: Tables) -> DataFrame:
    return t.raw.select(
        "source_index", "run_id", "source_type", "source_name", "source_id", "source_url", "title", "author",
        "product_theme", "query_theme", "rating", "is_demo_fallback", F.md5("text").alias("text_md5"),
    )


@query(
    "source_counts",
    O.with_(O.SEEDED)
    + """SELECT source_type, count(*) AS items, count(*) FILTER (is_demo_fallback) AS fallback_items
    FROM seeded GROUP BY ALL""",
)
def source_counts(t: Tables) -> DataFrame:
    return I.source_counts(t.raw)


_TURN_PAGES = """
turns AS (SELECT *, turn // 4 AS page, conv_id || '-' || turn AS oid, max(turn // 4) OVER (PARTITION BY conv_id) + 1 AS nb FROM conversations)
"""


@query(
    "discussion_page_items",
    O.with_(_TURN_PAGES)
    + f"""SELECT 'discussion' AS source_type, {O.lit(I.DISCUSSION_SOURCE)} AS source_name, oid AS source_id,
      {O.lit(I.DISCUSSION_LINK)} || CASE role WHEN 'assistant' THEN conv_id::VARCHAR WHEN 'user' THEN 'c' || conv_id ELSE oid END AS source_url,
      {O.lit(I.DISCUSSION_TITLE)} AS title, role AS author, 'conv-' || conv_id AS query_theme, page AS page_number,
      turn % 4 AS position, text AS text
    FROM turns WHERE trim(text) <> ''""",
)
def discussion_page_items(t: Tables) -> DataFrame:
    return I.discussion_items(t.discussion_pages).select(
        "source_type", "source_name", "source_id", "source_url", "title", "author", "query_theme",
        whole("page_number"), whole("position"), "text",
    )


@query(
    "discussion_page_log",
    O.with_(_TURN_PAGES)
    + f"""SELECT {O.lit(I.DISCUSSION_PAGE_SOURCE)} AS source, 'conv-' || conv_id AS query, page AS page_number,
      'https://pages.example/' || conv_id || '?page=' || page AS request_url, count(*) AS raw_count,
      count(*) FILTER (trim(text) <> '') AS item_count, page + 1 < max(nb) AS has_more, page::VARCHAR AS asked_page
    FROM turns GROUP BY conv_id, page""",
)
def discussion_page_log(t: Tables) -> DataFrame:
    return _asked(I.discussion_page_log(t.discussion_pages)).withColumn("page_number", whole("page_number"))


def _asked(log: DataFrame) -> DataFrame:
    return log.withColumn("asked_page", F.col("request_params")["page"]).drop("request_params")


def _entities(column: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        column = f"replace({column}, {O.lit(entity)}, {O.lit(char)})"
    return column


_STRIPPED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query(
    "question_page_items",
    f"""SELECT 'review' AS source_type, {O.lit(I.QUESTION_SOURCE)} AS source_name, page_id::VARCHAR AS source_id,
      url AS source_url, {_entities(_TITLE)} AS title, regexp_extract(url, 'https?://([^/]+)', 1) AS author,
      strftime(make_timestamp((page_id * 3600 + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at,
      array_to_string(string_split(regexp_extract(html, 'lang="([^"]*)"', 1), '-'), ', ') AS reviewed_product,
      (length(html) % 7)::VARCHAR AS rating, page_id // 10 AS page_number,
      md5({_entities(_TITLE)} || '. ' || {O.clean(_entities(_STRIPPED))}) AS text_md5
    FROM pages""",
)
def question_page_items(t: Tables) -> DataFrame:
    return I.question_items(t.question_pages).select(
        "source_type", "source_name", "source_id", "source_url", "title", "author", "created_at",
        "reviewed_product", "rating", whole("page_number"), F.md5("text").alias("text_md5"),
    )


@query(
    "question_page_log",
    f"""SELECT {O.lit(I.QUESTION_PAGE_SOURCE)} AS source, 'html pages' AS query, page_id // 10 AS page_number,
    '' AS request_url, count(*) AS raw_count, count(*) AS item_count, page_id // 10 % 3 < 2 AS has_more,
    (page_id // 10)::VARCHAR AS asked_page FROM pages GROUP BY page_id // 10""",
)
def question_page_log(t: Tables) -> DataFrame:
    return _asked(I.question_page_log(t.question_pages)).withColumn("page_number", whole("page_number"))


@query(
    "collected_items",
    f"""SELECT 'discussion' AS source_type, {O.lit(I.DISCUSSION_SOURCE)} AS source_name, conv_id || '-' || turn AS source_id
    FROM conversations WHERE trim(text) <> '' UNION ALL SELECT 'review', {O.lit(I.QUESTION_SOURCE)}, page_id::VARCHAR FROM pages""",
)
def collected_items(t: Tables) -> DataFrame:
    both = I.collected(I.discussion_items(t.discussion_pages), I.question_items(t.question_pages))
    return I.enabled_sources(both).select("source_type", "source_name", "source_id")


@query(
    "source_index",
    """SELECT conv_id || '-' || turn AS source_id, row_number() OVER (ORDER BY conv_id, turn) AS source_index
    FROM conversations""",
)
def source_index(t: Tables) -> DataFrame:
    turns = t.read("conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("source_id"))
    return I.with_source_index(turns, ["conv_id", "turn"]).select("source_id", "source_index")


@query(
    "page_plan",
    """WITH q AS (SELECT DISTINCT 'user-' || user_id AS query FROM events), n AS (SELECT count(*) AS n FROM q),
    s AS (SELECT query, greatest(1, ceil(5000.0 / n))::BIGINT AS share FROM q, n)
    SELECT query, least(100, share)::BIGINT AS page_size, greatest(1, ceil(share / least(100, share)))::BIGINT AS max_pages FROM s""",
)
def page_plan(t: Tables) -> DataFrame:
    queries = t.read("events").select(F.concat(F.lit("user-"), "user_id").alias("query")).distinct()
    return I.page_plan(queries, max_items=5000)


_KEYED = O.with_(O.SEEDED, "keyed AS (SELECT *, md5(text) AS key FROM (SELECT s.* REPLACE (d.text AS text) FROM seeded s JOIN documents d USING (doc_id)))")


@query(
    "source_dedupe",
    _KEYED
    + """SELECT source_type, key AS source_id, min(source_index) AS source_index FROM keyed GROUP BY ALL""",
)
def source_dedupe(t: Tables) -> DataFrame:
    return I.first_per_source_id(t.keyed, ["source_index"]).select("source_type", "source_id", "source_index")


@query(
    "source_cap",
    O.with_(O.SEEDED)
    + """SELECT source_type, source_index FROM (SELECT source_type, source_index,
      row_number() OVER (PARTITION BY source_type ORDER BY source_index) AS n FROM seeded) WHERE n <= 50""",
)
def source_cap(t: Tables) -> DataFrame:
    return I.cap_per_source(t.raw, ["source_index"], 50).select("source_type", "source_index")


# -- text ---------------------------------------------------------------------------------------

_PIECES = (
    f"array_to_string(list_transform(regexp_extract_all(html, {O.lit(T.PIECE)}), lambda p: "
    f"CASE WHEN regexp_matches(p, {O.lit(T.SCRIPT_OPEN)}) THEN regexp_replace(regexp_replace(p, {O.lit(T.SCRIPT_OPEN)}, ''), "
    f"{O.lit(T.SCRIPT_CLOSE)}, '') WHEN regexp_matches(p, '^<[A-Za-z/!?]') THEN ' ' ELSE p END), ' ')"
)
_NO_SCRIPTS = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), "
    "'(?s)<!--.*?-->', ' ', 'g'), '<[A-Za-z/!?][^>]*>', ' ', 'g')"
)


@query("page_text", f"SELECT page_id, {O.clean(_entities(_entities(_PIECES)))} AS clean_text FROM pages")
def page_text(t: Tables) -> DataFrame:
    return spread(t.read("pages")).select("page_id", T.clean_text(F.col("html")).alias("clean_text"))


@query("page_text_no_scripts", f"SELECT page_id, {O.clean(_entities(_entities(_NO_SCRIPTS)))} AS clean_text FROM pages")
def page_text_no_scripts(t: Tables) -> DataFrame:
    return spread(t.read("pages")).select("page_id", T.clean_text(F.col("html"), keep_scripts=False).alias("clean_text"))


@query("page_text_simple", f"SELECT page_id, {O.clean(_entities(_STRIPPED))} AS clean_text FROM pages")
def page_text_simple(t: Tables) -> DataFrame:
    return spread(t.read("pages")).select("page_id", T.clean_markup_simple(F.col("html")).alias("clean_text"))


@query(
    "excerpts",
    f"""WITH c AS (SELECT conv_id, turn, {O.clean('text')} AS x FROM conversations)
    SELECT conv_id, turn, {O.cut('x', 240)} AS excerpt_240, {O.cut('x', 220)} AS excerpt_220,
      {O.cut('x', 220, False)} AS compact_220, {O.cut('x', 320, False)} AS compact_320, {O.cut('x', 160, False)} AS compact_160
    FROM c""",
)
def excerpts(t: Tables) -> DataFrame:
    text = F.col("text")
    return (
        t.read("conversations")
        .withColumn("clean", T.clean_text(text))
        .select(
            "conv_id", "turn",
            T.excerpt(F.col("clean")).alias("excerpt_240"),
            T.excerpt(F.col("clean"), 220).alias("excerpt_220"),
            T.compact(text).alias("compact_220"),
            T.compact(text, 320).alias("compact_320"),
            T.compact(text, 160).alias("compact_160"),
        )
    )


# Terms that do occur in the given corpus.
CORPUS_TERMS = ["license", "@", "###", "the ", "token", "und ", "que ", "tion", "stupid", "idiot", "trash", "copyright"]
CORPUS_WORDS = ["the", "and", "und", "der", "que", "de", "license", "token", "stupid", "idiot", "trash", "clown", "the and"]


@query(
    "substring_hits",
    f"""SELECT doc_id, array_to_string({O.sub("lower(text)", CORPUS_TERMS)}, ',') AS hits,
    len({O.sub("lower(text)", CORPUS_TERMS)})::BIGINT AS hit_count FROM documents""",
)
def substring_hits(t: Tables) -> DataFrame:
    lowered = spread(t.read("documents")).select("doc_id", F.lower("text").alias("low"))
    return (
        lowered.withColumn("found", M.substring_hits(F.col("low"), CORPUS_TERMS))
        .select("doc_id", F.array_join("found", ",").alias("hits"), F.size("found").cast("long").alias("hit_count"))
    )


@query(
    "word_hits",
    f"""WITH d AS (SELECT doc_id, lower(text) AS low, string_split_regex(lower(text), {O.lit(O.NON_WORD)}) AS toks FROM documents)
    SELECT doc_id, array_to_string({O.word("low", "toks", CORPUS_WORDS)}, ',') AS hits FROM d""",
)
def word_hits(t: Tables) -> DataFrame:
    lowered = spread(t.read("documents")).select("doc_id", F.lower("text").alias("low"))
    terms = list(dict.fromkeys(CORPUS_WORDS))
    found = lowered.withColumn("found", M.hits_by_word_rule(F.col("low"), terms))
    return found.select("doc_id", F.array_join(M.pick(F.col("found"), CORPUS_WORDS), ",").alias("hits"))


# -- quality --------------------------------------------------------------------------------------

_DECISION = """source_index, source_type, source_id, quality_score::BIGINT AS quality_score,
    array_to_string(quality_reasons, '; ') AS quality_reasons, array_to_string(exclude_reasons, '; ') AS exclude_reasons, kept"""


@query("quality_decisions", ASSESSED + f"SELECT {_DECISION} FROM assessed")
def quality_decisions(t: Tables) -> DataFrame:
    return t.assessed.select(
        "source_index", "source_type", "source_id", whole("quality_score"), text_of("quality_reasons"),
        text_of("exclude_reasons"), "kept",
    )


@query(
    "excluded_items",
    ASSESSED
    + f"""SELECT {_DECISION}, source_name, source_url, title, {O.cut('clean_text', 220)} AS text_excerpt, is_demo_fallback
    FROM assessed WHERE NOT kept""",
)
def excluded_items(t: Tables) -> DataFrame:
    return Q.excluded_log(t.assessed).select(
        "source_index", "source_type", "source_id", whole("quality_score"), text_of("quality_reasons"),
        text_of("exclude_reasons"), "kept", "source_name", "source_url", "title", "text_excerpt", "is_demo_fallback",
    )


@query(
    "filtering_summary",
    ASSESSED
    + """SELECT coalesce(source_type, 'all') AS source_type, count(*) AS raw_items, count(*) FILTER (kept) AS kept_items,
    count(*) FILTER (NOT kept) AS excluded_items FROM assessed GROUP BY ROLLUP (source_type)""",
)
def filtering_summary(t: Tables) -> DataFrame:
    return Q.filtering_summary(t.assessed).fillna({"source_type": "all"})


@query(
    "exclusion_reasons",
    ASSESSED
    + """SELECT string_split(r, ':')[1] AS reason_code, count(*) AS reason_count
    FROM (SELECT unnest(exclude_reasons) AS r FROM assessed WHERE NOT kept) GROUP BY ALL""",
)
def exclusion_reasons(t: Tables) -> DataFrame:
    return Q.reason_histogram(t.assessed.where(~F.col("kept")), "exclude_reasons")


@query(
    "quality_against_labels",
    ASSESSED
    + """SELECT kept, l.quality AS reviewed, count(*) AS items FROM assessed a JOIN labels l ON l.doc_id = a.doc_id GROUP BY ALL""",
)
def quality_against_labels(t: Tables) -> DataFrame:
    labels = t.read("labels").select((F.col("doc_id") + 1).alias("source_index"), F.col("quality").alias("reviewed"))
    return t.assessed.select("source_index", "kept").join(labels, "source_index").groupBy("kept", "reviewed").agg(
        F.count("*").alias("items")
    )


# -- relevance ------------------------------------------------------------------------------------


@query(
    "item_numbers",
    PREPARED + "SELECT source_index, item_no, item_id, batch_index FROM prepared",
)
def item_numbers(t: Tables) -> DataFrame:
    return t.prepared.select("source_index", whole("item_no"), "item_id", whole("batch_index"))


_SCORES = """item_id, source_id, relevance_score::BIGINT AS relevance_score, r_text AS relevance_reasons,
    p_text AS relevance_penalties, exclude_for_relevance"""


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select(
        "item_id", "source_id", whole("relevance_score"), text_of("relevance_reasons"), text_of("relevance_penalties"),
        "exclude_for_relevance",
    )


@query("relevance_scores", PREPARED + f"SELECT {_SCORES} FROM prepared")
def relevance_scores(t: Tables) -> DataFrame:
    return _scores(t.prepared)


@query("relevance_excluded_items", PREPARED + f"SELECT {_SCORES} FROM prepared WHERE exclude_for_relevance")
def relevance_excluded_items(t: Tables) -> DataFrame:
    return _scores(t.prepared.where("exclude_for_relevance"))


@query(
    "prepared_items",
    PREPARED
    + """SELECT item_id, source_type, source_name, source_id, source_url, title, author, product_theme, query_theme, rating,
    md5(clean_text) AS text_md5, quality_score::BIGINT AS quality_score, relevance_score::BIGINT AS relevance_score, is_demo_fallback FROM items""",
)
def prepared_items(t: Tables) -> DataFrame:
    return t.items.select(
        "item_id", "source_type", "source_name", "source_id", "source_url", "title", "author", "product_theme",
        "query_theme", "rating", F.md5("clean_text").alias("text_md5"), whole("quality_score"),
        whole("relevance_score"), "is_demo_fallback",
    )


@query(
    "relevance_summary",
    PREPARED
    + """SELECT count(*) AS evidence_candidates_after_quality_filter,
    count(*) FILTER (NOT exclude_for_relevance) AS evidence_candidates_after_relevance_filter,
    count(*) FILTER (exclude_for_relevance) AS relevance_filtered_items FROM prepared""",
)
def relevance_summary(t: Tables) -> DataFrame:
    return R.relevance_summary(t.prepared)


@query(
    "relevance_profile",
    PREPARED
    + """SELECT count(*) FILTER (NOT exclude_for_relevance) AS kept_items, count(*) FILTER (exclude_for_relevance) AS relevance_filtered_items,
    coalesce(min(relevance_score) FILTER (NOT exclude_for_relevance), 0)::BIGINT AS min_relevance_score,
    coalesce(max(relevance_score) FILTER (NOT exclude_for_relevance), 0)::BIGINT AS max_relevance_score FROM prepared""",
)
def relevance_profile(t: Tables) -> DataFrame:
    return R.relevance_profile(t.prepared).select(
        "kept_items", "relevance_filtered_items", whole("min_relevance_score"), whole("max_relevance_score")
    )


@query(
    "relevance_reasons",
    PREPARED
    + """SELECT string_split(r, ':')[1] AS reason_code, count(*) AS reason_count
    FROM (SELECT unnest(relevance_reasons) AS r FROM items) GROUP BY ALL""",
)
def relevance_reasons(t: Tables) -> DataFrame:
    return Q.reason_histogram(t.items, "relevance_reasons")


_BATCHES = """SELECT a.batch_index, 'completed' AS status, min(a.source_index) AS raw_item_start_index,
    max(a.source_index) AS raw_item_end_index, count(*) AS raw_items, count(*) FILTER (a.kept) AS quality_candidates,
    count(*) FILTER (NOT a.kept) AS quality_excluded, count(*) FILTER (NOT p.exclude_for_relevance) AS relevance_prepared,
    count(*) FILTER (p.exclude_for_relevance) AS relevance_excluded
  FROM assessed a LEFT JOIN prepared p USING (source_index) GROUP BY a.batch_index"""


def _batches(t: Tables) -> DataFrame:
    judged = t.assessed.select("source_index", "batch_index", "kept").join(
        t.prepared.select("source_index", "exclude_for_relevance"), "source_index", "left"
    )
    return U.batch_summary(judged)


@query("batch_summary", PREPARED + _BATCHES)
def batch_summary(t: Tables) -> DataFrame:
    return _batches(t)


@query(
    "batch_running_total",
    PREPARED
    + f"""SELECT batch_index, (sum(quality_candidates) OVER (ORDER BY batch_index))::BIGINT AS candidates_so_far FROM ({_BATCHES})""",
)
def batch_running_total(t: Tables) -> DataFrame:
    return N.running_total(_batches(t), "batch_index", "quality_candidates", "candidates_so_far", chunk=4).select(
        whole("batch_index"), whole("candidates_so_far")
    )


@query("batch_of_items", PREPARED + "SELECT item_id, batch_index FROM prepared")
def batch_of_items(t: Tables) -> DataFrame:
    return H.batch_of_items(t.prepared.select("item_id"), _batches(t)).select("item_id", whole("batch_index"))


_NATIVE = """
native AS (SELECT doc_id + 1 AS source_index, 'native' AS run_id, CASE WHEN lang = 'en' THEN 'review' ELSE 'discussion' END AS source_type,
    source AS source_name, doc_id::VARCHAR AS source_id, '' AS source_url, '' AS title, lang AS author, '' AS product_theme,
    lang AS query_theme, '' AS rating, text, false AS is_demo_fallback, doc_id FROM documents)"""
NATIVE_ASSESSED = O.with_(_NATIVE, O.assessed(CORPUS, "native"))
NATIVE_PREPARED = O.with_(_NATIVE, O.assessed(CORPUS, "native"), O.prepared(CORPUS))


@query("native_quality_decisions", NATIVE_ASSESSED + f"SELECT {_DECISION} FROM assessed")
def native_quality_decisions(t: Tables) -> DataFrame:
    return t.native_assessed.select(
        "source_index", "source_type", "source_id", whole("quality_score"), text_of("quality_reasons"),
        text_of("exclude_reasons"), "kept",
    )


@query(
    "native_quality_against_labels",
    NATIVE_ASSESSED
    + """SELECT kept, l.quality AS reviewed, l.toxic AS toxic, count(*) AS items FROM assessed a JOIN labels l ON l.doc_id = a.doc_id GROUP BY ALL""",
)
def native_quality_against_labels(t: Tables) -> DataFrame:
    labels = t.read("labels").select(
        (F.col("doc_id") + 1).alias("source_index"), F.col("quality").alias("reviewed"), "toxic"
    )
    return t.native_assessed.select("source_index", "kept").join(labels, "source_index").groupBy(
        "kept", "reviewed", "toxic"
    ).agg(F.count("*").alias("items"))


@query(
    "native_relevance",
    NATIVE_PREPARED
    + f"SELECT {_SCORES}, array_to_string(labels, ', ') AS labels, primary_label, bucket FROM prepared",
)
def native_relevance(t: Tables) -> DataFrame:
    more = t.native_prepared.select("item_id", text_of("labels", ", "), "primary_label", "bucket")
    return _scores(t.native_prepared).join(more, "item_id")


NATIVE_EVIDENCE = O.with_(_NATIVE, O.assessed(CORPUS, "native"), O.prepared(CORPUS), O.evidence(CORPUS))


@query(
    "native_evidence",
    NATIVE_EVIDENCE
    + """SELECT item_id, category, category_title, array_to_string(matched_terms, ', ') AS matched_terms, evidence_excerpt,
    signal_relevance_score::BIGINT AS signal_relevance_score FROM evidence""",
)
def native_evidence(t: Tables) -> DataFrame:
    """Evidence of the documents under a user's own lexicon, two categories of which are the user's own."""
    return t.native_evidence.select(
        "item_id", "category", "category_title", text_of("matched_terms", ", "), "evidence_excerpt", whole("signal_relevance_score")
    )


@query(
    "native_category_summary",
    NATIVE_EVIDENCE
    + ","
    + O.SUMMARY
    + """SELECT summary_ord::BIGINT AS summary_ord, category, title, evidence_count, discussion_count, review_count,
    array_to_string(top_terms, ', ') AS top_terms, summary, array_to_string(example_evidence, ' | ') AS example_evidence FROM summary""",
)
def native_category_summary(t: Tables) -> DataFrame:
    return U.category_summary(t.native_evidence).select(
        whole("summary_ord"), "category", "title", "evidence_count", "discussion_count", "review_count",
        text_of("top_terms", ", "), "summary", text_of("example_evidence", " | "),
    )


@query(
    "native_clusters",
    O.with_(_NATIVE, O.assessed(CORPUS, "native"), O.prepared(CORPUS), O.VECTORS, O.clusters("vectors", NATIVE_THRESHOLDS), O.ROLLUP)
    + """SELECT threshold, cluster_id, bucket AS cluster_key, label, product_opportunity, item_count,
    array_to_string(source_mix, ', ') AS source_mix, average_relevance_score::DOUBLE AS average_relevance_score,
    array_to_string(top_terms, ', ') AS top_terms, array_to_string(rep_items, ', ') AS representative_item_ids FROM rollup_rows""",
)
def native_clusters(t: Tables) -> DataFrame:
    """Clusters of the documents in a user's own buckets."""
    return t.native_rollup.select(
        "threshold", "cluster_id", F.col("bucket").alias("cluster_key"), "label", "product_opportunity", "item_count",
        text_of("source_mix", ", "), "average_relevance_score", text_of("top_terms", ", "), text_of("representative_item_ids", ", "),
    )


# -- evidence -------------------------------------------------------------------------------------

_EVIDENCE_ROW = """run_id, item_id, category, category_title, array_to_string(matched_terms, ', ') AS matched_terms, evidence_excerpt,
    source_type, source_id, title, relevance_score::BIGINT AS relevance_score, signal_relevance_score::BIGINT AS signal_relevance_score"""


def _evidence(rows: DataFrame) -> DataFrame:
    return rows.select(
        "run_id", "item_id", "category", "category_title", text_of("matched_terms", ", "), "evidence_excerpt",
        "source_type", "source_id", "title", whole("relevance_score"), whole("signal_relevance_score"),
    )


@query(
    "signal_scores",
    EVIDENCE
    + """SELECT item_id, category, array_to_string(matched_terms, ', ') AS matched_terms,
    signal_relevance_score::BIGINT AS signal_relevance_score,
    EXISTS (FROM evidence e WHERE e.item_id = s.item_id AND e.category = s.category) AS keep_signal FROM signal_scores s""",
)
def signal_scores(t: Tables) -> DataFrame:
    return S.score_signals(t.items).select(
        "item_id", "category", text_of("matched_terms", ", "), whole("signal_relevance_score"), "keep_signal"
    )


@query("evidence_rows", EVIDENCE + f"SELECT {_EVIDENCE_ROW} FROM evidence")
def evidence_rows(t: Tables) -> DataFrame:
    return _evidence(t.evidence)


@query(
    "evidence_page",
    EVIDENCE
    + f"SELECT {_EVIDENCE_ROW} FROM evidence ORDER BY signal_relevance_score DESC, run_id, item_no, category_ord LIMIT 50 OFFSET 10",
)
def evidence_page(t: Tables) -> DataFrame:
    return _evidence(H.evidence_page(t.evidence, limit=50, offset=10))


@query(
    "evidence_page_of_category",
    EVIDENCE
    + f"""SELECT {_EVIDENCE_ROW} FROM evidence WHERE category = 'adoption_barriers'
    ORDER BY signal_relevance_score DESC, run_id, item_no, category_ord LIMIT 50""",
)
def evidence_page_of_category(t: Tables) -> DataFrame:
    return _evidence(H.evidence_page(t.evidence, category="adoption_barriers"))


@query(
    "category_summary",
    SUMMARY
    + """SELECT summary_ord::BIGINT AS summary_ord, category, title, evidence_count, discussion_count, review_count,
    array_to_string(top_terms, ', ') AS top_terms, summary, array_to_string(example_evidence, ' | ') AS example_evidence,
    array_to_string(example_scores, ', ') AS example_scores FROM summary""",
)
def category_summary(t: Tables) -> DataFrame:
    return U.category_summary(t.evidence).select(
        whole("summary_ord"), "category", "title", "evidence_count", "discussion_count", "review_count",
        text_of("top_terms", ", "), "summary", text_of("example_evidence", " | "),
        F.array_join(F.col("example_scores").cast("array<string>"), ", ").alias("example_scores"),
    )


@query(
    "section_summary",
    SUMMARY
    + """SELECT category, title, evidence_count, discussion_count, review_count, array_to_string(top_terms, ', ') AS top_terms, summary
    FROM summary""",
)
def section_summary(t: Tables) -> DataFrame:
    return U.section_summary(t.summary)


@query(
    "category_terms",
    SUMMARY + "SELECT category, place, term, n AS term_count FROM term_ranks WHERE place <= 5",
)
def category_terms(t: Tables) -> DataFrame:
    return U.category_terms(t.evidence).select("category", whole("place"), "term", F.col("n").alias("term_count"))


@query(
    "category_examples",
    SUMMARY
    + """SELECT category, place, item_id, signal_relevance_score::BIGINT AS signal_relevance_score, evidence_excerpt
    FROM ranked_evidence WHERE place <= 3""",
)
def category_examples(t: Tables) -> DataFrame:
    return U.category_examples(t.evidence).select(
        "category", whole("place"), "item_id", whole("signal_relevance_score"), "evidence_excerpt"
    )


_VOLUME = """volume AS (SELECT count(*) AS total_items_analyzed, count(*) FILTER (source_type = 'discussion') AS discussion_items,
    count(*) FILTER (source_type = 'review') AS review_items, count(*) FILTER (is_demo_fallback) AS demo_fallback_items,
    (SELECT count(*) FROM evidence) AS evidence_rows FROM items)"""


@query("volume_summary", EVIDENCE + "," + _VOLUME + " SELECT * FROM volume")
def volume_summary(t: Tables) -> DataFrame:
    return U.volume_summary(t.items, t.evidence)


@query(
    "uncertainty_notes",
    EVIDENCE
    + ","
    + _VOLUME
    + f""" SELECT 1::BIGINT AS ord, {O.lit(U.DIRECTIONAL_NOTE)} AS note UNION ALL SELECT 2, {O.lit(U.COUNT_NOTE)}
    UNION ALL SELECT 3, demo_fallback_items || {O.lit(U.FALLBACK_NOTE)} FROM volume WHERE demo_fallback_items > 0
    UNION ALL SELECT 4, {O.lit(U.SMALL_NOTE)} FROM volume WHERE total_items_analyzed < 10
    UNION ALL SELECT 5, {O.lit(U.EMPTY_NOTE)} FROM volume WHERE evidence_rows = 0""",
)
def uncertainty_notes(t: Tables) -> DataFrame:
    return U.uncertainty_notes(U.volume_summary(t.items, t.evidence)).select(whole("ord"), "note")


_RULES = ", ".join(f"({i}, {O.lit(c)}, {O.lit(n)})" for i, (c, n) in enumerate(U.IMPLICATIONS.items(), start=1))


@query(
    "implication_notes",
    SUMMARY
    + f""", rules(ord, category, note) AS (VALUES {_RULES}),
    fired AS (SELECT ord, note FROM rules JOIN summary USING (category) WHERE evidence_count > 0)
    SELECT ord::BIGINT AS ord, note FROM fired UNION ALL
    SELECT 1, {O.lit(U.NO_IMPLICATION)} WHERE NOT EXISTS (FROM fired)""",
)
def implication_notes(t: Tables) -> DataFrame:
    return U.implication_notes(t.summary).select(whole("ord"), "note")


_SECTIONS = " ".join(f"WHEN {O.lit(c)} THEN {n}" for c, n in U.SECTION_NUMBERS.items())


@query(
    "memo_sections",
    SUMMARY
    + f"""SELECT (CASE category {_SECTIONS} END)::BIGINT AS section, title, 0::BIGINT AS ord, summary AS text FROM summary
    UNION ALL SELECT (CASE r.category {_SECTIONS} END)::BIGINT, s.title, place,
      'Evidence (score ' || signal_relevance_score || '): ' || evidence_excerpt
    FROM ranked_evidence r JOIN summary s USING (category) WHERE place <= 3""",
)
def memo_sections(t: Tables) -> DataFrame:
    return U.memo_sections(t.summary).select(whole("section"), "title", whole("ord"), "text")


# -- labels, fingerprints, vectors ------------------------------------------------------------------


@query(
    "classification",
    PREPARED + "SELECT item_id, primary_label, array_to_string(labels, ', ') AS labels FROM items",
)
def classification(t: Tables) -> DataFrame:
    return t.items.select("item_id", "primary_label", text_of("labels", ", "))


@query("item_buckets", PREPARED + "SELECT item_id, bucket FROM items")
def item_buckets(t: Tables) -> DataFrame:
    return t.items.select("item_id", "bucket")


_ITEM_HASH = "sha256(concat_ws(chr(10), source_id, title, clean_text, relevance_score::VARCHAR, r_text, p_text))"


@query("item_fingerprints", PREPARED + f"SELECT item_id, {_ITEM_HASH} AS input_hash FROM items")
def item_fingerprints(t: Tables) -> DataFrame:
    return t.items.select("item_id", L.item_fingerprint().alias("input_hash"))


_SIX = "floor(vector[i] * 1000000.0 + 0.5)::BIGINT"


@query(
    "hashed_vectors",
    VECTORS
    + f"""SELECT v.item_id, len(v.tokens)::BIGINT AS token_count, array_to_string(coalesce(top_terms, []), ',') AS top_terms,
    array_to_string(list_filter(range(64), lambda s: floor(vector[s + 1] * 1000000.0 + 0.5) <> 0), ',') AS slots,
    array_to_string(list_filter(list_transform(range(1, 65), lambda i: {_SIX}), lambda x: x <> 0), ',') AS micro_values
    FROM vectors v LEFT JOIN item_terms USING (item_no)""",
)
def hashed_vectors(t: Tables) -> DataFrame:
    micro = F.transform("values", lambda v: F.floor(v * 1000000.0 + 0.5).cast("string"))
    return V.embedding_payload(t.items).select(
        "item_id", "token_count", text_of("top_terms", ","),
        F.array_join(F.col("nonzero_indices").cast("array<string>"), ",").alias("slots"),
        F.array_join(micro, ",").alias("micro_values"),
    )


@query(
    "item_top_terms",
    VECTORS + "SELECT v.item_id, array_to_string(top_terms, ',') AS top_terms FROM vectors v JOIN item_terms USING (item_no)",
)
def item_top_terms(t: Tables) -> DataFrame:
    return V.top_terms(t.items.select("item_id", V.tokens().alias("tokens")), ["item_id"]).select("item_id", text_of("top_terms", ","))


# -- clusters ---------------------------------------------------------------------------------------


@query(
    "cluster_members",
    MEMBERS + "SELECT threshold, bucket, cluster_index, cluster_id, item_id FROM members",
)
def cluster_members(t: Tables) -> DataFrame:
    return t.members.select("threshold", "bucket", "cluster_index", "cluster_id", "item_id")


@query(
    "clusters",
    ROLLUP
    + f"""SELECT cluster_id, bucket AS cluster_key, label, product_opportunity, item_count, array_to_string(source_mix, ', ') AS source_mix,
    average_relevance_score::DOUBLE AS average_relevance_score, max_relevance_score::BIGINT AS max_relevance_score,
    array_to_string(top_terms, ', ') AS top_terms, array_to_string(rep_items, ', ') AS representative_item_ids,
    array_to_string(rep_sources, ', ') AS representative_source_ids, {O.lit(C.HASHED_BASIS)} AS grouping_basis,
    {O.lit(C.HASHED_MODEL)} AS embedding_model, threshold AS similarity_threshold FROM rollup_rows""",
)
def clusters(t: Tables) -> DataFrame:
    return C.cluster_table(t.rollup).withColumn("max_relevance_score", whole("max_relevance_score"))


@query(
    "cluster_details",
    ROLLUP
    + """SELECT threshold, cluster_id, cluster_index, batch_index, input_hash, array_to_string(excerpts, ' | ') AS evidence_excerpts
    FROM rollup_rows""",
)
def cluster_details(t: Tables) -> DataFrame:
    return t.rollup.select(
        "threshold", "cluster_id", "cluster_index", "batch_index", "input_hash", text_of("evidence_excerpts", " | ")
    )


@query(
    "cluster_similarity",
    MEMBERS
    + """, placed_members AS (SELECT m.*, v.vector, row_number() OVER (PARTITION BY threshold, cluster_id
      ORDER BY m.relevance_score DESC, m.item_id) AS place FROM members m JOIN vectors v USING (item_no))
    SELECT a.threshold, a.cluster_id, a.place, a.item_id,
      floor(list_dot_product(h.vector, a.vector) * 10000.0 + 0.5) / 10000.0 AS similarity
    FROM placed_members a JOIN placed_members h ON h.threshold = a.threshold AND h.cluster_id = a.cluster_id AND h.place = 1
    WHERE a.place <= 10""",
)
def cluster_similarity(t: Tables) -> DataFrame:
    return C.member_similarity(t.members, t.vectors).withColumn("place", whole("place"))


@query(
    "review_rows",
    ROLLUP
    + f"""SELECT source_id, item_id, d.cluster_id AS current_cluster_id, d.bucket AS current_cluster_key, d.bucket AS reviewed_cluster_label,
    source_type, source_name, title, d.relevance_score::BIGINT AS relevance_score, source_url,
    array_to_string(r.top_terms, ', ') AS top_terms, {O.cut('clean_text', 320, False)} AS text_excerpt
    FROM details d JOIN rollup_rows r ON r.threshold = d.threshold AND r.cluster_id = d.cluster_id
    WHERE d.threshold = 0.12""",
)
def review_rows(t: Tables) -> DataFrame:
    default = t.members.where("threshold = 0.12")
    return C.review_rows(default, t.items, t.rollup).orderBy("current_cluster_key", "source_id").withColumn(
        "relevance_score", whole("relevance_score")
    )


@query("label_template", ROLLUP + "SELECT source_id, bucket AS label FROM details WHERE threshold = 0.12")
def label_template(t: Tables) -> DataFrame:
    return C.label_template(C.review_rows(t.members.where("threshold = 0.12"), t.items, t.rollup))


@query(
    "missing_members",
    MEMBERS + "SELECT item_id FROM members WHERE item_id NOT IN (SELECT item_id FROM items)",
)
def missing_members(t: Tables) -> DataFrame:
    return C.missing_members(t.members, t.items).select("item_id")


@query(
    "missing_members_of_a_batch",
    MEMBERS + "SELECT threshold, item_id FROM members JOIN (SELECT item_id, batch_index FROM items) USING (item_id) WHERE batch_index = 2",
)
def missing_members_of_a_batch(t: Tables) -> DataFrame:
    """Members of the second batch, whose items did not arrive."""
    return C.missing_members(t.members, t.items.where("batch_index <> 2")).select("threshold", "item_id")


@query(
    "predicted_labels",
    ROLLUP
    + """SELECT threshold, md5(d2.text) AS source_id, arg_max(cluster_id, (bucket, cluster_index)) AS predicted
    FROM details JOIN documents d2 ON d2.doc_id = details.doc_id GROUP BY ALL""",
)
def predicted_labels(t: Tables) -> DataFrame:
    """Copies of a document share a source id, so the last of their clusters wins."""
    keys = seeded_items(t.spark, t.sf_dir).select(F.col("source_id").alias("own_id"), F.col("content_key").alias("source_id"))
    members = t.members.join(t.items.select("item_id", F.col("source_id").alias("own_id")), "item_id").join(keys, "own_id")
    return A.predicted_labels(members, ["threshold"])


_DENSE_NODES = """dense_nodes AS (SELECT vec_id AS item_no, vec_id::VARCHAR AS item_id, 'all' AS bucket, 0 AS relevance_score,
    embedding::DOUBLE[] AS vector, label FROM embeddings)"""
DENSE = O.with_(_DENSE_NODES, O.clusters("dense_nodes", O.DENSE_THRESHOLDS))


@query(
    "vector_components",
    DENSE
    + """SELECT threshold, item_no AS node, comp AS component FROM comps""",
)
def vector_components(t: Tables) -> DataFrame:
    least = t.dense.groupBy("threshold", "component").agg(F.min("node").alias("least"))
    return t.dense.join(least, ["threshold", "component"]).select("threshold", "node", F.col("least").alias("component"))


# -- evaluation ---------------------------------------------------------------------------------------

_RATES = """threshold, labeled_item_count, true_positive_pairs, predicted_positive_pairs, gold_positive_pairs, pair_count,
    pairwise_precision::DOUBLE AS pairwise_precision, pairwise_recall::DOUBLE AS pairwise_recall, pairwise_f1::DOUBLE AS pairwise_f1"""


@query(
    "pair_metrics",
    DENSE
    + ", labelled AS (SELECT threshold, item_no AS source_id, label AS gold, comp AS predicted FROM placed),"
    + O.metrics("labelled")
    + f"SELECT {_RATES} FROM metrics",
)
def pair_metrics(t: Tables) -> DataFrame:
    gold = t.read("embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("gold"))
    labelled = t.dense.join(gold, "node").withColumnRenamed("component", "predicted")
    return A.pair_metrics(A.pair_counts(labelled, ["threshold"]))


def _results(members: str, prefix: str, ord_: int, backend: str, model: str) -> str:
    p = prefix
    return (
        f"""{p}labelled AS (SELECT m.threshold, i.source_id, l.quality AS gold, m.cluster_id AS predicted
      FROM {members} m JOIN items i USING (item_id) JOIN labels l ON l.doc_id = i.doc_id),"""
        + O.metrics(f"{p}labelled", p)
        + f""", {p}results AS (SELECT {ord_} AS backend_ord, {O.lit(backend)} AS embedding_backend, {O.lit(model)} AS embedding_model,
      c.threshold AS cluster_similarity_threshold, c.n AS predicted_cluster_count, labeled_item_count,
      pairwise_precision::DOUBLE AS pairwise_precision, pairwise_recall::DOUBLE AS pairwise_recall,
      pairwise_f1::DOUBLE AS pairwise_f1, true_positive_pairs, predicted_positive_pairs, gold_positive_pairs, pair_count
      FROM (SELECT threshold, count(DISTINCT cluster_id) AS n FROM {members} GROUP BY ALL) c JOIN {p}metrics m USING (threshold))"""
    )


_TABLE_NODES = """table_nodes AS (SELECT i.item_no, i.item_id, i.bucket, i.relevance_score,
    coalesce(list_transform(e.embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda y: y * y)))),
      list_transform(range(64), lambda z: 0::DOUBLE)) AS vector
  FROM items i LEFT JOIN embeddings e ON e.vec_id = i.doc_id)"""
_SWEEP = (*_MEMBERS, _results("members", "h_", 1, "hashing", "default"))
_COMPARE = (
    *_SWEEP, _TABLE_NODES, O.clusters("table_nodes", O.DENSE_THRESHOLDS, "t_"),
    _results("t_members", "d_", 2, "table", "embeddings"),
    "both_results AS (SELECT * FROM h_results UNION ALL SELECT * FROM d_results)",
)
_BEST = "pairwise_f1 DESC, pairwise_recall DESC, pairwise_precision DESC"


def _sweep(t: Tables, members: DataFrame, ord_: int, backend: str, model: str) -> DataFrame:
    return A.evaluate(t.with_source(members), t.labels, ["threshold"]).select(
        F.lit(ord_).alias("backend_ord"), F.lit(backend).alias("embedding_backend"), F.lit(model).alias("embedding_model"), "*"
    )


def _compare(t: Tables) -> DataFrame:
    return _sweep(t, t.members, 1, "hashing", "default").unionByName(
        _sweep(t, t.table_members, 2, "table", "embeddings")
    )


@query("threshold_sweep", O.with_(*_SWEEP) + "SELECT * EXCLUDE (backend_ord) FROM h_results")
def threshold_sweep(t: Tables) -> DataFrame:
    return A.evaluation_rows(_sweep(t, t.members, 1, "hashing", "default"))


@query(
    "best_threshold",
    O.with_(*_SWEEP)
    + f"""SELECT * EXCLUDE (backend_ord) FROM h_results
    ORDER BY {_BEST}, predicted_cluster_count, cluster_similarity_threshold LIMIT 1""",
)
def best_threshold(t: Tables) -> DataFrame:
    return A.evaluation_rows(A.best_result(_sweep(t, t.members, 1, "hashing", "default")))


@query("backend_compare", O.with_(*_COMPARE) + "SELECT * EXCLUDE (backend_ord) FROM both_results")
def backend_compare(t: Tables) -> DataFrame:
    return A.evaluation_rows(_compare(t))


@query(
    "best_backend",
    O.with_(*_COMPARE)
    + f"""SELECT * EXCLUDE (backend_ord) FROM both_results
    ORDER BY {_BEST}, backend_ord, predicted_cluster_count, cluster_similarity_threshold LIMIT 1""",
)
def best_backend(t: Tables) -> DataFrame:
    return A.evaluation_rows(A.best_backend(_compare(t)))


@query(
    "missing_labels",
    PREPARED + "SELECT doc_id::VARCHAR AS source_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM items)",
)
def missing_labels(t: Tables) -> DataFrame:
    return A.missing_labels(t.with_source(t.members), t.labels)


# -- collection state, resume, upserts ------------------------------------------------------------------

_LOG = """log AS (SELECT 'user-' || user_id AS source, event_type AS query, date_diff('day', DATE '2024-01-01', ts::DATE) AS page_number,
    count(*) AS raw_count, count(*) FILTER (value > 10) AS item_count,
    arg_max(json_extract_string(props, '$.k')::INT >= 50, event_id) AS has_more, any_value(user_id) AS user_id
  FROM events GROUP BY 1, 2, 3)"""
_STATES = """states AS (SELECT source, query, count(*) AS page_count, max(page_number) AS last_page_number,
    max(page_number) + 1 AS next_page_number, sum(raw_count)::BIGINT AS total_raw_count, sum(item_count)::BIGINT AS total_item_count,
    NOT arg_max(has_more, page_number) AS completed FROM log GROUP BY ALL)"""
STATES = O.with_(_LOG, _STATES)


@query("page_log", O.with_(_LOG) + "SELECT * EXCLUDE (user_id) FROM log ORDER BY source, query, page_number")
def page_log(t: Tables) -> DataFrame:
    return H.ordered_pages(t.page_log)


@query("collection_state", STATES + "SELECT * FROM states")
def collection_state(t: Tables) -> DataFrame:
    return H.collection_state(t.page_log)


@query("resume_points", STATES + "SELECT source, query, next_page_number FROM states WHERE NOT completed")
def resume_points(t: Tables) -> DataFrame:
    return H.resume_points(H.collection_state(t.page_log))


def _wanted(t: Tables) -> DataFrame:
    """Every (user, event type) pair is wanted, also those no page was ever collected for."""
    events = t.read("events")
    types = events.agg(F.collect_set("event_type").alias("types"))  # one row, a few types
    return (
        events.select("user_id").distinct().join(F.broadcast(types))
        .select(F.concat(F.lit("user-"), "user_id").alias("source"), F.explode("types").alias("query"))
        .withColumn("first_page", F.lit(1).cast("long"))
    )


@query(
    "resume_plan",
    STATES
    + """, wanted AS (SELECT DISTINCT 'user-' || u.user_id AS source, y.event_type AS query
      FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) y),
    taken AS (SELECT source, query, sum(least(item_count, 2))::BIGINT AS items_taken FROM log GROUP BY ALL)
    SELECT source, query, CASE WHEN last_page_number IS NULL THEN 1 WHEN total_item_count > coalesce(items_taken, 0) THEN last_page_number
      ELSE next_page_number END AS next_page_number, coalesce(items_taken, 0) AS items_taken
    FROM wanted LEFT JOIN states USING (source, query) LEFT JOIN taken USING (source, query)
    WHERE coalesce(NOT completed, true) OR total_item_count > coalesce(items_taken, 0)""",
)
def resume_plan(t: Tables) -> DataFrame:
    log = t.page_log
    taken = log.groupBy("source", "query").agg(F.sum(F.least("item_count", F.lit(2))).alias("items_taken"))
    return H.resume_plan(_wanted(t), H.collection_state(log), taken)


@query(
    "queries_to_collect",
    STATES
    + """SELECT source, query, 1::BIGINT AS first_page, next_page_number FROM states WHERE NOT completed""",
)
def queries_to_collect(t: Tables) -> DataFrame:
    return I.queries_to_collect(_wanted(t), H.resume_points(H.collection_state(t.page_log)))


_NEWEST = "run-19"


@query(
    "resume_dedupe",
    _KEYED
    + f"""SELECT a.source_index, a.source_name, a.key AS source_id,
      CASE WHEN o.key IS NOT NULL THEN 'seen_in_resume_chain' END AS duplicate_reason,
      CASE WHEN o.key IS NOT NULL THEN 'run-18' END AS resume_from_run_id
    FROM (SELECT *, 'docs' AS sname FROM keyed WHERE run_id = {O.lit(_NEWEST)}) a
    LEFT JOIN (SELECT DISTINCT key FROM keyed WHERE run_id <> {O.lit(_NEWEST)}) o USING (key)""",
)
def resume_dedupe(t: Tables) -> DataFrame:
    keyed = t.keyed.withColumns({"origin": F.col("source_name"), "source_name": F.lit("documents")})
    newest = keyed.where(F.col("run_id") == _NEWEST)
    earlier = keyed.where(F.col("run_id") != _NEWEST)
    marked = H.mark_seen(newest, earlier, "run-18")
    return marked.select(
        "source_index", F.col("origin").alias("source_name"), "source_id", "duplicate_reason", "resume_from_run_id"
    )


@query("source_keys", _KEYED + "SELECT DISTINCT source_name, key AS source_id FROM keyed")
def source_keys(t: Tables) -> DataFrame:
    return H.source_keys(t.keyed)


@query(
    "upsert_raw_items",
    _KEYED
    + """SELECT run_id, source_name, key AS source_id, max(source_index) AS source_index, arg_max(title, source_index) AS title
    FROM keyed GROUP BY ALL""",
)
def upsert_raw_items(t: Tables) -> DataFrame:
    rows = H.last_wins(t.keyed, H.TABLE_KEYS["raw_items"], [F.desc("source_index")])
    return rows.select("run_id", "source_name", "source_id", "source_index", "title")


# -- run history -------------------------------------------------------------------------------------------

_RUNS = """runs AS (SELECT s.run_id,
    strftime(DATE '2024-01-01' + (substr(s.run_id, 5)::INT), '%Y-%m-%dT00:00:00+00:00') AS generated_at_utc,
    min(s.product_theme) AS venture_category,
    CASE WHEN substr(s.run_id, 5)::INT > 0 THEN 'run-' || lpad((substr(s.run_id, 5)::INT - 1)::VARCHAR, 2, '0') ELSE '' END AS resume_from_run_id,
    (SELECT count(*) FROM items i WHERE i.run_id = s.run_id) AS total_items_analyzed,
    (SELECT count(*) FROM evidence e WHERE e.run_id = s.run_id) AS evidence_rows,
    (SELECT count(*) FROM items i WHERE i.run_id = s.run_id AND is_demo_fallback) AS demo_fallback_items
  FROM seeded s GROUP BY s.run_id)"""
RUNS = EVIDENCE + "," + _RUNS


@query(
    "list_runs",
    RUNS
    + """ SELECT run_id, generated_at_utc, venture_category, total_items_analyzed, evidence_rows, demo_fallback_items
    FROM runs ORDER BY generated_at_utc DESC, run_id LIMIT 20""",
)
def list_runs(t: Tables) -> DataFrame:
    return H.list_runs(t.runs)


_TREE = """tree AS (SELECT DISTINCT user_id, 'u' || user_id AS run_id, CASE WHEN user_id > 1 THEN 'u' || (user_id // 2) ELSE '' END AS parent FROM events)"""


@query(
    "lineage",
    O.with_(
        _TREE,
        """walk(run_id, ancestor, parent, depth) AS (SELECT run_id, run_id, parent, 0 FROM tree
      UNION ALL SELECT w.run_id, r.run_id, r.parent, w.depth + 1 FROM walk w JOIN tree r ON r.run_id = w.parent)""",
    )
    + "SELECT run_id, ancestor, depth::BIGINT AS depth FROM walk",
)
def lineage(t: Tables) -> DataFrame:
    """Every user is a run that resumes from the user with half its number."""
    user = F.col("user_id")
    runs = (
        t.read("events").select("user_id").distinct().select(
            F.concat(F.lit("u"), user).alias("run_id"),
            F.when(user > 1, F.concat(F.lit("u"), F.floor(user / 2))).otherwise("").alias("resume_from_run_id"),
        )
    )
    return H.all_lineages(runs).select("run_id", "ancestor", whole("depth"))


@query(
    "chain_overview",
    RUNS
    + """ SELECT max(run_id) AS latest_run_id, min(run_id) AS root_run_id, string_agg(run_id, ',' ORDER BY run_id DESC) AS run_ids,
    count(*) AS run_count, min(generated_at_utc) AS generated_at_utc_start, max(generated_at_utc) AS generated_at_utc_end,
    array_to_string(list_sort(list(DISTINCT venture_category)), ',') AS venture_categories,
    string_agg(run_id || '=' || resume_from_run_id, ',' ORDER BY run_id) FILTER (resume_from_run_id <> '') AS resume_links,
    sum(total_items_analyzed)::BIGINT AS total_items_analyzed, sum(evidence_rows)::BIGINT AS evidence_rows,
    sum(demo_fallback_items)::BIGINT AS demo_fallback_items FROM runs WHERE run_id <= 'run-09'""",
)
def chain_overview(t: Tables) -> DataFrame:
    return H.chain_overview(t.stored("runs"), t.lineage).select(
        "latest_run_id", "root_run_id", text_of("run_ids", ","), "run_count", "generated_at_utc_start",
        "generated_at_utc_end", text_of("venture_categories", ","), text_of("resume_links", ","),
        "total_items_analyzed", "evidence_rows", "demo_fallback_items",
    )


_ARTIFACTS = f"""artifacts AS (
  SELECT run_id, batch_index, item_id, source_id, 'classification' AS artifact_type, {O.lit(E.CLASSIFIER[0])} AS model_name,
    {O.lit(E.CLASSIFIER[1])} AS model_version, {_ITEM_HASH} AS input_hash FROM items
  UNION ALL SELECT run_id, batch_index, item_id, source_id, 'embedding', {O.lit(E.EMBEDDER[0])}, {O.lit(E.EMBEDDER[1])}, {_ITEM_HASH} FROM items
  UNION ALL SELECT 'run-00', batch_index, cluster_id, cluster_id, 'evidence_cluster', {O.lit(C.CLUSTERER[0])}, {O.lit(C.CLUSTERER[1])}, input_hash
    FROM rollup_rows WHERE threshold = 0.12)"""
ARTIFACTS = O.with_(*_MEMBERS, O.ROLLUP, _ARTIFACTS)
_ARTIFACT_ROW = "run_id, batch_index, item_id, source_id, artifact_type, model_name, model_version, input_hash"
_ARTIFACT_ORDER = "run_id DESC, batch_index, item_id, artifact_type, model_name, input_hash"


def _artifact_rows(rows: DataFrame) -> DataFrame:
    return rows.drop("artifact", "created_at").withColumn("batch_index", whole("batch_index"))


@query("model_artifacts", ARTIFACTS + f"SELECT {_ARTIFACT_ROW} FROM artifacts")
def model_artifacts(t: Tables) -> DataFrame:
    return _artifact_rows(t.artifacts)


@query(
    "upsert_artifacts",
    ARTIFACTS
    + f"""SELECT {_ARTIFACT_ROW}, CASE WHEN artifact_type = 'embedding' THEN '2' ELSE '1' END AS created_at,
    artifact_type = 'embedding' AS renewed FROM artifacts""",
)
def upsert_artifacts(t: Tables) -> DataFrame:
    """The artifacts saved, then the embeddings saved again with another payload: the later row of a key stays."""
    first = t.artifacts.withColumn("created_at", F.lit("1"))
    second = t.artifacts.where("artifact_type = 'embedding'").withColumns({"created_at": F.lit("2"), "artifact": F.lit("new")})
    rows = H.last_wins(second.unionByName(first), H.TABLE_KEYS["model_artifacts"], [F.desc("created_at")])
    return rows.withColumn("renewed", F.col("artifact") == "new").drop("artifact").withColumn("batch_index", whole("batch_index"))


@query(
    "chain_artifact_page",
    ARTIFACTS + f"SELECT {_ARTIFACT_ROW} FROM artifacts WHERE artifact_type = 'embedding' AND run_id <= 'run-09' ORDER BY {_ARTIFACT_ORDER} LIMIT 50",
)
def chain_artifact_page(t: Tables) -> DataFrame:
    return _artifact_rows(H.artifact_page(H.in_chain(t.stored("model_artifacts"), t.chain), artifact_type="embedding"))


@query(
    "run_artifact_page",
    ARTIFACTS
    + f"SELECT {_ARTIFACT_ROW} FROM artifacts WHERE run_id = 'run-00' AND batch_index = 1 ORDER BY {_ARTIFACT_ORDER} LIMIT 50 OFFSET 5",
)
def run_artifact_page(t: Tables) -> DataFrame:
    one_run = t.artifacts.where("run_id = 'run-00'")
    return _artifact_rows(H.artifact_page(one_run, batch_index=1, offset=5))


@query(
    "chain_evidence_page",
    EVIDENCE
    + f"""SELECT {_EVIDENCE_ROW} FROM evidence WHERE run_id <= 'run-09'
    ORDER BY signal_relevance_score DESC, run_id, item_no, category_ord LIMIT 50""",
)
def chain_evidence_page(t: Tables) -> DataFrame:
    return _evidence(H.evidence_page(H.in_chain(t.stored("evidence_rows"), t.chain)))


@query(
    "chain_evidence_deep_page",
    EVIDENCE
    + f"""SELECT {_EVIDENCE_ROW} FROM evidence WHERE run_id <= 'run-09'
    ORDER BY signal_relevance_score DESC, run_id, item_no, category_ord LIMIT 40 OFFSET (SELECT count(*) // 2 FROM evidence WHERE run_id <= 'run-09')""",
)
def chain_evidence_deep_page(t: Tables) -> DataFrame:
    """A page from the middle of a chain's evidence."""
    half = H.S.kept_rows(H.S.manifest(t.spark, t.store), "evidence_rows", t.chain) // 2
    return _evidence(H.stored_evidence_page(t.spark, t.store, t.chain, limit=40, offset=half))


@query(
    "chain_table_counts",
    O.with_(*_MEMBERS, O.ROLLUP, _ARTIFACTS, O.EVIDENCE, _LOG)
    + """SELECT 'raw_items' AS name, count(*) AS n FROM assessed WHERE run_id <= 'run-09'
    UNION ALL SELECT 'prepared_items', count(*) FROM items WHERE run_id <= 'run-09'
    UNION ALL SELECT 'excluded_items', count(*) FROM assessed WHERE NOT kept AND run_id <= 'run-09'
    UNION ALL SELECT 'relevance_excluded_items', count(*) FROM prepared WHERE exclude_for_relevance AND run_id <= 'run-09'
    UNION ALL SELECT 'evidence_rows', count(*) FROM evidence WHERE run_id <= 'run-09'
    UNION ALL SELECT 'collection_pages', count(*) FROM log WHERE user_id % 20 <= 9
    UNION ALL SELECT 'processing_batches', count(*) FROM (SELECT DISTINCT run_id, batch_index FROM assessed WHERE run_id <= 'run-09')
    UNION ALL SELECT 'model_artifacts', count(*) FROM artifacts WHERE run_id <= 'run-09'
    UNION ALL SELECT 'unique_raw_items', count(*) FROM (SELECT DISTINCT source_name, source_id FROM assessed WHERE run_id <= 'run-09')""",
)
def chain_table_counts(t: Tables) -> DataFrame:
    return H.stored_counts(t.spark, t.store, t.chain)


@query("saved_runs", RUNS + " SELECT * FROM runs")
def saved_runs(t: Tables) -> DataFrame:
    return t.stored("runs").select(t.runs.columns)


@query(
    "saved_raw_items",
    ASSESSED + "SELECT run_id, source_type, count(*) AS n, count(DISTINCT source_id) AS ids FROM assessed GROUP BY ALL",
)
def saved_raw_items(t: Tables) -> DataFrame:
    """What the store holds of each run; two of them were saved before with other rows."""
    return t.stored("raw_items").groupBy("run_id", "source_type").agg(
        F.count("*").alias("n"), F.count_distinct("source_id").alias("ids")
    )


@query(
    "saved_run_batches",
    PREPARED
    + """SELECT a.run_id, a.batch_index, 'completed' AS status, min(a.source_index) AS raw_item_start_index,
    max(a.source_index) AS raw_item_end_index, count(*) AS raw_items, count(*) FILTER (a.kept) AS quality_candidates,
    count(*) FILTER (NOT a.kept) AS quality_excluded, count(*) FILTER (a.kept AND NOT p.exclude_for_relevance) AS relevance_prepared,
    count(*) FILTER (a.kept AND p.exclude_for_relevance) AS relevance_excluded
    FROM assessed a LEFT JOIN prepared p USING (source_index) WHERE a.run_id = 'run-03' GROUP BY 1, 2""",
)
def saved_run_batches(t: Tables) -> DataFrame:
    whole_counts = ["batch_index", "raw_item_start_index", "raw_item_end_index"]
    return t.stored("processing_batches").where("run_id = 'run-03'").withColumns({c: whole(c) for c in whole_counts})


@query(
    "chain_group_counts",
    ARTIFACTS
    + """SELECT artifact_type AS name, count(*) AS n FROM artifacts WHERE run_id <= 'run-09' GROUP BY ALL
    UNION ALL SELECT 'completed', count(*) FROM (SELECT DISTINCT run_id, batch_index FROM assessed WHERE run_id <= 'run-09')""",
)
def chain_group_counts(t: Tables) -> DataFrame:
    return H.group_counts(t.stored("model_artifacts"), "artifact_type", t.chain).unionByName(
        H.group_counts(t.stored("processing_batches"), "status", t.chain)
    )


_RUN_STATES = """run_log AS (SELECT *, 'run-' || lpad((user_id % 20)::VARCHAR, 2, '0') AS run_id FROM log),
    run_states AS (SELECT run_id, source, query, NOT arg_max(has_more, page_number) AS completed FROM run_log GROUP BY ALL)"""


@query(
    "chain_state_counts",
    O.with_(_LOG, _RUN_STATES)
    + "SELECT count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS open FROM run_states WHERE run_id <= 'run-09'",
)
def chain_state_counts(t: Tables) -> DataFrame:
    return H.state_counts(t.stored("collection_states"), t.chain)


@query(
    "run_summary",
    RUNS
    + """, per_category AS (SELECT category, count(*) AS n FROM evidence WHERE run_id = 'run-07' GROUP BY ALL),
    per_source AS (SELECT source_type, count(*) AS n FROM seeded WHERE run_id = 'run-07' GROUP BY ALL)
    SELECT run_id, generated_at_utc, venture_category, total_items_analyzed, evidence_rows, demo_fallback_items,
      (SELECT string_agg(source_type || '=' || n, ',' ORDER BY source_type) FROM per_source) AS diagnostics,
      (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM per_category) AS categories
    FROM runs WHERE run_id = 'run-07'""",
)
def run_summary(t: Tables) -> DataFrame:
    diagnostics = t.raw.groupBy("run_id", F.col("source_type").alias("source_key")).agg(
        F.count("*").cast("string").alias("diagnostics_json")
    )
    summaries = t.evidence.groupBy("run_id", "category").agg(F.count("*").alias("evidence_count"))
    flat = lambda m: F.array_join(
        F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return H.run_summary(t.runs, diagnostics, summaries, "run-07").select(
        "run_id", "generated_at_utc", "venture_category", "total_items_analyzed", "evidence_rows", "demo_fallback_items",
        flat("collector_diagnostics").alias("diagnostics"), flat("category_summaries").alias("categories"),
    )


@query(
    "chain_themes",
    O.with_(O.SEEDED) + "SELECT DISTINCT product_theme FROM seeded ORDER BY 1",
)
def chain_themes(t: Tables) -> DataFrame:
    return t.raw.select("product_theme").distinct().orderBy("product_theme")


@query(
    "chain_source_themes",
    O.with_(O.SEEDED) + "SELECT DISTINCT product_theme || '/' || source_name AS theme FROM seeded WHERE run_id <= 'run-09' ORDER BY 1",
)
def chain_source_themes(t: Tables) -> DataFrame:
    """Themes of the runs of a chain, apart by source, of which each run has its own."""
    rows = H.in_chain(t.stored("raw_items"), t.chain)
    return rows.select(F.concat_ws("/", "product_theme", "source_name").alias("theme")).distinct().orderBy("theme")


@query(
    "run_pages",
    O.with_(_LOG, _RUN_STATES)
    + """SELECT source, query, page_number, raw_count, item_count, has_more FROM run_log WHERE run_id = 'run-04' ORDER BY ALL""",
)
def run_pages(t: Tables) -> DataFrame:
    """The stored pages of one run, of which alone the folder is read."""
    pages = H.read_table(t.spark, t.store, "collection_pages", run_ids=["run-04"])
    return H.ordered_pages(pages).select("source", "query", "page_number", "raw_count", "item_count", "has_more")


_TWO = "CASE WHEN source_index % 2 = 1 THEN 'first' ELSE 'second' END"


@query(
    "saved_chain_evidence",
    EVIDENCE
    + f"""SELECT {_TWO} AS run_id, source_id, category, array_to_string(matched_terms, ', ') AS matched_terms, evidence_excerpt,
    signal_relevance_score::BIGINT AS signal_relevance_score FROM evidence""",
)
def saved_chain_evidence(t: Tables) -> DataFrame:
    """Two runs over all items, saved whole and read back along the chain of the second."""
    rows = H.read_table(t.spark, t.two_runs, "evidence_rows", run_ids=t.two_chain)
    return rows.select("run_id", "source_id", "category", text_of("matched_terms", ", "), "evidence_excerpt", whole("signal_relevance_score"))


@query(
    "saved_chain_counts",
    EVIDENCE
    + f"""SELECT 'raw_items' AS name, count(*) AS n FROM assessed UNION ALL SELECT 'unique_raw_items', count(*) FROM assessed
    UNION ALL SELECT 'prepared_items', count(*) FROM items UNION ALL SELECT 'excluded_items', count(*) FROM assessed WHERE NOT kept
    UNION ALL SELECT 'relevance_excluded_items', count(*) FROM prepared WHERE exclude_for_relevance
    UNION ALL SELECT 'evidence_rows', count(*) FROM evidence UNION ALL SELECT 'collection_pages', 0
    UNION ALL SELECT 'processing_batches', count(*) FROM (SELECT DISTINCT {_TWO}, batch_index FROM assessed)""",
)
def saved_chain_counts(t: Tables) -> DataFrame:
    names = [name for name in H.COUNTED_TABLES if name != "model_artifacts"]
    return H.table_counts({name: H.read_table(t.spark, t.two_runs, name) for name in names}, t.two_chain)


@query(
    "saved_chain_overview",
    EVIDENCE
    + f""", per_run AS (SELECT {_TWO} AS run_id, count(*) AS n FROM items GROUP BY ALL)
    SELECT 'second' AS latest_run_id, 'first' AS root_run_id, 'second,first' AS run_ids, 2::BIGINT AS run_count, '2026-01-01' AS generated_at_utc_start,
    '2026-01-03' AS generated_at_utc_end, 't1,t2' AS venture_categories, 'second=first' AS resume_links,
    (SELECT sum(n) FROM per_run)::BIGINT AS total_items_analyzed, (SELECT count(*) FROM evidence) AS evidence_rows""",
)
def saved_chain_overview(t: Tables) -> DataFrame:
    runs = H.read_table(t.spark, t.two_runs, "runs")
    return H.chain_overview(runs, H.lineage(runs, "second")).select(
        "latest_run_id", "root_run_id", text_of("run_ids", ","), "run_count", "generated_at_utc_start", "generated_at_utc_end",
        text_of("venture_categories", ","), text_of("resume_links", ","), "total_items_analyzed", "evidence_rows",
    )


@query(
    "classification_payload",
    PREPARED
    + """SELECT item_id, primary_label, array_to_string(labels, ', ') AS labels, relevance_score::BIGINT AS relevance_score,
    quality_score::BIGINT AS quality_score, r_text AS relevance_reasons, p_text AS relevance_penalties FROM items""",
)
def classification_payload(t: Tables) -> DataFrame:
    fields = "primary_label string, labels array<string>, relevance_score long, quality_score long, relevance_reasons string, relevance_penalties string"
    rows = t.artifacts.where("artifact_type = 'classification'").select("item_id", F.from_json("artifact", fields).alias("p"))
    return rows.select("item_id", "p.*").withColumn("labels", text_of("labels", ", "))


@query(
    "embedding_payload",
    VECTORS
    + f"""SELECT v.item_id, 'sparse_hashing' AS embedding_type, 64::BIGINT AS dimensions, len(v.tokens)::BIGINT AS token_count,
    array_to_string(coalesce(top_terms, []), ',') AS top_terms, {O.lit(", ".join(V.SOURCE_TEXT_FIELDS))} AS source_text_fields,
    array_to_string(list_filter(range(64), lambda s: floor(vector[s + 1] * 1000000.0 + 0.5) <> 0), ',') AS slots,
    array_to_string(list_filter(list_transform(range(1, 65), lambda i: {_SIX}), lambda x: x <> 0), ',') AS micro_values
    FROM vectors v LEFT JOIN item_terms USING (item_no)""",
)
def embedding_payload(t: Tables) -> DataFrame:
    fields = (
        "embedding_type string, dimensions long, token_count long, top_terms array<string>, source_text_fields array<string>, "
        "nonzero_indices array<string>, values array<double>"
    )
    rows = t.artifacts.where("artifact_type = 'embedding'").select("item_id", F.from_json("artifact", fields).alias("p")).select("item_id", "p.*")
    micro = F.transform("values", lambda v: F.floor(v * 1000000.0 + 0.5).cast("string"))
    return rows.select(
        "item_id", "embedding_type", "dimensions", "token_count", text_of("top_terms", ","), text_of("source_text_fields", ", "),
        F.array_join("nonzero_indices", ",").alias("slots"), F.array_join(micro, ",").alias("micro_values"),
    )


@query(
    "cluster_payload",
    ROLLUP
    + """SELECT cluster_id, bucket, label, item_count, array_to_string(rep_items, ', ') AS representative_item_ids,
    array_to_string(source_mix, ', ') AS source_mix, average_relevance_score::DOUBLE AS average_relevance_score,
    array_to_string(top_terms, ', ') AS top_terms, array_to_string(excerpts, ' | ') AS evidence_excerpts FROM rollup_rows WHERE threshold = 0.12""",
)
def cluster_payload(t: Tables) -> DataFrame:
    fields = (
        "cluster_id string, bucket string, label string, item_count long, representative_item_ids array<string>, source_mix array<string>, "
        "average_relevance_score double, top_terms array<string>, evidence_excerpts array<string>"
    )
    rows = t.artifacts.where("artifact_type = 'evidence_cluster'").select(F.from_json("artifact", fields).alias("p")).select("p.*")
    lists = {c: F.array_join(c, " | " if c == "evidence_excerpts" else ", ") for c in ("representative_item_ids", "source_mix", "top_terms", "evidence_excerpts")}
    return rows.withColumns(lists)


# -- streams ------------------------------------------------------------------------------------------------

_CONVERSATION_ITEMS = r"""
seeded AS (SELECT conv_id * 1000 + turn AS source_index, 'stream' AS run_id, 'discussion' AS source_type, 'x' AS source_name,
    conv_id || '-' || turn AS source_id, '' AS source_url, """ + O.lit(I.DISCUSSION_TITLE) + r""" AS title, role AS author,
    '' AS product_theme, '' AS query_theme, '' AS rating, text, false AS is_demo_fallback, conv_id AS doc_id FROM conversations)"""


@query(
    "stream_scored_items",
    O.with_(_CONVERSATION_ITEMS, O.ASSESSED)
    + """SELECT source_id, quality_score::BIGINT AS quality_score, array_to_string(quality_reasons, '; ') AS quality_reasons,
    array_to_string(exclude_reasons, '; ') AS exclude_reasons, kept FROM assessed""",
)
def stream_scored_items(t: Tables) -> DataFrame:
    return t.streamed_items.select(
        "source_id", whole("quality_score"), text_of("quality_reasons"), text_of("exclude_reasons"), "kept"
    )


@query(
    "stream_scored_relevance",
    O.with_(_CONVERSATION_ITEMS, O.ASSESSED, O.PREPARED)
    + """SELECT source_id, relevance_score::BIGINT AS relevance_score, r_text AS relevance_reasons, p_text AS relevance_penalties,
    exclude_for_relevance FROM prepared""",
)
def stream_scored_relevance(t: Tables) -> DataFrame:
    return t.streamed_items.where("kept").select(
        "source_id", whole("relevance_score"), text_of("relevance_reasons"), text_of("relevance_penalties"), "exclude_for_relevance"
    )


@query("stream_question_items", ORACLES["question_page_items"])
def stream_question_items(t: Tables) -> DataFrame:
    """Question pages as they land, file by file."""
    t.question_pages  # writes the page files
    target, checkpoint = new_path(t.spark, "stream-questions"), new_path(t.spark, "stream-checkpoint")
    J.run_append(J.question_stream(t.spark, t.question_folder, files_per_batch=2), target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).select(
        "source_type", "source_name", "source_id", "source_url", "title", "author", "created_at",
        "reviewed_product", "rating", whole("page_number"), F.md5("text").alias("text_md5"),
    )


@query(
    "stream_first_seen",
    """SELECT md5(text) AS source_id, count(DISTINCT 1) AS times FROM documents
    WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 9 = 0) GROUP BY 1""",
)
def stream_first_seen(t: Tables) -> DataFrame:
    documents = t.read("documents").select(
        F.lit("documents").alias("source_type"),
        F.lit("documents").alias("source_name"),
        F.md5("text").alias("source_id"),
        F.col("doc_id").alias("arrival"),
    )
    source, target = new_path(t.spark, "arrivals"), new_path(t.spark, "first-seen")
    documents.repartition(4).write.parquet(source)
    stream = J.table_stream(documents, source, files_per_batch=1)
    earlier = documents.where("arrival % 9 = 0")  # what runs before this one hold
    J.run_first_seen(stream, target, new_path(t.spark, "stream-checkpoint"), "arrival", earlier).awaitTermination()
    return t.spark.read.parquet(target).groupBy("source_id").agg(F.count("*").alias("times"))


@query("stream_collection_state", STATES + "SELECT * FROM states")
def stream_collection_state(t: Tables) -> DataFrame:
    source, target = new_path(t.spark, "page-log"), new_path(t.spark, "states")
    t.page_log.repartition(3).write.parquet(source)
    stream = J.table_stream(t.page_log, source, files_per_batch=1)
    J.run_collection_state(stream, target, new_path(t.spark, "stream-checkpoint")).awaitTermination()
    return J.latest_state(t.spark, target)
