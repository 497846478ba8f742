"""Run history: lineage, chain reads, collection state, resume, upserts and stored tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.operators import store as S
from weaksift.operators.numbering import running_total, whole_part
from weaksift.plans.stages import stage

# The stored tables and their keys (run_id comes first in each).
TABLE_KEYS = {
    "runs": ["run_id"],
    "collector_diagnostics": ["run_id", "source_key"],
    "raw_items": ["run_id", "source_name", "source_id"],
    "collection_pages": ["run_id", "source", "query", "page_number"],
    "collection_states": ["run_id", "source", "query"],
    "prepared_items": ["run_id", "item_id"],
    "excluded_items": ["run_id", "source_index"],
    "relevance_excluded_items": ["run_id", "item_id"],
    "processing_batches": ["run_id", "batch_index"],
    "model_artifacts": [
        "run_id", "batch_index", "item_id", "artifact_type", "model_name", "model_version", "input_hash",
    ],
    "evidence_rows": ["run_id", "item_id", "category"],
    "category_summaries": ["run_id", "category"],
}
RAW_PARTITIONS = ["run_id", "source_type"]
MOST_RUNS = 10_000  # of a chain whose ids go into a filter
SKETCHES, SKETCH_BITS = "raw_item_sketches", 14  # a standard error of 0.8 %, 16 KB a run
EVIDENCE_ORDER = ["signal_relevance_score", "item_no", "category_ord"]  # within a run
SCORES = "evidence_scores"  # how many evidence rows of each score a run has
KEY_BUCKETS = 200  # of a table of seen keys
COUNTED_TABLES = [
    "raw_items", "prepared_items", "excluded_items", "relevance_excluded_items", "evidence_rows",
    "collection_pages", "processing_batches", "model_artifacts",
]


# -- stored tables -----------------------------------------------------------------------------


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert result: of several rows with one key the last in ``order`` stays. The rank filter
    also runs before the shuffle, so a hot key sends one row per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _written(rows: DataFrame, root: str, name: str, run_ids: list[str] | None, check: bool) -> dict:
    """A version of a table and what it replaces; ``check``: whether its keys have to be told apart first."""
    if name == "evidence_rows" and set(EVIDENCE_ORDER) <= set(rows.columns):
        best = [F.desc(c) if c == EVIDENCE_ORDER[0] else F.asc(c) for c in EVIDENCE_ORDER]
        rows = rows.sortWithinPartitions("run_id", *best)  # so that a file's row groups hold few scores each
    version, runs = S.write_version(rows, root, name, RAW_PARTITIONS if name == "raw_items" else ["run_id"])
    if check and runs:
        written = rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}/{version}")
        if not written.groupBy(*TABLE_KEYS[name]).count().where("count > 1").isEmpty():
            S.drop_version(rows.sparkSession, root, name, version)
            raise ValueError(f"{name} has rows with the same key and no arrival column to tell the last")
    return {"schema": json.loads(rows.schema.json()), "replaced": run_ids or list(runs), "runs": runs, "version": version}


def key_sketches(raw_items: DataFrame) -> DataFrame:
    """run_id, sketch: a mergeable sketch of each run's (source_name, source_id), for counts of distinct items over
    any runs without their keys."""
    key = F.concat_ws("\x1f", F.coalesce("source_name", F.lit("")), F.coalesce("source_id", F.lit("")))
    return raw_items.groupBy("run_id").agg(F.hll_sketch_agg(key, F.lit(SKETCH_BITS)).alias("sketch"))


def save_run(
    tables: dict[str, DataFrame], root: str, arrival: str | None = None, run_ids: list[str] | None = None
) -> int:
    """Every stored table of a run, which replaces the run's earlier rows in all of them at once (see ``store``).
    ``run_ids`` are the runs being saved, by default those that a table has rows of; a run named without rows ends up
    empty. One row per key: the last by the ``arrival`` column; a table without it must have unique keys. The rows are
    written once, and may come from the stored tables themselves. Returns the number of the manifest."""
    changes = {}
    for name, rows in tables.items():
        keys = TABLE_KEYS.get(name)
        if keys is None:
            continue  # a view of the run, made again from the stored tables
        told = arrival in rows.columns
        rows = last_wins(rows, keys, [F.desc(arrival)]) if told else rows
        changes[name] = _written(rows, root, name, run_ids, check=not told)
        if name == "raw_items":
            own = rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}/{changes[name].pop('version')}")
            changes[SKETCHES] = _written(key_sketches(own), root, SKETCHES, run_ids, check=False)
        if name == "evidence_rows" and EVIDENCE_ORDER[0] in rows.columns:
            own = rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}/{changes[name].pop('version')}")
            scores = own.groupBy("run_id", EVIDENCE_ORDER[0]).agg(F.count("*").alias("n"))
            changes[SCORES] = _written(scores, root, SCORES, run_ids, check=False)
    for change in changes.values():
        change.pop("version", None)
    return S.commit(next(iter(tables.values())).sparkSession, root, changes) if changes else 0


def append_artifacts(rows: DataFrame, root: str, arrival: str = "created_at") -> int:
    """Artifacts added to those of the same runs, last wins per key. Fails if another save has changed these runs
    meanwhile, so no artifact of it is lost."""
    spark, name = rows.sparkSession, "model_artifacts"
    now = S.manifest(spark, root)
    rows = stage(rows, "artifacts")
    run_ids = [r["run_id"] for r in rows.select("run_id").distinct().collect()]  # the runs being saved
    merged = S.read_version(spark, root, name, now, run_ids).unionByName(rows) if name in now else rows
    change = _written(last_wins(merged, TABLE_KEYS[name], [F.desc(arrival)]), root, name, run_ids, check=False)
    del change["version"]
    return S.commit(spark, root, {name: change}, based_on=now)


def read_table(spark: SparkSession, root: str, name: str, run_ids: list[str] | None = None, number: int | None = None) -> DataFrame:
    """A stored table as the last manifest has it (or the one with a ``number``); one that no run has rows for is empty.
    With ``run_ids`` only these runs' folders are looked at. What is read stays as it is while others save."""
    return S.read_version(spark, root, name, S.manifest(spark, root, number), run_ids)


# -- lineage -----------------------------------------------------------------------------------


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.coalesce("resume_from_run_id", F.lit("")).alias("parent"))


def all_lineages(runs: DataFrame, start: list[str] | None = None) -> DataFrame:
    """``run_id, ancestor, depth`` of every run (or of those in ``start``): the walk from a run to its
    root, the run itself at depth 0. It stops at a parent that is not stored and at a cycle.

    Each round knows the ancestors up to twice the distance of the round before: every run's farthest
    known ancestor brings the ancestors it knows itself. A chain of n runs takes log2 n rounds. A run
    comes back to itself or to a run of its walk only in a cycle; the nearest place of each stays.
    """
    parents = _parents(runs)
    stored = parents.select(F.col("run_id").alias("parent"))
    up = stage(parents.join(stored, "parent", "left_semi").where("parent <> run_id").select("run_id", "parent"), "parents")
    known = runs.select("run_id", F.col("run_id").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    known = stage(known.unionByName(up.select("run_id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))), "lineage")
    reach = 1
    while True:
        edge = known.where(F.col("depth") == reach).select("run_id", F.col("ancestor").alias("via"))
        beyond = known.where("depth > 0").select(F.col("run_id").alias("via"), "ancestor", F.col("depth").alias("more"))
        further = edge.join(beyond, "via").groupBy("run_id", "ancestor").agg((F.min("more") + reach).alias("depth"))
        further = stage(further.join(known.select("run_id", "ancestor"), ["run_id", "ancestor"], "left_anti"), "lineage")
        if further.isEmpty():
            break
        known, reach = stage(known.unionByName(further), "lineage"), reach * 2
    found = known.select("run_id", "ancestor", F.col("depth").cast("int").alias("depth"))
    return found if start is None else found.where(F.col("run_id").isin(start))


def lineage(runs: DataFrame, run_id: str) -> DataFrame:
    """``run_id, ancestor, depth`` of one run, of any depth: pointers to the parent are doubled until none
    goes on, and the ancestors so far are those that the pointers of each round reach."""
    pointers = _parents(runs).join(runs.select(F.col("run_id").alias("parent")), "parent", "left_semi")
    pointers = stage(pointers.where("parent <> run_id").select("run_id", F.col("parent").alias("to")), "pointers")
    found = stage(
        runs.where(F.col("run_id") == run_id).select("run_id", F.col("run_id").alias("ancestor"), F.lit(0).alias("depth")).limit(1), "walk"
    )
    step = 1
    while True:
        hops = found.join(pointers.withColumnRenamed("run_id", "ancestor"), "ancestor")
        hops = hops.groupBy("run_id", F.col("to").alias("ancestor")).agg((F.min("depth") + step).alias("depth"))
        new = stage(hops.join(found.select("ancestor"), "ancestor", "left_anti").select(*found.columns), "walk")
        if new.isEmpty():
            return found
        found = stage(found.unionByName(new), "walk")
        ahead = pointers.select(F.col("run_id").alias("to"), F.col("to").alias("next"))
        pointers = stage(pointers.join(ahead, "to").select("run_id", F.col("next").alias("to")), "pointers")
        step *= 2


def chain_runs(chain: DataFrame, most: int = MOST_RUNS) -> list[str]:
    """The run ids of a lineage, as one run's chain of resumes (checked to be few)."""
    ids = [r["ancestor"] for r in chain.select("ancestor").distinct().limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} runs; join on the chain instead")
    return sorted(ids)


def in_chain(rows: DataFrame, chain: DataFrame | list[str]) -> DataFrame:
    """Rows of the runs of a lineage. A list of run ids (``chain_runs``) is a plain filter, which prunes the
    partitions of a stored table before anything is read; a lineage of any length is joined."""
    if isinstance(chain, list):
        return rows.where(F.col("run_id").isin(chain))
    return rows.join(chain.select(F.col("ancestor").alias("run_id")), "run_id", "left_semi")


# -- collection state and resume ----------------------------------------------------------------


def collection_state(pages: DataFrame, keys: list[str] = ["source", "query"]) -> DataFrame:
    """One row per (source, query) from the page log."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("page_count"),
        F.max("page_number").alias("last_page_number"),
        (F.max("page_number") + 1).alias("next_page_number"),
        F.sum("raw_count").alias("total_raw_count"),
        F.sum("item_count").alias("total_item_count"),
        (~F.max_by("has_more", "page_number")).alias("completed"),
    )


def resume_points(states: DataFrame, source: str | None = None) -> DataFrame:
    open_ = states.where(~F.col("completed"))
    if source is not None:
        open_ = open_.where(F.col("source") == source)
    return open_.select("source", "query", "next_page_number")


def resume_plan(queries: DataFrame, states: DataFrame, items_taken: DataFrame) -> DataFrame:
    """Every wanted query with where to go on: queries never reached start at ``first_page``, and
    a query whose last page was cut short by the item cap repeats that page, so none is lost.
    ``queries``: source, query, first_page. ``items_taken``: source, query, items_taken."""
    joined = queries.join(states, ["source", "query"], "left").join(items_taken, ["source", "query"], "left")
    taken = F.coalesce("items_taken", F.lit(0))
    cut = F.col("total_item_count") > taken
    return joined.where(F.coalesce(~F.col("completed"), F.lit(True)) | cut).select(
        "source",
        "query",
        F.when(F.col("last_page_number").isNull(), F.col("first_page"))
        .when(cut, F.col("last_page_number"))
        .otherwise(F.col("next_page_number"))
        .alias("next_page_number"),
        taken.alias("items_taken"),
    )


def source_keys(raw_items: DataFrame) -> DataFrame:
    return raw_items.select(
        F.coalesce("source_name", F.lit("")).alias("source_name"),
        F.coalesce("source_id", F.lit("")).alias("source_id"),
    ).distinct()


def mark_seen(new_items: DataFrame, seen: DataFrame, resume_from: str) -> DataFrame:
    """Adds ``duplicate_reason`` and ``resume_from_run_id`` (null for new rows) with one join, so
    the kept and the duplicate rows are two filters of one result."""
    known = source_keys(seen).withColumn("_seen", F.lit(True))
    keyed = new_items.withColumns(
        {
            "source_name": F.coalesce("source_name", F.lit("")),
            "source_id": F.coalesce("source_id", F.lit("")),
        }
    )
    return keyed.join(known, ["source_name", "source_id"], "left").select(
        *new_items.columns,
        F.when(F.col("_seen"), F.lit("seen_in_resume_chain")).alias("duplicate_reason"),
        F.when(F.col("_seen"), F.lit(resume_from)).alias("resume_from_run_id"),
    )


def add_seen_keys(raw_items: DataFrame, table: str, buckets: int = KEY_BUCKETS) -> None:
    """Adds the keys of ``raw_items`` to a catalog table that holds them in buckets by (source_name, source_id). The keys
    are dealt to the buckets before they are written, so each bucket gets one file; how many buckets there are is
    settled by the first write."""
    spark = raw_items.sparkSession
    if spark.catalog.tableExists(table):
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
        buckets = int(described["data_type"])
    keys = source_keys(raw_items).repartition(buckets, "source_name", "source_id")
    keys.write.mode("append").format("parquet").bucketBy(buckets, "source_name", "source_id").saveAsTable(table)


def drop_seen_in(new_items: DataFrame, table: str) -> DataFrame:
    """As ``drop_seen``, against a table of keys in buckets: the new items are dealt to the same buckets, and the stored keys,
    of which there may be far more, stay where they are."""
    stored = new_items.sparkSession.table(table).hint("merge")
    key = ["source_name", "source_id"]
    filled = new_items.withColumns({f"_{c}": F.col(c) for c in key} | {c: F.coalesce(c, F.lit("")) for c in key})
    return filled.join(stored, key, "left_anti").select(*[F.col(f"_{c}").alias(c) if c in key else F.col(c) for c in new_items.columns])


def drop_seen(new_items: DataFrame, seen: DataFrame) -> DataFrame:
    """The new rows whose (source_name, source_id) no earlier run holds; null counts as the empty text,
    as in ``mark_seen``."""
    known = source_keys(seen).toDF("_name", "_id")
    same = (F.coalesce("source_name", F.lit("")) == F.col("_name")) & (F.coalesce("source_id", F.lit("")) == F.col("_id"))
    return new_items.join(known, same, "left_anti")


# -- reads ---------------------------------------------------------------------------------------


def list_runs(runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return (
        runs.select(
            "run_id", "generated_at_utc", "venture_category", "total_items_analyzed", "evidence_rows",
            "demo_fallback_items",
        )
        .orderBy(F.desc("generated_at_utc"), "run_id")
        .offset(offset)
        .limit(limit)
    )


def evidence_page(evidence: DataFrame, limit: int = 50, offset: int = 0, category: str | None = None) -> DataFrame:
    """A page of evidence, best first; ties in insert order (run by run, then extraction order)."""
    rows = evidence if category is None else evidence.where(F.col("category") == category)
    return (
        rows.orderBy(F.desc("signal_relevance_score"), "run_id", "item_no", "category_ord")
        .offset(offset)
        .limit(limit)
    )


def stored_evidence_page(spark: SparkSession, root: str, chain: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """The same page of a store's evidence, however deep. The counts of each score, kept at each save, tell which scores the
    page has; these go into the read as bounds, and since evidence is stored best first, row groups of other
    scores are skipped. What is sorted is the rows of the page's scores alone."""
    score = EVIDENCE_ORDER[0]
    counts = read_table(spark, root, SCORES, run_ids=chain).groupBy(score).agg(F.sum("n").alias("n"))
    above, skip, bounds = 0, 0, []
    for row in counts.orderBy(F.desc(score)).collect():  # a row per score
        if above < offset + limit and above + row["n"] > offset:
            skip = skip if bounds else offset - above
            bounds.append(row[score])
        above += row["n"]
    rows = read_table(spark, root, "evidence_rows", run_ids=chain)
    rows = rows.where(F.col(score).between(bounds[-1], bounds[0])) if bounds else rows.limit(0)
    return evidence_page(rows, limit, skip)


def artifact_page(
    artifacts: DataFrame,
    artifact_type: str | None = None,
    batch_index: int | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of artifacts of one run or a chain, newest run first."""
    rows = artifacts
    if artifact_type is not None:
        rows = rows.where(F.col("artifact_type") == artifact_type)
    if batch_index is not None:
        rows = rows.where(F.col("batch_index") == batch_index)
    return (
        rows.orderBy(F.desc("run_id"), "batch_index", "item_id", "artifact_type", "model_name", "input_hash")
        .offset(offset)
        .limit(limit)
    )


def ordered_pages(pages: DataFrame) -> DataFrame:
    return pages.orderBy("source", "query", "page_number")


def run_summary(runs: DataFrame, diagnostics: DataFrame, summaries: DataFrame, run_id: str) -> DataFrame:
    """The run row with its diagnostics and category counts as maps; no row when unknown. A run
    has two diagnostics and one summary per category, so the maps are small."""
    as_map = lambda rows, key, value, name: rows.where(F.col("run_id") == run_id).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name)
    )
    return (
        runs.where(F.col("run_id") == run_id)
        .join(as_map(diagnostics, "source_key", "diagnostics_json", "collector_diagnostics"), "run_id", "left")
        .join(as_map(summaries, "category", "evidence_count", "category_summaries"), "run_id", "left")
    )


def table_counts(tables: dict[str, DataFrame], chain: DataFrame | list[str]) -> DataFrame:
    """Rows per table over a chain, with the distinct raw items; each table is read once. Of the raw items
    only the keys are, counted first per key and then over the keys."""
    parts = [
        in_chain(tables[name], chain).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name in COUNTED_TABLES
        if name in tables and name != "raw_items"
    ]
    by_key = in_chain(tables["raw_items"], chain).groupBy("source_name", "source_id").agg(F.count("*").alias("rows"))
    raw = by_key.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_items"), F.count("*").alias("unique_raw_items"))
    counted = raw.unpivot([], ["raw_items", "unique_raw_items"], "name", "n")
    for part in parts:
        counted = counted.unionByName(part)
    return counted


def stored_counts(spark: SparkSession, root: str, chain: list[str]) -> DataFrame:
    """The same as ``table_counts`` for a store: rows by the counts kept at each save, so of the tables only the keys
    of the raw items are read, for the distinct ones."""
    content = S.manifest(spark, root)
    kept = [(name, S.kept_rows(content, name, chain)) for name in COUNTED_TABLES if name in content]
    keys = read_table(spark, root, "raw_items", run_ids=chain).groupBy("source_name", "source_id").agg(F.lit(1))
    unique = keys.agg(F.count("*").alias("n")).select(F.lit("unique_raw_items").alias("name"), "n")
    return spark.createDataFrame(kept, "name string, n long").unionByName(unique)


def about_unique_items(spark: SparkSession, root: str, chain: list[str]) -> DataFrame:
    """n: about how many distinct raw items a chain has, from the sketches of its runs (16 KB each)."""
    sketches = read_table(spark, root, SKETCHES, run_ids=chain)
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n"))


def group_counts(rows: DataFrame, column: str, chain: DataFrame | list[str]) -> DataFrame:
    return in_chain(rows, chain).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


def state_counts(states: DataFrame, chain: DataFrame | list[str]) -> DataFrame:
    return in_chain(states, chain).agg(
        F.count_if("completed").alias("completed"), F.count_if(~F.col("completed")).alias("open")
    )


def chain_overview(runs: DataFrame, chain: DataFrame) -> DataFrame:
    """One row for a chain: ends, links, themes and summed volume. ``chain`` is the lineage of one
    run; its length is the number of resumes, so its ids fit an array."""
    rows = chain.select(F.col("ancestor").alias("run_id"), "depth").join(runs, "run_id")
    by_depth = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("depth", value))), lambda e: e[value])
    return rows.agg(
        F.min_by("run_id", "depth").alias("latest_run_id"),
        F.max_by("run_id", "depth").alias("root_run_id"),
        by_depth("run_id").alias("run_ids"),
        F.count("*").alias("run_count"),
        F.max_by("generated_at_utc", "depth").alias("generated_at_utc_start"),
        F.min_by("generated_at_utc", "depth").alias("generated_at_utc_end"),
        F.array_sort(F.collect_set("venture_category")).alias("venture_categories"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.coalesce("resume_from_run_id", F.lit("")) != "",
                    F.concat("run_id", F.lit("="), "resume_from_run_id"),
                )
            )
        ).alias("resume_links"),
        F.sum("total_items_analyzed").alias("total_items_analyzed"),
        F.sum("evidence_rows").alias("evidence_rows"),
        F.sum("demo_fallback_items").alias("demo_fallback_items"),
    ).where("run_count > 0")


def batch_of_items(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Batch of items that arrive with only their number: the batch whose cumulative range of
    candidates holds it; past the end, the last batch. ``items``: item_id.

    A range join on the number would pair every item with every batch; both sides are cut into
    cells of the number line instead, and a batch is repeated in each cell it touches.
    """
    cell = 1 << 16
    ends = running_total(batches, "batch_index", "quality_candidates", "_end").select(
        "batch_index", (F.col("_end") - F.col("quality_candidates")).alias("_after"), "_end"
    )
    last = batches.agg(F.max("batch_index").alias("_last"))  # one row
    spread = ends.where("_end > _after").withColumn(
        "_cell", F.explode(F.sequence(whole_part(F.col("_after") + 1, cell), whole_part(F.col("_end"), cell)))
    )
    numbered = items.withColumn("_no", F.regexp_extract("item_id", r"-(\d+)$", 1).try_cast("long")).withColumn(
        "_cell", whole_part(F.col("_no"), cell)
    )
    inside = (F.col("_no") > F.col("_after")) & (F.col("_no") <= F.col("_end"))
    return (
        numbered.alias("n")
        .join(spread.alias("s"), (F.col("n._cell") == F.col("s._cell")) & inside, "left")
        .join(F.broadcast(last))
        .select(*[f"n.{c}" for c in items.columns], F.coalesce("s.batch_index", "_last").alias("batch_index"))
    )
