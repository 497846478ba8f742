"""Dense numbers over a total order, without one task that sees every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.plans.stages import stage


def _in_ranges(rows: DataFrame, keys: list[Column], per_range: int | None) -> DataFrame:
    """Rows sorted into ranges, with ``_row`` in the order of the sort and the range it lies in. The
    ranges are sampled, hence written once before they are read again. ``per_range``: rows of a
    range, about; by default as many ranges as the session's shuffles have."""
    ranges = [] if per_range is None else [max(1, -(-rows.count() // per_range))]
    sorted_rows = rows.repartitionByRange(*ranges, *keys).sortWithinPartitions(*keys)
    numbered = sorted_rows.withColumn("_row", F.monotonically_increasing_id())
    return stage(numbered, "ranges").withColumn("_range", F.shiftright("_row", 33))


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def global_rank(
    rows: DataFrame, groups: list[str], order: list[Column], name: str, per_range: int | None = None
) -> DataFrame:
    """1-based rank inside ``groups`` (null is a group) by any total ``order``, for groups of any size.

    The rows are range-partitioned on the whole sort key, so a huge group spreads over many
    tasks; the row id inside the sorted range and the number of rows of the group in earlier
    ranges give the rank. The table of ranges holds a row per task and group.
    """
    placed = _in_ranges(rows, [*[F.asc(g) for g in groups], *order], per_range)
    keys = [f"_g{i}" for i in range(len(groups))]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys)]
    spans = placed.groupBy(*named, F.col("_range").alias("_r")).agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    own = (F.col("_range") == F.col("_r")) & _same([F.lit(0), *map(F.col, groups)], [F.lit(0), *map(F.col, keys)])
    return (
        placed.join(spans.drop("_size"), own)
        .withColumn(name, F.col("_start") + F.col("_row") - F.col("_first") + 1)
        .drop("_row", "_range", "_r", "_first", "_start", *keys)
    )


def dense_positions(
    rows: DataFrame, key: str, name: str, chunk: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """1-based rank by a unique integer ``key``, dense or sparse. Only the keys are sorted; the rest
    of the row is joined to them. ``counted`` is a cheaper frame with the same keys (the input of
    costly columns, say); ``chunk`` sets the rows of a range."""
    keys = (rows if counted is None else counted).select(key)
    places = global_rank(keys, [], [F.asc(key)], name, chunk)
    return rows.join(places.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def running_total(rows: DataFrame, key: str, value: str, name: str, chunk: int | None = None) -> DataFrame:
    """Running total of ``value`` by a unique ``key``: the sums of the ranges, then the rows inside."""
    placed = _in_ranges(rows, [F.asc(key)], chunk)
    sums = placed.groupBy(F.col("_range").alias("_r")).agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = sums.select("_r", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_range").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(starts, F.col("_range") == F.col("_r"))
        .withColumn(name, F.col("_start") + F.sum(value).over(inside))
        .drop("_row", "_range", "_r", "_start")
    )


def first_by_rank(rows: DataFrame, groups: list[str], order: list[str], how_many: int) -> DataFrame:
    """The first ``how_many`` rows of each group (null is one) by a total order of columns. Group and
    order are ranked alone; the rows are joined to those that stay."""
    keys = list(dict.fromkeys([*groups, *order]))
    places = global_rank(rows.select(*keys), groups, [F.asc(name) for name in order], "_rank")
    kept = places.where(F.col("_rank") <= how_many).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return rows.join(kept, _same(list(map(F.col, keys)), [F.col(f"_k{i}") for i in range(len(keys))]), "left_semi")


def whole_part(value: Column, by: int) -> Column:
    """Integer quotient of a non-negative whole number, exact at any size."""
    return F.call_function("div", value, F.lit(by))


def batch_of(key: Column, batch_size: int) -> Column:
    """1-based batch of a 1-based position."""
    return whole_part(key - 1, batch_size) + 1
