"""The similarity graph of vectors, exact, as a spanning forest, without comparing all pairs.

Only the components at some thresholds (the levels) are wanted, so a pair needs no comparison if it cannot reach the
lowest level, or if the two are joined already at the highest level that they could reach.

1. Identical vectors are one point; the others hang on it.
2. Pivots (a bounded sample of each bucket's points) go to every task. Each point hangs on its nearest pivot, which makes
   cells; a point that reaches several pivots joins them, which makes a tree of the pivots. So the components of
   pivots are known at every level, and those of points that hang on one at that level.
3. Two points of one bucket are at an angle of at least the gap between a point's angle to a pivot and the angles of that
   pivot's cell (the triangle inequality). A cell is cut into rings by angle. A point visits a ring only if that leaves room
   for a level at which it does not hang on its own pivot; of two points that both hang, the one of the lesser cell visits
   the other if their pivots are not joined at that level, and of two that both do not, the one of the lesser bundle does.
4. Cells are bundled up to a block of points, and a visitor goes once to each bundle that has a ring for it. A bundle and its
   visitors are compared by matrix products in single precision; what is joined already is left out of them, and a
   link is taken only if its cosine in double precision reaches the level. What they add is at most an edge a point and
   level. The forest of all edges so far is the result.

Points that hang on a pivot at the highest level and meet no foreign cell near enough visit nothing. On vectors that have
clusters the work grows with the points times the pivots; on vectors without any (all about equally far apart) no
bound excludes a pair, and cells and visitors meet block by block, of a bounded size each.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.operators.forest import FOREST_SCHEMA, Sets, small_forest, spanning_forest
from weaksift.plans.stages import stage

ANCHORS_PER_BUCKET = 1_024
MAX_ANCHORS = 16_384  # in all; 64 doubles each are 8 MB
BLOCK = 65_536  # points of a cell, or visitors, that meet in one task; 64 doubles each are 32 MB
LEAST_BLOCK = 16_384  # smaller ones would send points again more often than they spread the work
BUNDLES = 8  # that a bucket's points make at least, if that leaves blocks that large
ROWS_AT_ONCE = 512  # points that meet pivots and rings in one matrix product, to bound its memory
TILE = 1_024, 8_192  # rows and columns of a product of blocks; 32 MB
MOST_PARTITIONS = 4_096  # of the tasks where blocks meet
RING = np.pi / 36  # width of a ring of a cell
SLACK = 2e-3  # radians that rounding and single precision may move an angle by, amply

HUNG_SCHEMA = "bucket string, node long, vector array<double>, cell int, near double, ring int, src long, dst long, w double, other int"
VISIT_SCHEMA = "bucket string, bundle int, block int, node long, vector binary, cell int, near double"
RINGS_SCHEMA = "bucket string, node long, rings array<int>"
RINGS = 64  # numbers of rings kept apart for each cell


def rounded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines rounded to 9 places, so that the order of a sum decides no threshold."""
    return np.floor(left @ right.T * 1e9 + 0.5) / 1e9


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _cells(ids: np.ndarray, matrix: np.ndarray) -> SimpleNamespace:
    """What tasks know of one bucket: its pivots (``ids``, ``matrix``) and, later, ``joined`` (level x pivot: the least pivot
    of its component), the rings (``cell``, ``ring``, ``low`` and ``high``: angles to the pivot; ``half`` of the cell), and the
    ``bundle`` of each half with the ``blocks`` of each bundle, of ``block`` points."""
    return SimpleNamespace(ids=ids, matrix=matrix)


def similarity_forest(
    vectors: DataFrame,
    levels: list[float],
    anchors_per_bucket: int = ANCHORS_PER_BUCKET,
    max_anchors: int = MAX_ANCHORS,
    block: int = BLOCK,
    few_edges: int | None = None,
) -> DataFrame:
    """``vectors`` has ``node`` (unique long), ``bucket`` and ``vector`` (unit length or zero); it is read a few times, so
    it should be a stage. Returns the edges ``src, dst, w`` of a spanning forest of the graph "cosine >= least level" of
    each bucket, whose components at each of the ``levels`` are those of the graph. A zero vector has no edge."""
    points, copies = _points(vectors)
    hung, tree, cells = _hang(points, sorted(levels), anchors_per_bucket, max_anchors, block)
    edges = copies.unionByName(_hang_edges(hung, tree, cells, min(levels)))
    visits = _visits(hung, sorted(levels), cells)
    edges = edges.unionByName(_compare(hung, visits, sorted(levels), cells, block))
    return spanning_forest(edges, **({} if few_edges is None else {"few_edges": few_edges}))


def comparisons(vectors: DataFrame, levels: list[float], **options) -> dict[str, int]:
    """How many pairs ``similarity_forest`` has to compare: points with pivots, and visitors with the rings they visit."""
    block = options.get("block", BLOCK)
    points, _ = _points(vectors)
    hung, _, cells = _hang(
        points, sorted(levels), options.get("anchors_per_bucket", ANCHORS_PER_BUCKET), options.get("max_anchors", MAX_ANCHORS), block
    )
    visits = _asked_rings(hung, sorted(levels), cells)
    sizes = hung.where("other is null").groupBy("bucket", _ring_number().alias("number")).agg(F.count("*").alias("n"))
    met = visits.select("bucket", F.explode("rings").alias("number")).join(sizes, ["bucket", "number"])
    n = points.count()
    pivots = sum(len(c.ids) for c in cells.values())
    per_bucket = {r["bucket"]: r["n"] for r in points.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    return {
        "points": n,
        "pivots": pivots,
        "with_pivots": sum(per_bucket[b] * len(c.ids) for b, c in cells.items()),
        "with_visitors": met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
    }


def _ring_number() -> Column:
    return ((F.col("cell") + 1) * RINGS + F.least("ring", F.lit(RINGS - 1))).cast("int")


def _points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per distinct vector (its least node), and the edges of the others to it."""
    there = vectors.select("node", "bucket", "vector").where(F.exists("vector", lambda v: v != 0))
    points = stage(there.groupBy("bucket", "vector").agg(F.min("node").alias("node")), "points")
    first = points.select("bucket", "vector", F.col("node").alias("_first"))
    itself = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    copies = there.join(first, ["bucket", "vector"]).where("node <> _first").select(
        F.col("_first").alias("src"), F.col("node").alias("dst"), (F.floor(itself * 1e9 + 0.5) / 1e9).alias("w")
    )
    return points, copies


def _sample(points: DataFrame, per_bucket: int, limit: int) -> dict[str, SimpleNamespace]:
    """Pivots by the order of a hash: about three times the square root of a bucket's points. With very many buckets the sample
    is cut, and buckets without a pivot are compared in blocks; that costs time, never a result."""
    w = W.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    sizes = points.groupBy("bucket").agg(F.ceil(3 * F.sqrt(F.count("*"))).alias("_most"))
    chosen = points.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= per_bucket)
    rows = chosen.join(sizes, "bucket").where(F.col("_place") <= F.col("_most")).orderBy("_place", "bucket")
    found = rows.select("bucket", "node", "vector").limit(limit).toArrow().to_pandas()  # max_anchors rows at most
    return {
        bucket: _cells(group["node"].to_numpy(np.int64), np.stack(group["vector"].to_list()))
        for bucket, group in found.groupby("bucket")
    }


class Joined:
    """What is joined at each level, among numbered components: ``rows`` and ``columns`` (level x point) hold the numbers."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, levels: list[float]):
        numbers = []
        self.names = []  # of each level: how many numbers there are
        for level in range(len(levels)):
            names, number = np.unique(np.concatenate([rows[level], columns[level]]), return_inverse=True)
            self.names.append(len(names))
            numbers.append(number)
        self.levels = levels
        self.rows = np.array([n[: rows.shape[1]] for n in numbers], np.int32)
        self.columns = np.array([n[rows.shape[1] :] for n in numbers], np.int32)

    def _join(self, level: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Joins each of ``rows`` with its column; which of them were apart until then."""
        ends = np.stack([self.rows[level, rows], self.columns[level, columns]], axis=1)
        names, at = np.unique(ends, return_inverse=True)
        sets = Sets(len(names))
        apart = np.array([sets.join(i, j) for i, j in at.reshape(-1, 2).tolist()], bool)
        if apart.any():
            to = np.arange(self.names[level], dtype=np.int32)
            to[names] = names[[sets.find(i) for i in range(len(names))]]
            self.rows[level], self.columns[level] = to[self.rows[level]], to[self.columns[level]]
        return apart

    def least_columns(self) -> np.ndarray:
        """level x column: the least column that it is joined to."""
        out = np.zeros(self.columns.shape, np.int64)
        for level, numbers in enumerate(self.columns):
            _, first, number = np.unique(numbers, return_index=True, return_inverse=True)
            out[level] = first[number]
        return out

    def apart(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``rows`` and ``columns`` without those that are joined with all of the other side, at the highest level and so at
        every level; what one side has of other components stays."""
        a, b = self.rows[-1, rows], self.columns[-1, columns]
        if (b == b[0]).all():
            rows = rows[a != b[0]]
        elif (a == a[0]).all():
            columns = columns[b != a[0]]
        return rows, columns

    def _parts(self, level: int, rows: np.ndarray, columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places in ``rows`` and ``columns`` of rectangles that hold all pairs that are apart, without those of the component
        that more than half of the rows are of, if that is less; or no places, for all pairs."""
        a, b = self.rows[level, rows], self.columns[level, columns]
        common = np.partition(a, len(a) // 2)[len(a) // 2]
        other_rows, other_columns = np.flatnonzero(a != common), np.flatnonzero(b != common)
        same = len(a) - len(other_rows)
        if len(other_rows) * len(b) + same * len(other_columns) > len(a) * len(b) / 2:
            return []
        return [(other_rows, np.arange(len(b))), (np.flatnonzero(a == common), other_columns)]

    def links(self, sims: np.ndarray, rows: np.ndarray, columns: np.ndarray, exact, slack: float) -> list[tuple[int, int, float]]:
        """Links ``row, column, cosine`` that join what ``sims`` (of ``rows`` and ``columns``) joins, from the highest level down.
        ``sims`` may be off by ``slack``; ``exact(rows, columns)`` tells the cosines."""
        taken: list[tuple[int, int, float]] = []
        for level in reversed(range(len(self.levels))):
            parts = self._parts(level, rows, columns) if len(rows) and len(columns) else []
            for i, j in parts:
                if len(i) and len(j):
                    near = sims[i] if len(j) == len(columns) else sims.take(j, axis=1)[i]
                    taken += self._links(level, near, rows[i], columns[j], exact, slack)
            if not parts:
                taken += self._links(level, sims, rows, columns, exact, slack)
        return taken

    def _links(self, level: int, sims: np.ndarray, rows: np.ndarray, columns: np.ndarray, exact, slack: float) -> list:
        """Those of one level. As in Borůvka's rounds every row and every column that is apart from something it reaches takes
        one such link, so components at least halve a round."""
        taken: list[tuple[int, int, float]] = []
        near, least = sims, self.levels[level] - slack - 1e-9
        while len(rows) and len(columns):
            apart = near >= least
            reach = np.flatnonzero(apart.any(axis=1))
            if not len(reach):
                break
            if len(reach) < len(rows):
                near, rows, apart = near[reach], rows[reach], apart[reach]
            apart &= self.rows[level, rows][:, None] != self.columns[level, columns][None, :]
            column_of = apart.argmax(axis=1)
            some_rows = np.flatnonzero(apart[np.arange(len(rows)), column_of])
            if not len(some_rows):
                break
            some_columns = np.flatnonzero(apart.any(axis=0))
            at = np.concatenate([some_rows, apart[:, some_columns].argmax(axis=0)])
            to = np.concatenate([column_of[some_rows], some_columns])
            cosines = exact(rows[at], columns[to])
            real = cosines >= self.levels[level]
            if not real.all():  # below this level; a lower one may still be reached
                near = near.copy() if near is sims else near
                near[at[~real], to[~real]] = -2.0
            i, j, w = rows[at[real]], columns[to[real]], cosines[real]
            new = self._join(level, i, j)
            i, j, w = i[new], j[new], w[new]
            if len(i):
                for lower in range(level):
                    self._join(lower, i, j)
                taken += zip(i.tolist(), j.tolist(), w.tolist())
            near, rows, columns = near[some_rows].take(some_columns, axis=1), rows[some_rows], columns[some_columns]
        return taken


def _hang(points: DataFrame, levels, per_bucket: int, limit: int, block: int) -> tuple[DataFrame, DataFrame, dict]:
    """All points with their cell, how near its pivot is, and their ring, beside links between pivots (``other`` not null:
    ``cell`` and ``other`` are pivots, and ``src``, ``dst`` the point and the pivot whose cosine ``w`` is); the tree of
    each bucket's pivots; and what tasks know of the buckets."""
    pivots = _sample(points, per_bucket, limit)
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def hang(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in HUNG_SCHEMA.split(", ")]
        known: dict[str, np.ndarray] = {}  # level x pivot: what this task has joined
        for batch in batches:
            for bucket, group in batch.groupby("bucket"):
                own = shared.value.get(bucket)
                for start in range(0, len(group), ROWS_AT_ONCE):
                    rows = group.iloc[start : start + ROWS_AT_ONCE][["bucket", "node", "vector"]]
                    if own is None:
                        yield rows.assign(cell=-1, near=-1.0, ring=0, src=None, dst=None, w=None, other=None)[columns]
                        continue
                    sims = rounded(np.stack(rows["vector"].to_list()), own.matrix)
                    best = sims.argmax(axis=1)
                    near = sims[np.arange(len(rows)), best]
                    # No ring holds points that hang at different levels.
                    ring = np.floor(_angles(near) / RING).astype(int) + len(levels) - np.searchsorted(levels, near, side="right")
                    column = known.get(bucket, np.tile(np.arange(len(own.ids)), (len(levels), 1)))
                    alone = len(own.ids) + np.arange(len(rows))
                    row = np.array([np.where(near >= level, column[i, best], alone) for i, level in enumerate(levels)])
                    joined = Joined(row, column, levels)
                    found = joined.links(sims, np.arange(len(rows)), np.arange(len(own.ids)), lambda i, j: sims[i, j], 0.0)
                    known[bucket] = joined.least_columns()
                    at, other = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
                    link = pd.DataFrame({
                        "bucket": bucket, "cell": best[at], "other": other, "w": sims[at, other],
                        "src": rows["node"].to_numpy(np.int64)[at], "dst": own.ids[other],
                    })
                    link["vector"] = None
                    parts = [rows.assign(cell=best, near=near, ring=ring).reindex(columns=columns), link.reindex(columns=columns)]
                    for part in parts:
                        yield part.astype({"node": "Int64", "src": "Int64", "dst": "Int64", "other": "Int64", "cell": "Int64", "ring": "Int64"})

    hung = stage(points.select("bucket", "node", "vector").mapInPandas(hang, HUNG_SCHEMA), "hung")
    # The tree of a bucket's pivots: a row a pair at most before, a row a pivot after.
    links = hung.where("other is not null").groupBy("bucket", "cell", "other").agg(F.max(F.struct("w", "src", "dst")).alias("e"))
    tree = (
        links.select("bucket", F.col("cell").cast("long").alias("src"), F.col("other").cast("long").alias("dst"), "e.w",
                     F.col("e.src").alias("point"), F.col("e.dst").alias("pivot"))
        .groupBy("bucket").applyInPandas(small_forest, "bucket string, src long, dst long, w double, point long, pivot long")
        .toPandas()  # max_anchors rows at most
    )
    rings = (
        hung.where("other is null").groupBy("bucket", "cell", "ring")
        .agg(F.count("*").alias("n"), F.min("near").alias("far"), F.max("near").alias("near")).toPandas()
    )
    for bucket, group in rings.groupby("bucket"):
        if bucket not in pivots:
            pivots[bucket] = _cells(np.zeros(0, np.int64), np.zeros((0, 0)))
        own = pivots[bucket]
        links = tree[tree["bucket"] == bucket].sort_values("w", ascending=False)
        own.joined = np.array([_joined(links[links["w"] >= level], len(own.ids)) for level in levels])
        own.cell, own.ring = group["cell"].to_numpy(np.int64), np.minimum(group["ring"].to_numpy(np.int64), RINGS - 1)
        own.low, own.high = _angles(group["near"].to_numpy()), _angles(group["far"].to_numpy())
        own.half = _half(own.cell, group["near"].to_numpy(), levels)
        own.block = min(block, max(LEAST_BLOCK, -(-int(group["n"].sum()) // BUNDLES)))
        own.bundle, own.blocks = _bundles(group.groupby(own.half)["n"].sum().to_dict(), own, own.block)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(tree["point"], tree["pivot"], tree["w"])]
    return hung, points.sparkSession.createDataFrame(edges, FOREST_SCHEMA), pivots


def _half(cell: np.ndarray, near: np.ndarray, levels: list[float]) -> np.ndarray:
    """The number of the half of a cell: of what hangs at every level, or of the rest, which others need not visit if it comes
    to them. Without pivots all is one half."""
    return np.maximum(cell, 0) * 2 + (near < levels[-1])


def _bundles(sizes: dict[int, int], own: SimpleNamespace, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each half of a cell, and how many blocks a bundle is cut into: halves of one kind, of cells that are joined
    at the same levels, come together up to ``block`` points; a larger half is a bundle of its own. What fits one block stays
    together."""
    bundle, blocks, filled, kind = np.zeros(2 * max(1, len(own.ids)), np.int64), [], block, None
    if sum(sizes.values()) <= block:
        return bundle, np.ones(1, np.int64)
    near = lambda half: (half % 2, tuple(own.joined[:, half // 2]) if len(own.ids) else (), half)
    for half in sorted(sizes, key=near):
        n = sizes[half]
        if n > block or filled + n > block or half % 2 != kind:
            blocks.append(-(-n // block))
            filled, kind = 0, half % 2
        bundle[half] = len(blocks) - 1
        filled = block if n > block else filled + n
    return bundle, np.array(blocks, np.int64)


def _joined(links: pd.DataFrame, n: int) -> np.ndarray:
    sets = Sets(n)
    for a, b in zip(links["src"].tolist(), links["dst"].tolist()):
        sets.join(a, b)
    return np.fromiter(map(sets.find, range(n)), np.int64, n)


def _hang_edges(hung: DataFrame, tree: DataFrame, cells: dict[str, SimpleNamespace], least: float) -> DataFrame:
    """The edges from points to their pivots, and the tree of the pivots."""
    shared = hung.sparkSession.sparkContext.broadcast({bucket: own.ids for bucket, own in cells.items()})

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, rows in batch.groupby("bucket"):
                pivot = shared.value[bucket][rows["cell"].to_numpy(np.int64)]
                yield pd.DataFrame({"src": pivot, "dst": rows["node"].to_numpy(np.int64), "w": rows["near"].to_numpy()})

    near = hung.where((F.col("near") >= least) & F.col("other").isNull()).select("bucket", "cell", "node", "near")
    return near.mapInPandas(edges, FOREST_SCHEMA).unionByName(tree)


def _limits(steps: np.ndarray) -> np.ndarray:
    """The largest gap that leaves room for each step, and one that none is small enough for."""
    return np.append(_angles(steps - 1e-6), -10.0).astype(np.float32)


def _needed(rows: pd.DataFrame, own: SimpleNamespace, steps: np.ndarray, once: bool = False) -> np.ndarray:
    """row x ring: whether the row has to visit the ring; ``once``: unless all that is in the ring visits the row."""
    cell, near = rows["cell"].to_numpy(np.int64), rows["near"].to_numpy()
    if not len(own.ids):  # no pivot, no bound
        return np.ones((len(rows), len(own.cell)), bool)
    limits = _limits(steps)
    # Levels are nested: a row must come if the gap leaves room for the least level at which it does not hang on its pivot,
    first = np.searchsorted(steps, near, side="right")
    loose = limits[first][:, None]
    # or for the least one at which the pivots are apart, if the ring hangs there; those in the ring that do not hang on their
    # pivot at the level come over themselves.
    cells, place = np.unique(cell, return_inverse=True)
    parted = (own.joined[:, cells][:, :, None] == own.joined[:, None, :]).sum(axis=0)[:, own.cell]
    hangs = np.searchsorted(steps, np.cos(own.low) + 1e-6, side="right") - 1
    both = limits[np.where((parted <= hangs) & (cells[:, None] < own.cell), parted, len(steps))]
    if once:  # at the levels at which the row does not hang nothing in the ring hangs either, so that it comes to the row's bundle
        comes = (hangs < first[:, None]) & (own.bundle[own.half] < own.bundle[_half(cell, near, steps)][:, None])
        loose = np.where(comes, limits[-1], loose)
    room = np.maximum(loose, both[place]) + np.float32(SLACK)
    angle = _angles(np.stack(rows["vector"].to_list()) @ own.matrix.T).astype(np.float32)[:, own.cell]
    return (angle - own.high.astype(np.float32) <= room) & (own.low.astype(np.float32) - angle <= room)


def _asking(hung: DataFrame, levels: list[float], cells: dict[str, SimpleNamespace], answer, schema: str) -> DataFrame:
    """``answer(rows, bucket, own, needed)`` of all points, some at a time."""
    shared = hung.sparkSession.sparkContext.broadcast(cells)
    steps = np.array(levels)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, group in batch.sort_values("cell").groupby("bucket"):  # few cells at once
                for start in range(0, len(group), ROWS_AT_ONCE):
                    rows, own = group.iloc[start : start + ROWS_AT_ONCE], shared.value[bucket]
                    yield answer(rows, bucket, own, _needed(rows, own, steps, once=True))

    return hung.where("other is null").select("bucket", "node", "vector", "cell", "near").mapInPandas(ask, schema)


def _asked_rings(hung: DataFrame, levels: list[float], cells: dict[str, SimpleNamespace]) -> DataFrame:
    """Which rings each point has to visit."""

    def rings(rows: pd.DataFrame, bucket: str, own: SimpleNamespace, needed: np.ndarray) -> pd.DataFrame:
        numbers = ((own.cell + 1) * RINGS + own.ring).astype(np.int32)
        return pd.DataFrame({"bucket": bucket, "node": rows["node"].to_numpy(), "rings": [numbers[n] for n in needed]})

    return _asking(hung, levels, cells, rings, RINGS_SCHEMA)


def _visits(hung: DataFrame, levels: list[float], cells: dict[str, SimpleNamespace]) -> DataFrame:
    """Which bundles each point has to visit, once per block of the bundle."""

    def visit(rows: pd.DataFrame, bucket: str, own: SimpleNamespace, needed: np.ndarray) -> pd.DataFrame:
        of_ring = own.bundle[own.half]
        order = np.argsort(of_ring, kind="stable")
        bundles, starts = np.unique(of_ring[order], return_index=True)
        row, at = np.nonzero(np.logical_or.reduceat(needed[:, order], starts, axis=1))
        times = own.blocks[bundles[at]]
        row, bundle = row.repeat(times), bundles[at].repeat(times)
        block = np.arange(len(row)) - (np.cumsum(times) - times).repeat(times)
        vector = np.array([v.tobytes() for v in rows["vector"]], object)
        return pd.DataFrame({
            "bucket": bucket, "bundle": bundle, "block": block, "node": rows["node"].to_numpy()[row], "vector": vector[row],
            "cell": rows["cell"].to_numpy()[row], "near": rows["near"].to_numpy()[row],
        })

    return stage(_asking(hung, levels, cells, visit, VISIT_SCHEMA), "visits")


def _packed(rows: DataFrame) -> DataFrame:
    """The same rows with their vectors as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=[v.tobytes() for v in batch["vector"]])

    schema = ", ".join(f"{n} {'binary' if n == 'vector' else t}" for n, t in rows.dtypes)
    return rows.mapInPandas(pack, schema)


def _compare(hung: DataFrame, visits: DataFrame, levels: list[float], cells: dict[str, SimpleNamespace], block: int) -> DataFrame:
    """What every block of a bundle and every block of its visitors add to what the pivots join."""
    spark = hung.sparkSession
    visitors = visits.where("block = 0").groupBy("bucket", "bundle").agg(F.count("*").alias("n")).collect()  # a row a bundle
    turns = [(v["bucket"], v["bundle"], -(-v["n"] // min(block, cells[v["bucket"]].block))) for v in visitors]
    counts = spark.createDataFrame(turns, "bucket string, bundle int, turns int")
    dealt = [
        (bucket, half, int(own.bundle[half]), int(own.blocks[own.bundle[half]])) for bucket, own in cells.items() for half in range(len(own.bundle))
    ]  # two rows a cell: max_anchors cells at most, and one for each bucket without
    of_half = F.broadcast(spark.createDataFrame(dealt, "bucket string, half int, bundle int, blocks int"))
    here = (
        _packed(hung.where("other is null").select("bucket", "node", "vector", "cell", "near"))
        .withColumn("half", F.greatest("cell", F.lit(0)) * 2 + (F.col("near") < levels[-1]).cast("int"))
        .join(of_half, ["bucket", "half"])
        .join(F.broadcast(counts), ["bucket", "bundle"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        .select("bucket", "bundle", "block", "turn", "node", "vector", "cell", "near")
    )
    there = visits.join(F.broadcast(counts), ["bucket", "bundle"]).select(
        "bucket", "bundle", "block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int").alias("turn"),
        "node", "vector", "cell", "near",
    )
    pivots = spark.sparkContext.broadcast({bucket: getattr(own, "joined", None) for bucket, own in cells.items()})

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            vectors = [np.frombuffer(b"".join(side["vector"]), np.float64).reshape(len(side), -1) for side in (left, right)]
            singles = [v.astype(np.float32) for v in vectors]
            nodes = [side["node"].to_numpy(np.int64) for side in (left, right)]
            known = pivots.value[key[0]]
            width = known.shape[1]
            _, alone = np.unique(np.concatenate(nodes), return_inverse=True)
            numbers = []
            for side, own in ((left, alone[: len(left)]), (right, alone[len(left) :])):
                cell, near = np.maximum(side["cell"].to_numpy(np.int64), 0), side["near"].to_numpy()
                of_pivot = lambda i: known[i, cell] if width else own
                numbers.append(np.array([np.where(near >= level, of_pivot(i), width + own) for i, level in enumerate(levels)]))
            for side in (0, 1):  # what is joined comes together
                order = np.argsort(numbers[side][-1], kind="stable")
                numbers[side], nodes[side] = numbers[side][:, order], nodes[side][order]
                vectors[side], singles[side] = vectors[side][order], singles[side][order]
            joined = Joined(*numbers, levels)
            slack = 2.4e-7 * (vectors[0].shape[1] + 8)  # what single precision may be off by, amply

            def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return np.floor(np.einsum("ij,ij->i", vectors[0][i], vectors[1][j]) * 1e9 + 0.5) / 1e9

            tile = np.empty(min(TILE[0], len(left)) * min(TILE[1], len(right)), np.float32)  # new pages for each would cost a quarter more
            for row in range(0, len(left), TILE[0]):
                for column in range(0, len(right), TILE[1]):
                    rows = np.arange(row, min(row + TILE[0], len(left)))
                    columns = np.arange(column, min(column + TILE[1], len(right)))
                    rows, columns = joined.apart(rows, columns)
                    if len(rows) and len(columns):
                        sims = tile[: len(rows) * len(columns)].reshape(len(rows), len(columns))
                        np.matmul(singles[0][rows], singles[1][columns].T, out=sims)
                        found += joined.links(sims, rows, columns, exact, slack)
        i, j, w = (np.array([f[k] for f in found], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
        return pd.DataFrame({"src": nodes[0][i], "dst": nodes[1][j], "w": w}) if found else pd.DataFrame({"src": i, "dst": j, "w": w})

    keys = ["bucket", "bundle", "block", "turn"]
    # The work of a key is not told by its bytes, so the partitions are given: some for each key.
    meetings = sum(n * int(cells[bucket].blocks[bundle]) for bucket, bundle, n in turns)
    dealt_to = min(MOST_PARTITIONS, max(spark.sparkContext.defaultParallelism, 2 * meetings))
    there, here = there.repartition(dealt_to, *keys), here.repartition(dealt_to, *keys)
    return there.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(meet, FOREST_SCHEMA)
