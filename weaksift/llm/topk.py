"""Exact top-k inner products by ball trees over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.llm.common import stage

K = 5
SCALE = 256
EVERY = 50  # query ids are divisible by it
SAMPLE = 4096  # vectors looked at to choose pivots; any choice gives the same results
PIVOTS = 32
SHARD = 4096  # vectors of a shard
LEAF = 256  # vectors of a leaf of a shard's tree
BLOCK = 4096  # queries that meet a shard at once
ROUNDS = (1, 4)  # pivots that a query asks in the first rounds, best bounds first; the rest in the last
SAFE = 1 << 20  # components up to which float64 products are exact

INDEX = "pivot int, shard string, ids binary, null_ids binary, vectors binary, dim int, reach double"
HITS = "query_id long, query string, vec_id long, score long"


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id (0 if null), no_id, dim, v (whole numbers): vectors without null or non-finite components, scaled and
    rounded down. Null ids are told apart by a column of their own, since a column of numbers with nulls in it would
    reach Python as floating-point numbers."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    rows = table.where(x.isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(x) > 0))
    vec_id = F.col("vec_id").cast("long")
    return rows.select(F.coalesce(vec_id, F.lit(0).cast("long")).alias("vec_id"), vec_id.isNull().alias("no_id"), F.size(x).alias("dim"), v.alias("v"))


def choose_pivots(vectors: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """By dimension, some centers of a bounded sample (``sample`` vectors in hash order, five rounds of k-means)."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "dim"), "vec_id").limit(sample).select("dim", "v").collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        m = np.array([r["v"] for r in rows if r["dim"] == dim])
        centers = m[:: max(1, len(m) // pivots)][:pivots].copy()
        for _ in range(5):
            near = (((m**2).sum(1)[:, None] - 2 * m @ centers.T) + (centers**2).sum(1)).argmin(1)
            for c in range(len(centers)):
                if (near == c).any():
                    centers[c] = m[near == c].mean(0)
        out[dim] = centers
    return out


def _assign(pivots: dict[int, np.ndarray]):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["pivot"] = -1
            for dim, own in frame.groupby("dim"):
                if dim in pivots:
                    m, c = np.stack(own["v"].to_numpy()), pivots[dim]
                    frame.loc[own.index, "pivot"] = ((c**2).sum(1) - 2 * m @ c.T).argmin(1)
            yield frame

    return work


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; float64 where it is exact, else Python's whole numbers within 64 bits."""
    top = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
    if top <= SAFE:
        return (queries @ vectors.T).astype(np.int64)
    a = np.array([[int(x) for x in row] for row in queries], dtype=object)
    b = np.array([[int(x) for x in row] for row in vectors], dtype=object)
    return np.clip(a @ b.T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class BallTree:
    """Halves the vectors along their widest direction down to leaves; every node has a center and a radius."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.vectors[rows]
        center = own.mean(0)
        radius = float(np.sqrt(((own - center) ** 2).sum(1).max()))
        here = len(self.nodes)
        self.nodes.append((center, radius, rows, -1, -1))
        if len(rows) > LEAF and radius > 0:
            a = own[((own - center) ** 2).sum(1).argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            by = np.argsort(own @ (b - a), kind="stable")
            half = len(rows) // 2
            left, right = self._build(rows[by[:half]]), self._build(rows[by[half:]])
            self.nodes[here] = (center, radius, None, left, right)
        return here

    def bounds(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        center, radius, *_ = self.nodes[node]
        return upper(queries @ center, norms, radius, float(np.sqrt((center**2).sum())))


def upper(dots: np.ndarray, norms: np.ndarray, radius, size) -> np.ndarray:
    """The largest inner product with a ball, with room for rounding."""
    return dots + norms * radius + 1e-9 * norms * (size + radius) + 1.0


class Best:
    """The k best hits of each query so far, ties to the smaller id (null ids last)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.nulls: list[np.ndarray] = [np.empty(0, bool)] * n
        self.kth = np.full(n, -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, z = np.append(self.scores[q], scores), np.append(self.ids[q], ids), np.append(self.nulls[q], nulls)
        top = np.lexsort((i, z, -s))[: self.k]
        self.scores[q], self.ids[q], self.nulls[q] = s[top], i[top], z[top]
        if len(top) == self.k:
            self.kth[q] = max(self.kth[q], s[top[-1]])


def search(tree: BallTree, ids: np.ndarray, nulls: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int = K) -> Best:
    """Branch and bound for a block of queries together: the nearer child first, and only queries whose bound at a node
    reaches the k-th score they already have go into it."""
    best = Best(len(queries), k)
    best.kth = kth.astype(float).copy()
    norms = np.sqrt((queries**2).sum(1))
    stack = [(0, np.arange(len(queries)))]
    while stack:
        node, active = stack.pop()
        active = active[tree.bounds(node, queries[active], norms[active]) >= best.kth[active]]
        if not len(active):
            continue
        _, _, rows, left, right = tree.nodes[node]
        if rows is None:
            both = [(tree.bounds(c, queries[active], norms[active]).mean(), c) for c in (left, right)]
            stack += [(c, active) for _, c in sorted(both)]
            continue
        scores = exact_scores(queries[active], tree.vectors[rows])
        for q, own in zip(active, scores):
            other = nulls[rows] | (ids[rows] != query_ids[q])
            good = np.flatnonzero(other & (own >= best.kth[q]))
            if len(good) > k:
                good = good[own[good] >= np.partition(own[good], -k)[-k]]
            if len(good):
                best.offer(int(q), own[good], ids[rows][good], nulls[rows][good])
    return best


def hit_frame(best: Best, query_ids: np.ndarray, keys: list[str]) -> pd.DataFrame:
    n = [len(s) for s in best.scores]
    ids = pd.array(np.concatenate([*best.ids, np.empty(0, np.int64)]).astype(np.int64), dtype="Int64")
    ids[np.concatenate([*best.nulls, np.empty(0, bool)]).astype(bool)] = pd.NA
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, n),
            "query": np.repeat(np.array(keys, dtype=object), n),
            "vec_id": ids,
            "score": np.concatenate([*best.scores, np.empty(0, np.int64)]).astype(np.int64),
        }
    )


def _shards(pivots: dict[int, np.ndarray]):
    """Sorted vectors as packed shards: rows of one dimension and pivot, ``SHARD`` at most."""
    from pyspark import TaskContext

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def pack() -> pd.DataFrame:
            nonlocal made
            own = pd.concat(held)
            held.clear()
            dim, pivot = int(own["dim"].iloc[0]), int(own["pivot"].iloc[0])
            m = np.stack(own["v"].to_numpy())
            center = pivots[dim][pivot] if pivot >= 0 else np.zeros(dim)
            reach = float(np.sqrt(((m - center) ** 2).sum(1).max()))
            made += 1
            nulls, ids = own["no_id"].to_numpy(bool), own["vec_id"].to_numpy(np.int64)
            return pd.DataFrame([(pivot, f"{part}.{made}", ids.tobytes(), nulls.tobytes(), m.tobytes(), dim, reach)], columns=INDEX_COLUMNS)

        for frame in frames:
            for _, own in frame.groupby((frame[["dim", "pivot"]] != frame[["dim", "pivot"]].shift()).any(axis=1).cumsum()):
                while len(own):
                    if held and (held[0]["dim"].iloc[0], held[0]["pivot"].iloc[0]) != (own["dim"].iloc[0], own["pivot"].iloc[0]):
                        yield pack()
                    room = SHARD - sum(map(len, held))
                    held.append(own.iloc[:room])
                    own = own.iloc[room:]
                    if sum(map(len, held)) >= SHARD:
                        yield pack()
        if held:
            yield pack()

    return work


INDEX_COLUMNS = [f.split()[0] for f in INDEX.split(", ")]


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null_ids"], bool), np.frombuffer(row["vectors"]).reshape(-1, row["dim"])


def _seed(every: int, k: int):
    """The queries of each shard with the best hits in it, which give each query a first k-th score."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                ids, nulls, m = _unpack(row)
                own = np.flatnonzero(~nulls & (ids % every == 0))
                if not len(own):
                    continue
                tree = BallTree(m)
                best = search(tree, ids, nulls, ids[own], m[own], np.full(len(own), -np.inf), k)
                keys = [f"{row['shard']}:{i}" for i in own]
                yield pd.DataFrame(
                    {
                        "query_id": ids[own],
                        "query": keys,
                        "dim": row["dim"],
                        "home": row["shard"],
                        "v": list(m[own]),
                        "kth": best.kth,
                        "ids": [[None if z else int(x) for x, z in zip(i, z_)] for i, z_ in zip(best.ids, best.nulls)],
                        "scores": list(best.scores),
                    }
                )

    return work


SEEDS = "query_id long, query string, dim int, home string, v array<double>, kth double, ids array<long>, scores array<long>"


def _route(pivots: dict[int, np.ndarray], reach: dict[tuple[int, int], float]):
    """The pivots whose ball may hold a hit at least as good as a query's k-th score, best bounds first."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            to = [[] for _ in range(len(frame))]
            for dim in frame["dim"].unique():
                rows = np.flatnonzero(frame["dim"] == dim)
                q = np.stack(frame["v"].iloc[rows].to_numpy())
                norms = np.sqrt((q**2).sum(1))
                own = [(p, r) for (d, p), r in reach.items() if d == dim]
                centers = [pivots[dim][p] if p >= 0 else np.zeros(dim) for p, _ in own]
                bounds = np.array([upper(q @ c, norms, r, float(np.sqrt((c**2).sum()))) for c, (_, r) in zip(centers, own)])
                open_ = bounds >= frame["kth"].iloc[rows].to_numpy()
                for i, order in enumerate(np.argsort(-bounds, axis=0, kind="stable").T):
                    to[rows[i]] = [(own[j][0], float(bounds[j, i])) for j in order if open_[j, i]]
            frame["pivots"] = to
            yield frame[["query_id", "query", "dim", "home", "v", "kth", "pivots"]]

    return work


def _meet(k: int):
    def work(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in shards.to_dict("records"):
            own = queries[queries["home"] != row["shard"]]
            if not len(own):
                continue
            ids, nulls, m = _unpack(row)
            tree = BallTree(m)
            for lo in range(0, len(own), 512):
                some = own.iloc[lo : lo + 512]
                query_ids = some["query_id"].to_numpy(np.int64)
                best = search(tree, ids, nulls, query_ids, np.stack(some["v"].to_numpy()), some["kth"].to_numpy(), k)
                found.append(hit_frame(best, query_ids, list(some["query"])))
        return pd.concat(found) if found else pd.DataFrame(columns=["query_id", "query", "vec_id", "score"])

    return work


def _kth(seeds: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query, better: the k-th score of each query that has k hits, in its own shard and those met so far."""
    hits = seeds.select("query", F.explode("scores").alias("score")).unionByName(found.select("query", "score"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
    return hits.withColumn("_place", place).where(F.col("_place") == k).select("query", F.col("score").cast("double").alias("better"))


def top_k(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose vec_id is divisible by ``every``.

    Vectors are sorted by the nearest of a few pivots into shards of bounded size, each with a ball tree. A query first
    searches the shard it lies in; its k-th score then decides which pivots' balls can hold better rows, and goes along
    into the trees of their shards. The pivots with the best bounds come first, in rounds; after each, a query's k-th score
    so far is shared with all shards to come. A block of queries and a shard that one of them asks meet in one task. Exact
    whatever the pivots are. Vectors that are null, empty or hold null or non-finite components take no part; only vectors of equal
    dimension are compared; a row is its own and no hit for another row of the same id; a null vec_id is a candidate,
    after all others at ties; repeated rows count as rows; an empty table gives an empty result; other columns are
    ignored.
    """
    vectors = stage(whole_vectors(table), "vectors")
    pivots = choose_pivots(vectors)
    near = vectors.mapInPandas(_assign(pivots), "vec_id long, no_id boolean, dim int, v array<double>, pivot int")
    keys = ["dim", "pivot", F.xxhash64("vec_id", "v")]
    index = stage(near.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_shards(pivots), INDEX), "index")
    seeds = stage(index.mapInPandas(_seed(every, k), SEEDS), "seeds")
    balls = index.groupBy("dim", "pivot").agg(F.max("reach").alias("reach")).collect()  # pivots and dimensions at most
    reach = {(b["dim"], b["pivot"]): b["reach"] for b in balls}
    blocks = max(1, -(-seeds.count() // BLOCK))
    routed = seeds.mapInPandas(_route(pivots, reach), SEEDS.split(", ids")[0] + ", pivots array<struct<pivot:int,bound:double>>")
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    by_pivot = stage(routed.select("*", F.posexplode("pivots").alias("turn", "to"), block.alias("block")).select("*", "to.*").drop("pivots", "to"), "routed")
    shards = index.select("dim", "pivot", F.col("shard").alias("to"))
    found = None
    for first, last in zip((0, *np.cumsum(ROUNDS).tolist()), (*np.cumsum(ROUNDS).tolist(), None)):
        turn = by_pivot.where((F.col("turn") >= first) & (F.lit(True) if last is None else F.col("turn") < last))
        if found is not None:  # what earlier rounds found raises a query's k-th score for all shards to come
            turn = turn.join(_kth(seeds, found, k), "query", "left").withColumn("kth", F.greatest("kth", F.coalesce("better", "kth"))).where("bound >= kth")
        asked = stage(turn.join(shards, ["dim", "pivot"]).select("query_id", "query", "home", "v", "kth", "block", "to").where("home <> to"), "asked")
        wanted = asked.select(F.col("to").alias("shard"), F.col("block").alias("part")).distinct()
        offered = index.join(wanted, "shard")
        hits = stage(asked.groupBy("to", "block").cogroup(offered.groupBy("shard", "part")).applyInPandas(_meet(k), HITS), "hits")
        found = hits if found is None else found.unionByName(hits)
    own = seeds.select("query_id", "query", F.explode(F.arrays_zip("ids", "scores")).alias("h"))
    hits = found.unionByName(own.select("query_id", "query", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score")))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % {EVERY} = 0 and q.vec_id is distinct from c.vec_id and len(q.v) = len(c.v)),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id nulls last)::int as rank from scored)
select query_id, rank, vec_id, score from placed where rank <= {K}
"""
