"""Components and maximum spanning forests of graphs that are tables of edges.

A maximum spanning forest keeps, of every cycle, all edges but a lightest one. So for any threshold its edges at or
above it join the same nodes as all edges at or above it do: one forest answers every threshold.

* ``components``: alternating large and small stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014).
* ``spanning_forest``: Borůvka's rounds. Every component takes the heaviest edge that leaves it, what these edges join
  becomes one component, and of the edges between two components the heaviest stays; components at least halve a round.
* ``cut``: the components at several thresholds, from the highest down: each takes up the components of the one before.

Graphs of few edges are one small task each, since rounds of joins would cost more than they spread; so is what some rounds
have left of a larger graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaksift.plans.stages import stage

FEW_EDGES = 500_000  # a graph this small fits one task with ease
MAX_ROUNDS = 100

LABEL_SCHEMA = "t int, node long, component long"
FOREST_SCHEMA = "src long, dst long, w double"


# -- components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, few_edges: int = FEW_EDGES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Components of an undirected graph ``t, src, dst`` (one graph per ``t``): every node that
    has an edge, with the least node of its component. A graph of at most ``few_edges`` edges is
    one small task per ``t``; else rounds of large-star and small-star contraction run until the
    edges no longer change, each round staged."""
    edges = stage(edges.distinct(), "edges")
    if edges.count() <= few_edges:
        pairs = edges.select("t", F.col("src").alias("node"), F.col("dst").alias("anchor"))
        return pairs.groupBy("t").applyInPandas(_merge, LABEL_SCHEMA)
    nodes = edges.select("t", F.explode(F.array("src", "dst")).alias("node")).distinct()
    stars = stage(
        edges.where("src <> dst")
        .select("t", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "stars",
    )
    state = _fingerprint(stars)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        stars = stage(_small_star(_large_star(stars)), "stars")
        previous, state = state, _fingerprint(stars)
        if state == previous:
            break
    else:
        raise RuntimeError("components did not converge")
    return (
        nodes.join(stars.withColumnRenamed("src", "node"), ["t", "node"], "left")
        .select("t", "node", F.coalesce("dst", "node").alias("component"))
    )


def _merge(links: pd.DataFrame) -> pd.DataFrame:
    """Components of one small graph: least labels spread along the links until stable."""
    ids, ends = np.unique(links[["node", "anchor"]].to_numpy(np.int64), return_inverse=True)
    left, right = ends.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return pd.DataFrame({"t": links["t"].iloc[0], "node": ids, "component": ids[label]})


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("t", "src", "dst")), F.lit(0))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select("t", F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("t", "src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return (
        both.where("dst > src").join(least, ["t", "src"])
        .select("t", F.col("dst").alias("src"), F.col("least").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select("t", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("t", "src").agg(F.min("dst").alias("least"))
    neighbours = down.join(least, ["t", "src"]).select("t", F.col("dst").alias("src"), F.col("least").alias("dst"))
    itself = least.select("t", "src", F.col("least").alias("dst"))
    return neighbours.unionByName(itself).where("src <> dst").distinct()


# -- spanning forests ---------------------------------------------------------------------------------


class Sets:
    """Disjoint sets of small whole numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart. The smaller number stays, so a set is named by its least."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _heaviest_first(edges: pd.DataFrame, joins: tuple[str, str] = ("src", "dst")) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Nodes, the ends ``joins`` as numbers of nodes, and the edges, heaviest first."""
    edges = edges.sort_values(["w", "src", "dst"], ascending=[False, True, True], ignore_index=True)
    nodes, ends = np.unique(edges[list(joins)].to_numpy(np.int64), return_inverse=True)
    return nodes, ends.reshape(-1, 2), edges


def small_forest(edges: pd.DataFrame, *, joins: tuple[str, str] = ("src", "dst")) -> pd.DataFrame:
    """Kruskal's forest of one small graph ``src, dst, w``, whose edges join the nodes ``joins``."""
    nodes, ends, edges = _heaviest_first(edges, joins)
    sets = Sets(len(nodes))
    return edges[[sets.join(a, b) for a, b in ends.tolist()]]


def _gathered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def spanning_forest(edges: DataFrame, few_edges: int = FEW_EDGES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """A maximum spanning forest of ``src, dst, w``: its edges, staged. Equal weights are told apart by the ends, so
    the forest is the same on every run."""
    own = F.struct("w", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    distinct = edges.where("src <> dst").select(own.alias("e")).groupBy("e.src", "e.dst").agg(F.max("e.w").alias("w"))
    edges = stage(distinct, "edges").select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _gathered(batches)
        if rows is not None:
            yield small_forest(rows, joins=("a", "b"))[["src", "dst", "w"]]

    taken = []
    for _ in range(max_rounds):
        left = edges.count()
        if left <= few_edges:  # what the rounds have left, or all edges, in one task
            if left:
                taken.append(edges.repartition(1).mapInPandas(whole, FOREST_SCHEMA))
            break
        edge = F.struct("w", "src", "dst", "a", "b")
        leaving = edges.select(F.explode(F.array("a", "b")).alias("c"), edge.alias("edge"))
        chosen = stage(leaving.groupBy("c").agg(F.max("edge").alias("edge")).select("edge.*").distinct(), "chosen")
        taken.append(chosen.select("src", "dst", "w"))
        joined = components(chosen.select(F.lit(0).alias("t"), F.col("a").alias("src"), F.col("b").alias("dst")), few_edges)
        roots = stage(joined.select(F.col("node"), F.col("component")), "roots")
        for end in ("a", "b"):
            to = roots.select(F.col("node").alias(end), F.col("component").alias("_to"))
            edges = edges.join(to, end).drop(end).withColumnRenamed("_to", end)
        apart = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("w", "src", "dst").alias("e"))
        edges = stage(apart.groupBy("a", "b").agg(F.max("e").alias("e")).select("e.src", "e.dst", "e.w", "a", "b"), "between")
    else:
        raise RuntimeError("the forest did not converge")
    forest = taken[0] if taken else edges.select("src", "dst", "w")
    for more in taken[1:]:
        forest = forest.unionByName(more)
    return stage(forest, "forest")


def cut(forest: DataFrame, thresholds: list[float], few_edges: int = FEW_EDGES) -> DataFrame:
    """``t`` (position in ``thresholds``), ``node``, ``component`` (its least node) for every node of the forest: the
    components that its edges at or above each threshold make. ``forest`` is read a few times and should be a stage."""
    order = sorted(range(len(thresholds)), key=lambda t: -thresholds[t])
    if forest.count() <= few_edges:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = _gathered(batches)
            if rows is None:
                return
            nodes, ends, rows = _heaviest_first(rows)
            weights, sets, at = rows["w"].to_numpy(), Sets(len(nodes)), 0
            for t in order:
                until = int(np.searchsorted(-weights, -thresholds[t], side="right"))
                for a, b in ends[at:until].tolist():
                    sets.join(a, b)
                at = until
                least = np.fromiter(map(sets.find, range(len(nodes))), np.int64, len(nodes))
                yield pd.DataFrame({"t": t, "node": nodes, "component": nodes[least]})

        return forest.repartition(1).mapInPandas(whole, LABEL_SCHEMA)  # few_edges rows at most
    labels = forest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node"))
    above, parts = float("inf"), []
    for t in order:
        more = forest.where((F.col("w") >= thresholds[t]) & (F.col("w") < above)).select("src", "dst")
        for end in ("src", "dst"):
            to = labels.select(F.col("node").alias(end), F.col("component").alias("_to"))
            more = more.join(to, end).drop(end).withColumnRenamed("_to", end)
        roots = components(more.select(F.lit(0).alias("t"), "src", "dst"), few_edges)
        root = roots.select(F.col("node").alias("component"), F.col("component").alias("_root"))
        labels = stage(labels.join(root, "component", "left").select("node", F.coalesce("_root", "component").alias("component")), "labels")
        parts.append(labels.select(F.lit(t).alias("t"), "node", "component"))
        above = thresholds[t]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
