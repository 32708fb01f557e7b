"""Minimum and maximum spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.session import materialize


class UnionFind:
    """Disjoint sets of hashable items, united by size with path halving."""

    def __init__(self):
        self.parent: dict = {}
        self.size: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x, y) -> bool:
        """True if x and y were in different sets."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size.get(x, 1) < self.size.get(y, 1):
            x, y = y, x
        self.parent[y] = x
        self.size[x] = self.size.get(x, 1) + self.size.get(y, 1)
        return True

    def n_sets(self, items) -> int:
        return len({self.find(i) for i in items})


def kruskal(edges: list[tuple[int, int, float]], maximise: bool = False) -> set[tuple[int, int]]:
    """Edges (u < v) of a spanning forest of a patch-sized graph.

    Ties go to the smaller ``(u, v)``; loops are never chosen.
    """
    best: dict[tuple[int, int], float] = {}
    for u, v, w in edges:
        if u != v:
            pair = (min(u, v), max(u, v))
            best[pair] = w if pair not in best else (max if maximise else min)(best[pair], w)
    sets = UnionFind()
    ordered = sorted(best.items(), key=lambda e: (-e[1] if maximise else e[1], e[0]))
    return {pair for pair, _ in ordered if sets.union(*pair)}


KRUSKAL_EDGES = 100_000


def spanning_forest(graph: PropertyGraph, maximise: bool = False, max_rounds: int = 64, driver_edges: int | None = None) -> DataFrame:
    """``u, v, weight`` (u < v) of a minimum or maximum spanning forest, by rounds of Boruvka.

    In each round every component takes its best edge to another one, by
    ``(weight, u, v)``, and components so joined are contracted; the number of
    components at least halves.  The graph is taken as undirected, parallel
    edges count with their best weight, and loops are never chosen.  A graph of
    at most ``driver_edges`` edges (``KRUSKAL_EDGES``), as patch graphs are, is solved on the
    driver, with the same result.
    """
    sign = -1.0 if maximise else 1.0
    spark = graph.edges.sparkSession
    candidates = (
        graph.weighted_edges.where("src <> dst")
        .groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(F.min(F.col("weight") * sign).alias("cost"))
    )
    driver_edges = KRUSKAL_EDGES if driver_edges is None else driver_edges
    few = candidates.limit(driver_edges + 1).collect() if driver_edges > 0 else []
    if driver_edges > 0 and len(few) <= driver_edges:
        cost = {(r["u"], r["v"]): r["cost"] for r in few}
        tree = sorted(kruskal([(u, v, c) for (u, v), c in cost.items()]))
        return spark.createDataFrame([(u, v, sign * cost[u, v]) for u, v in tree], "u long, v long, weight double")
    open_edges = materialize(candidates.select("u", "v", "cost", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest-edges")
    chosen = None
    for _ in range(max_rounds):
        if open_edges.isEmpty():
            break
        sides = open_edges.select("u", "v", "cost", F.explode(F.array("cu", "cv")).alias("c"))
        best = sides.groupBy("c").agg(F.min(F.struct("cost", "u", "v")).alias("e")).select("e.*").distinct()
        best = materialize(best.select("u", "v", "cost"), "forest")
        chosen = best if chosen is None else chosen.unionByName(best)
        joined = open_edges.join(best.select("u", "v"), ["u", "v"], "left_semi").select(F.col("cu").alias("src"), F.col("cv").alias("dst"))
        from tessera.operators.components import component_roots

        roots = materialize(component_roots(PropertyGraph.from_edges(joined)), "contracted")
        open_edges = materialize(
            open_edges.join(roots.select(F.col("id").alias("cu"), F.col("root").alias("ru")), "cu", "left")
            .join(roots.select(F.col("id").alias("cv"), F.col("root").alias("rv")), "cv", "left")
            .select("u", "v", "cost", F.coalesce("ru", "cu").alias("cu"), F.coalesce("rv", "cv").alias("cv"))
            .where("cu <> cv"),
            "forest-edges",
        )
    else:
        if not open_edges.isEmpty():
            raise RuntimeError(f"the forest is not complete after {max_rounds} rounds")
    if chosen is None:
        return spark.createDataFrame([], "u long, v long, weight double")
    return chosen.select("u", "v", (F.col("cost") * sign).alias("weight"))


def spanning_tree_edges(graph: PropertyGraph, maximise: bool = False) -> DataFrame:
    """The graph's edges that lie in the forest, in both stored directions."""
    forest = spanning_forest(graph, maximise)
    both = forest.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(forest.select(F.col("v"), F.col("u")))
    return graph.edges.join(both, ["src", "dst"], "left_semi")
