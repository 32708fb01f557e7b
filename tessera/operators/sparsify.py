"""Thinning a patch graph while keeping it connected.

Patch graphs have one node per patch: their dense solves run on the driver,
behind a size check.  Selections per node or per edge are DataFrame operators.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.graph import PropertyGraph
from tessera.operators.spanning import kruskal, spanning_forest
from tessera.session import materialize

MAX_DENSE_NODES = 4_000


def gumbel_top_k(edges: DataFrame, k: int, seed: int = 1, log_weights: bool = False, u=None) -> DataFrame:
    """k edges drawn without replacement, in proportion to their weights.

    All edges if there are no more than k.  ``u`` is a column in (0, 1), by
    default a hash of seed, src and dst.
    """
    u = uniform(seed, F.col("src"), F.col("dst")) if u is None else u
    weight = F.col("weight") if log_weights else F.log("weight")
    drawn = edges.withColumn("_key", weight - F.log(-F.log(u)))
    return drawn.orderBy(F.desc("_key"), "src", "dst").limit(k).drop("_key")


def with_tree(graph: PropertyGraph, scored: DataFrame, target: int, seed: int = 1) -> DataFrame:
    """``src, dst`` in both directions: the maximum spanning forest of ``scored`` and drawn further edges.

    ``scored(src, dst, weight)`` holds both directions; ``target`` is the
    wanted number of directed edges.
    """
    tree = spanning_forest(PropertyGraph(scored, graph.nodes, False), maximise=True).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    tree = materialize(tree, "tree")
    extra = max(0, target // 2 - tree.count())
    rest = scored.where("src < dst and weight > 0").join(tree, ["src", "dst"], "left_anti")
    chosen = tree.unionByName(gumbel_top_k(rest, extra, seed).select("src", "dst")) if extra else tree
    return chosen.unionByName(chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def conductance_weights(graph: PropertyGraph) -> DataFrame:
    """``src, dst, weight`` divided by the smaller strength of the two ends; null where that is 0."""
    strength = graph.strength()
    return (
        graph.weighted_edges.join(strength.select(F.col("id").alias("src"), F.col("strength").alias("s")), "src")
        .join(strength.select(F.col("id").alias("dst"), F.col("strength").alias("t")), "dst")
        .select("src", "dst", F.try_divide(F.col("weight"), F.least("s", "t")).alias("weight"))
    )


def _small_edges(graph: PropertyGraph) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Node ids and edge arrays of a graph whose size was checked."""
    n = graph.num_nodes
    if n > MAX_DENSE_NODES:
        raise ValueError(f"{n} nodes are too many for a dense solve, at most {MAX_DENSE_NODES}")
    ids = [r["id"] for r in graph.nodes.select("id").orderBy("id").collect()]
    at = {v: k for k, v in enumerate(ids)}
    rows = graph.weighted_edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).orderBy("src", "dst").collect()
    u = np.array([at[r["src"]] for r in rows], int)
    v = np.array([at[r["dst"]] for r in rows], int)
    return ids, u, v, np.array([r["weight"] for r in rows], float)


def incidence(graph: PropertyGraph) -> tuple[np.ndarray, np.ndarray]:
    """Signed incidence matrix over all stored edges, and the square roots of their weights."""
    ids, u, v, w = _small_edges(graph)
    b = np.zeros((len(u), len(ids)))
    b[np.arange(len(u)), u] += 1
    b[np.arange(len(u)), v] -= 1
    return b, np.sqrt(w)


def effective_resistance(graph: PropertyGraph) -> DataFrame:
    """``src, dst, resistance`` of every stored edge.

    Both stored directions conduct, so the values are half of those of the
    undirected graph.
    """
    ids, u, v, w = _small_edges(graph)
    n = len(ids)
    laplacian = np.zeros((n, n))
    np.add.at(laplacian, (u, u), w)
    np.add.at(laplacian, (v, v), w)
    np.add.at(laplacian, (u, v), -w)
    np.add.at(laplacian, (v, u), -w)
    inverse = np.linalg.pinv(laplacian, hermitian=True)
    r = inverse[u, u] + inverse[v, v] - 2 * inverse[u, v]
    rows = [(ids[a], ids[b], float(x)) for a, b, x in zip(u, v, r)]
    return graph.edges.sparkSession.createDataFrame(rows, "src long, dst long, resistance double")


def resistance_weights(graph: PropertyGraph) -> DataFrame:
    """Weight times resistance, the resistance alone if unweighted."""
    return graph.weighted_edges.join(effective_resistance(graph), ["src", "dst"]).select(
        "src", "dst", (F.col("weight") * F.col("resistance")).alias("weight")
    )


def _target_edges(graph: PropertyGraph, mean_degree: float) -> int:
    return int(mean_degree * graph.num_nodes / 2) * 2


def resistance_sparsify(graph: PropertyGraph, mean_degree: float, seed: int = 1) -> PropertyGraph:
    """About ``mean_degree`` edges per node, drawn by resistance; original weights are kept."""
    return _sampled(graph, mean_degree, resistance_weights, seed)


def conductance_sparsify(graph: PropertyGraph, mean_degree: float, seed: int = 1) -> PropertyGraph:
    """The same, drawn by conductance weight."""
    return _sampled(graph, mean_degree, conductance_weights, seed)


def _sampled(graph: PropertyGraph, mean_degree: float, score: Callable[[PropertyGraph], DataFrame], seed: int) -> PropertyGraph:
    target = _target_edges(graph, mean_degree)
    if graph.num_edges <= target:
        return graph
    chosen = with_tree(graph, score(graph), target, seed)
    return PropertyGraph(graph.edges.join(chosen, ["src", "dst"], "left_semi").select(*graph.edges.columns), graph.nodes, graph.directed)


def strongest_edges(graph: PropertyGraph, k: int) -> DataFrame:
    """``src, dst, weight, position`` of each node's k strongest edges; ties go to the smaller neighbour."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return graph.weighted_edges.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def neighbour_sparsify(graph: PropertyGraph, k: int, ensure_connected: bool = True) -> PropertyGraph:
    """Edges that both of their ends count among their k strongest, and the maximum spanning forest."""
    kept = strongest_edges(graph, k).select("src", "dst")
    if ensure_connected:
        tree = spanning_forest(graph, maximise=True)
        kept = kept.union(tree.select("u", "v")).union(tree.select("v", "u")).distinct()
    mutual = kept.join(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return PropertyGraph(graph.edges.join(mutual, ["src", "dst"], "left_semi").select(*graph.edges.columns), graph.nodes, graph.directed)


def relaxed_spanning_tree(graph: PropertyGraph, gamma: float = 0.0, maximise: bool = True) -> PropertyGraph:
    """A spanning forest and the edges that nearly match the weakest link of their tree path.

    With d the best incident weight of a node, an edge joins if its weight is
    above the path's minimum less ``gamma (d_u + d_v)`` when maximising, below
    the path's maximum plus it when minimising.
    """
    ids, u, v, w = _small_edges(graph)
    pick = max if maximise else min
    pairs: dict[tuple[int, int], float] = {}
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist()):
        if a != b:
            key = (min(a, b), max(a, b))
            pairs[key] = x if key not in pairs else pick(pairs[key], x)
    tree = kruskal([(a, b, x) for (a, b), x in pairs.items()], maximise)
    near = defaultdict(list)
    for a, b in tree:
        near[a].append((b, pairs[a, b]))
        near[b].append((a, pairs[a, b]))
    best = {}
    for (a, b), x in pairs.items():
        for end in (a, b):
            best[end] = x if end not in best else pick(best[end], x)
    weakest = min if maximise else max
    kept = set(tree)
    for a in {a for a, _ in pairs}:
        bottleneck, queue = {a: math.inf if maximise else -math.inf}, [a]
        for at in queue:
            for to, x in near[at]:
                if to not in bottleneck:
                    bottleneck[to] = weakest(bottleneck[at], x)
                    queue.append(to)
        for (s, t), x in pairs.items():
            if s == a and (s, t) not in tree:
                slack = gamma * (best[s] + best[t])
                if (bottleneck[t] - slack < x) if maximise else (bottleneck[t] + slack > x):
                    kept.add((s, t))
    rows = [(ids[a], ids[b]) for s, t in kept for a, b in ((s, t), (t, s))]
    chosen = graph.edges.sparkSession.createDataFrame(rows, "src long, dst long")
    return PropertyGraph(graph.edges.join(F.broadcast(chosen), ["src", "dst"], "left_semi").select(*graph.edges.columns), graph.nodes, graph.directed)


def multi_range(ranges: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """All integers of the half-open ranges, in a column ``value``; empty ranges give none."""
    return ranges.where(F.col(start) < F.col(stop)).withColumn("value", F.explode(F.sequence(F.col(start), F.col(stop) - 1)))


def hierarchical_sparsify(
    graph: PropertyGraph,
    hierarchy: list[DataFrame],
    mean_degree: float,
    level_degree: float,
    sparsifier: Callable[[PropertyGraph, float], PropertyGraph] = conductance_sparsify,
    seed: int = 1,
) -> PropertyGraph:
    """Sparsify inside the clusters of every level, and then what connects them.

    ``hierarchy`` is a list of ``(node, cluster)`` tables, each clustering the
    clusters of the one before.  On every level the sparsifier works on the
    edges inside clusters of the current coarse graph; kept coarse edges go
    back to fine ones, of which up to ``level_degree`` parallel ones are drawn.
    The input hierarchy is not changed.
    """
    current = graph
    members = graph.nodes.select(F.col("id").alias("node"), F.col("id").alias("cluster"))
    kept: DataFrame | None = None
    for depth in range(len(hierarchy) + 1):
        level = hierarchy[depth] if depth < len(hierarchy) else None
        inside = current
        if level is not None:
            a = level.select(F.col("node").alias("src"), F.col("cluster").alias("ca"))
            b = level.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
            edges = current.edges.join(a, "src").join(b, "dst").where("ca = cb").select(*current.edges.columns)
            inside = PropertyGraph(edges, current.nodes, current.directed)
        thin = sparsifier(inside, mean_degree).edges.select(F.col("src").alias("cs"), F.col("dst").alias("cd")).where("cs < cd")
        fine = (
            graph.edges.where("src < dst")
            .join(members.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), "src")
            .join(members.select(F.col("node").alias("dst"), F.col("cluster").alias("c2")), "dst")
            .withColumn("cs", F.least("c1", "c2"))
            .withColumn("cd", F.greatest("c1", "c2"))
            .join(thin, ["cs", "cd"], "left_semi")
        )
        weight = F.log("weight") if graph.weighted else F.lit(0.0)
        key = weight - F.log(-F.log(uniform(seed + depth, F.col("src"), F.col("dst"))))
        group = Window.partitionBy("cs", "cd").orderBy(F.desc("key"), "src", "dst")
        drawn = fine.withColumn("key", key).withColumn("r", F.row_number().over(group)).where(F.col("r") <= max(1, int(level_degree))).select("src", "dst")
        kept = drawn if kept is None else kept.unionByName(drawn)
        if level is None:
            break
        current = current.quotient(level)
        members = members.join(level.select(F.col("node").alias("cluster"), F.col("cluster").alias("up")), "cluster").select("node", F.col("up").alias("cluster"))
    both = kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return PropertyGraph(graph.edges.join(both, ["src", "dst"], "left_semi").select(*graph.edges.columns), graph.nodes, graph.directed)
