"""Overlapping patches from a graph or from points."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.graph import PropertyGraph
from tessera.operators.clustering import compose_hierarchy, merge_small_clusters
from tessera.operators.components import connected_components
from tessera.operators.spanning import UnionFind
from tessera.operators.sparsify import MAX_DENSE_NODES, conductance_sparsify, neighbour_sparsify, relaxed_spanning_tree, resistance_sparsify
from tessera.operators.synthetic import farthest_first
from tessera.session import materialize


def overlap_seeds(graph: PropertyGraph, partition: DataFrame, patch_edges: DataFrame) -> DataFrame:
    """``i, j, node``: nodes of part i that have an edge to part j, for the directed patch edges (i, j)."""
    a = partition.select(F.col("node").alias("src"), F.col("cluster").alias("i"))
    b = partition.select(F.col("node").alias("dst"), F.col("cluster").alias("j"))
    return (
        graph.edges.join(a, "src")
        .join(b, "dst")
        .where("i <> j")
        .select("i", "j", F.col("src").alias("node"))
        .distinct()
        .join(patch_edges.select("i", "j"), ["i", "j"], "left_semi")
    )


def expand_overlaps(
    graph: PropertyGraph, partition: DataFrame, patch_edges: DataFrame, min_overlap: int, target_overlap: int, seed: int = 1
) -> DataFrame:
    """``i, j, node``: for each patch edge (i, j) the nodes of part i that patch j gets as well.

    The nodes next to part j come first; if they are fewer than
    ``min_overlap``, the set grows breadth-first inside part i until it holds
    as many.  What exceeds ``target_overlap`` is left out of the last step in
    hash order.  A search that dies out goes on from up to ten remaining nodes
    in hash order.  Parts are expanded independently, one group each.
    Raises if a part has fewer than ``min_overlap`` nodes.
    """
    parts = partition.select(F.col("cluster").alias("i"), "node")
    small = parts.join(patch_edges.select("i").distinct(), "i", "left_semi").groupBy("i").count().where(F.col("count") < min_overlap)
    if not small.isEmpty():
        raise ValueError("Minimum overlap > number of nodes")
    a = partition.select(F.col("node").alias("src"), F.col("cluster").alias("i"))
    b = partition.select(F.col("node").alias("dst"), F.col("cluster").alias("i2"))
    inner = graph.edges.join(a, "src").join(b, "dst").where("i = i2").select("i", "src", "dst")
    empty = F.lit(None).cast("long")
    rows = (
        inner.select("i", F.lit(0).alias("kind"), empty.alias("j"), F.col("src").alias("a"), F.col("dst").alias("b"))
        .unionByName(parts.select("i", F.lit(1).alias("kind"), empty.alias("j"), F.col("node").alias("a"), empty.alias("b")))
        .unionByName(overlap_seeds(graph, partition, patch_edges).select("i", F.lit(2).alias("kind"), "j", F.col("node").alias("a"), empty.alias("b")))
        .unionByName(patch_edges.select("i", F.lit(3).alias("kind"), "j", empty.alias("a"), empty.alias("b")))
    )
    return rows.groupBy("i").applyInPandas(_expansion_kernel(min_overlap, target_overlap, seed), "i long, j long, node long")


def _expansion_kernel(least: int, target: int, seed: int):
    def order(nodes: np.ndarray, i: int, j: int) -> np.ndarray:
        # A mixing hash of (seed, i, j, node): a fixed order of the nodes that differs by patch edge.
        mask = (1 << 64) - 1
        salt = ((seed * 1_000_003 + i) * 1_000_003 + j) & mask
        keys = [((int(x) ^ salt) * 0x9E3779B97F4A7C15) & mask for x in nodes]
        keys = [(k ^ (k >> 29)) * 0xBF58476D1CE4E5B9 & mask for k in keys]
        return nodes[np.argsort(np.array(keys, np.uint64), kind="stable")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["i"].iloc[0])
        nodes = np.sort(rows.loc[rows["kind"] == 1, "a"].to_numpy(np.int64))
        edges = rows[rows["kind"] == 0]
        near: dict[int, set[int]] = {}
        for s, t in zip(edges["a"].astype(np.int64), edges["b"].astype(np.int64)):
            near.setdefault(int(s), set()).add(int(t))
        out_j, out_node = [], []
        seeds = {int(j): set(g["a"].astype(np.int64).tolist()) for j, g in rows[rows["kind"] == 2].groupby("j")}
        for j in sorted(int(x) for x in rows.loc[rows["kind"] == 3, "j"].unique()):
            chosen: list[int] = []
            taken: set[int] = set()
            frontier = seeds.get(j, set())
            while True:
                fresh = np.array(sorted(frontier - taken), np.int64)
                if not len(fresh):
                    rest = np.array([x for x in nodes.tolist() if x not in taken], np.int64)
                    if not len(rest):
                        raise RuntimeError("Could not reach minimum overlap.")
                    fresh = order(rest, i, j)[:10]
                if len(chosen) + len(fresh) > target:
                    fresh = order(fresh, i, j)[: max(0, target - len(chosen))]
                chosen += fresh.tolist()
                taken |= set(fresh.tolist())
                if len(chosen) >= least:
                    break
                frontier = {t for s in fresh.tolist() for t in near.get(s, ())}
            out_j += [j] * len(chosen)
            out_node += chosen
        return pd.DataFrame({"i": np.full(len(out_j), i, np.int64), "j": np.array(out_j, np.int64), "node": np.array(out_node, np.int64)})

    return run


def overlapping_patches(graph: PropertyGraph, partition: DataFrame, patch_edges: DataFrame, min_overlap: int, target_overlap: int, seed: int = 1) -> DataFrame:
    """``patch_id, node``: the parts and what they get from their neighbours.

    Each side of a patch edge gives half, so that the pair shares at least
    ``min_overlap`` nodes.
    """
    if target_overlap < min_overlap:
        raise ValueError("target_overlap is below min_overlap")
    given = expand_overlaps(graph, partition, patch_edges, math.ceil(min_overlap / 2), max(math.ceil(min_overlap / 2), target_overlap // 2), seed)
    own = partition.select(F.col("cluster").cast("int").alias("patch_id"), "node")
    return own.unionByName(given.select(F.col("j").cast("int").alias("patch_id"), "node")).distinct()


def _connected(quotient: PropertyGraph) -> PropertyGraph:
    """The patch graph with its components joined by edges of weight 1 between their smallest clusters."""
    if quotient.num_nodes <= MAX_DENSE_NODES:
        sets = UnionFind()
        ids = [r["id"] for r in quotient.nodes.select("id").distinct().collect()]
        for r in quotient.edges.select("src", "dst").collect():
            sets.union(r["src"], r["dst"])
        members: dict[int, list[int]] = {}
        for i in ids:
            members.setdefault(sets.find(i), []).append(i)
        names = [min(m) for m in sorted(members.values(), key=lambda m: (-len(m), min(m)))]
    else:
        roots = connected_components(quotient).select("component", "root").distinct().orderBy("component")
        names = [r["root"] for r in roots.collect()]
    if len(names) < 2:
        return quotient
    rows = [(a, b, 1.0) for x, y in zip(names, names[1:]) for a, b in ((x, y), (y, x))]
    extra = quotient.edges.sparkSession.createDataFrame(rows, "src long, dst long, weight double")
    return PropertyGraph(quotient.edges.unionByName(extra), quotient.nodes, quotient.directed)


def create_patch_data(
    graph: PropertyGraph,
    partition: DataFrame | list[DataFrame],
    min_overlap: int,
    target_overlap: int,
    min_patch_size: int | None = None,
    sparsify: str = "resistance",
    mean_degree: float = 4.0,
    gamma: float = 0.0,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``(patches(patch_id, node), patch_edges(i, j, weight))`` of an undirected graph.

    Small clusters are merged, the graph of clusters is connected and thinned
    by ``resistance``, ``rmst``, ``sample``, ``neighbors`` or ``none``, and the
    parts are extended along its edges.  A hierarchy counts as the partition of
    its last level.
    """
    methods: dict[str, Callable[[PropertyGraph], PropertyGraph]] = {
        "resistance": lambda g: resistance_sparsify(g, mean_degree, seed),
        "rmst": lambda g: relaxed_spanning_tree(g, gamma),
        "sample": lambda g: conductance_sparsify(g, mean_degree, seed),
        "neighbors": lambda g: neighbour_sparsify(g, max(1, round(mean_degree))),
        "none": lambda g: g,
    }
    if sparsify not in methods:
        raise ValueError(f"unknown sparsification {sparsify}, available: {', '.join(methods)}")
    if isinstance(partition, list):
        partition = compose_hierarchy(partition)
    least = max(min_overlap, 1) if min_patch_size is None else min_patch_size
    merged = materialize(merge_small_clusters(graph, partition, least), "merged")
    quotient = graph.quotient(merged)
    quotient = _connected(PropertyGraph(materialize(quotient.edges, "patch-graph"), materialize(quotient.nodes, "patch-nodes"), False))
    thin = methods[sparsify](quotient)
    patch_edges = materialize(thin.weighted_edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight"), "patch-edges")
    patches = materialize(overlapping_patches(graph, merged, patch_edges, min_overlap, target_overlap, seed), "patches")
    return patches, patch_edges


def create_patch_graph(graph: PropertyGraph, cluster: Callable[[PropertyGraph, int], DataFrame], k: int, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Cluster and then :func:`create_patch_data`."""
    return create_patch_data(graph, cluster(graph, k), **kwargs)


def patch_subgraphs(graph: PropertyGraph, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges(patch_id, src, dst[, weight]), nodes(patch_id, id, ...))`` of the subgraph in every patch."""
    a = patches.select("patch_id", F.col("node").alias("src"))
    b = patches.select(F.col("patch_id").alias("other"), F.col("node").alias("dst"))
    edges = graph.edges.join(a, "src").join(b, "dst").where("patch_id = other").select("patch_id", *graph.edges.columns)
    nodes = patches.select("patch_id", F.col("node").alias("id")).join(graph.nodes, "id").select("patch_id", *graph.nodes.columns)
    return edges, nodes


def rolling_window_graph(spark, n: int, window: int | list[int]) -> DataFrame:
    """``i, j`` for patches in a row: neighbours at the given offsets on both sides.

    A number w stands for the offsets 1 .. w-1.
    """
    offsets = sorted({abs(int(w)) for w in (range(1, window) if isinstance(window, int) else window)} - {0})
    if not offsets:
        return spark.createDataFrame([], "i long, j long")
    steps = F.array(*[F.lit(s).cast("long") for o in offsets for s in (o, -o)])
    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(steps).alias("o"))
    return pairs.select("i", (F.col("i") + F.col("o")).alias("j")).where(f"j >= 0 and j < {n}")


def voronoi_patches(
    points: DataFrame, dim: int, k: int, epsilon: float, min_overlap: int, min_size: int = 1, min_degree: int = 1, seed: int = 1, max_rounds: int = 64
) -> DataFrame:
    """``patch_id, node``: points by their nearest centres, with overlaps.

    Centres are a farthest-first sample refined by k-means.  A point belongs to
    every centre within ``epsilon`` times the distance of its nearest one
    (epsilon >= 1).  A patch that has fewer than ``min_size`` points, or shares
    ``min_overlap`` of them with fewer than ``min_degree`` others, is extended
    by its next closest points in doubling steps; components are then connected
    through their closest centres, which share points up to ``min_overlap``.
    """
    if epsilon < 1:
        raise ValueError("epsilon must be at least 1")
    centres = kmeans_centres(points, dim, k, seed)
    distances = materialize(_to_centres(points, centres, dim), "distances")
    nearest = distances.groupBy("node").agg(F.min("d").alias("least"))
    count = distances.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = materialize(
        distances.join(nearest, "node").withColumn("ratio", F.when(F.col("least") > 0, F.col("d") / F.col("least")).otherwise(F.when(F.col("d") > 0, float("inf")).otherwise(1.0))),
        "ratios",
    )
    patches = ranked.where(F.col("ratio") <= epsilon).select("patch_id", "node")
    patches = materialize(patches, "voronoi")
    k = len(centres)
    for _ in range(max_rounds):
        sizes = {r["patch_id"]: r["count"] for r in patches.groupBy("patch_id").count().collect()}
        shared = _overlap_sizes(patches)
        degree = {p: sum(1 for (a, b), n in shared.items() if p in (a, b) and n >= min_overlap) for p in range(k)}
        total = points.count()
        poor = [p for p in range(k) if (sizes.get(p, 0) < min(min_size, total)) or (degree[p] < min(min_degree, k - 1) and sizes.get(p, 0) < total)]
        if not poor:
            break
        want = points.sparkSession.createDataFrame([(p, max(min_overlap, sizes.get(p, 0) // 4, 1)) for p in poor], "patch_id int, more long")
        missing = distances.join(F.broadcast(want), "patch_id").join(patches, ["patch_id", "node"], "left_anti")
        order = Window.partitionBy("patch_id").orderBy("d", "node")
        added = missing.withColumn("r", F.row_number().over(order)).where("r <= more").select("patch_id", "node")
        patches = materialize(patches.unionByName(added), "voronoi")
    else:
        raise RuntimeError(f"patches are still too small or too little connected after {max_rounds} rounds")
    return _connect_by_centres(patches, distances, centres, min_overlap)


def _overlap_sizes(patches: DataFrame) -> dict[tuple[int, int], int]:
    a = patches.select(F.col("patch_id").alias("i"), "node")
    b = patches.select(F.col("patch_id").alias("j"), "node")
    return {(r["i"], r["j"]): r["count"] for r in a.join(b, "node").where("i < j").groupBy("i", "j").count().collect()}


def _connect_by_centres(patches: DataFrame, distances: DataFrame, centres: np.ndarray, min_overlap: int) -> DataFrame:
    k = len(centres)
    while True:
        sets = UnionFind()
        for (a, b), n in _overlap_sizes(patches).items():
            if n >= min_overlap:
                sets.union(a, b)
        if sets.n_sets(range(k)) < 2:
            return patches
        gap = ((centres[:, None] - centres[None]) ** 2).sum(2)
        best = min((gap[a, b], a, b) for a in range(k) for b in range(a + 1, k) if sets.find(a) != sets.find(b))
        a, b = int(best[1]), int(best[2])
        both = distances.where(F.col("patch_id").isin(a, b)).groupBy("node").agg(F.sum("d").alias("d")).orderBy("d", "node").limit(min_overlap)
        added = both.select("node", F.explode(F.array(F.lit(a), F.lit(b))).alias("patch_id")).select("patch_id", "node")
        patches = materialize(patches.unionByName(added).distinct(), "voronoi")


def _to_centres(points: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """``patch_id, node, d`` for every point and centre; the centres are a literal of k rows."""
    rows = F.array(*[F.struct(F.lit(p).alias("patch_id"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for p, c in enumerate(centres)])
    each = points.select("node", "coords", F.explode(rows).alias("e"))
    square = sum((F.pow(F.get("coords", F.lit(k)) - F.get("e.c", F.lit(k)), 2) for k in range(dim)), F.lit(0.0))
    return each.select(F.col("e.patch_id").alias("patch_id"), "node", F.sqrt(square).alias("d"))


def kmeans_centres(points: DataFrame, dim: int, k: int, seed: int = 1, rounds: int = 10, sample_rows: int = 20_000) -> np.ndarray:
    """k-means over all points, started from a farthest-first choice in a bounded sample."""
    u = uniform(seed, F.col("node"))
    share = min(1.0, 1.5 * sample_rows / max(1, points.count()))
    sample = points.where(u <= share).orderBy(u, "node").limit(sample_rows).select("coords").collect()
    x = np.array([r["coords"] for r in sample], float).reshape(-1, dim)
    centres = x[farthest_first(x, min(k, len(x)), seed)]
    for _ in range(rounds):
        d = _to_centres(points, centres, dim)
        own = d.groupBy("node").agg(F.min(F.struct("d", "patch_id")).alias("b")).select("node", F.col("b.patch_id").alias("patch_id"))
        means = points.join(own, "node").groupBy("patch_id").agg(*[F.avg(F.get("coords", F.lit(c))).alias(f"c{c}") for c in range(dim)]).collect()
        new = centres.copy()
        for r in means:
            new[r["patch_id"]] = [r[f"c{c}"] for c in range(dim)]
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres
