"""Hard partitions of a graph: ``partition(node, cluster)``.

Greedy one-pass methods depend on the order of nodes.  They run exactly, in one
task that holds the state of all nodes and has the adjacency in mapped files;
:func:`label_spread` and :func:`modularity_clusters` work in rounds on
DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators.hot_keys import number_rows
from tessera.operators.in_task import SparseRows, in_batches, in_one_task, mapped_zeros
from tessera.session import materialize

MAX_CLUSTERS = 20_000
MAX_QUOTIENT_IN_TASK = 2_000
_PARTITION = "node long, cluster long"
# Labels of all rows of a graph, divided into a number of clusters.
LabelFunction = Callable[[SparseRows, int], np.ndarray]


def _graph_rows(graph: PropertyGraph, initial: DataFrame | None = None) -> DataFrame:
    """``src, dst[, weight]``: the edges, and one row without ``dst`` for every node, whose weight is its initial label."""
    nodes = graph.nodes.select(F.col("id").alias("src"))
    if not graph.weighted and initial is None:
        return graph.edges.select("src", "dst").unionByName(nodes.withColumn("dst", F.lit(None).cast("long")))
    if initial is not None:
        nodes = nodes.join(initial.select(F.col("node").alias("src"), F.col("cluster").cast("double").alias("weight")), "src", "left")
    else:
        nodes = nodes.withColumn("weight", F.lit(None).cast("double"))
    return graph.weighted_edges.unionByName(nodes.select("src", F.lit(None).cast("long").alias("dst"), "weight"))


def _in_one_task(graph: PropertyGraph, kernel: Callable[[SparseRows], np.ndarray], initial: DataFrame | None = None) -> DataFrame:
    """Run a sequential kernel over the sorted rows of a graph.

    Nodes without an initial label have -1.
    """

    def run(rows: SparseRows) -> Iterator[pa.RecordBatch]:
        yield from in_batches({"node": rows.ids, "cluster": kernel(rows).astype(np.int64)})

    return materialize(in_one_task(_graph_rows(graph, initial), run, _PARTITION), "partition")


def _fennel_labels(
    rows: SparseRows, k: int, load_limit: float = 1.1, alpha: float | None = None, gamma: float = 1.5, num_iters: int = 1, label: np.ndarray | None = None
) -> np.ndarray:
    n, m = len(rows.ids), len(rows.v)
    price = alpha if alpha is not None else (m * k ** (gamma - 1) / n**gamma if n else 0.0)
    cap = max(1, int(np.ceil(load_limit * n / k)))
    start, v = rows.start.tolist(), rows.v
    label = np.full(n, -1) if label is None else label.copy()
    size = np.bincount(label[label >= 0], minlength=k)
    for _ in range(max(1, num_iters)):
        moved = False
        for node in range(n):
            near = label[v[start[node] : start[node + 1]]]
            old = label[node]
            if old >= 0:
                size[old] -= 1
            score = np.bincount(near[near >= 0], minlength=k) - price * gamma * size ** (gamma - 1)
            score[size >= cap] = -np.inf
            new = int(score.argmax())
            size[new] += 1
            label[node] = new
            moved |= new != old
        if not moved:
            break
    return label


def fennel(
    graph: PropertyGraph, k: int, load_limit: float = 1.1, alpha: float | None = None, gamma: float = 1.5, num_iters: int = 1, initial: DataFrame | None = None
) -> DataFrame:
    """Streaming partition: each node joins the cluster with most neighbours, less a price for its size.

    Nodes come in id order; further passes repeat until nobody moves.  The
    price of a cluster of size s is ``alpha gamma s^(gamma - 1)``, by default
    with ``alpha = m k^(gamma - 1) / n^gamma`` and m the stored edges.  No
    cluster takes a node beyond ``load_limit n / k`` (rounded up).  Ties go to
    the smaller cluster number.  ``initial(node, cluster)`` with clusters below
    k is where the first pass starts from.
    """
    return _in_one_task(graph, lambda rows: _fennel_labels(rows, k, load_limit, alpha, gamma, num_iters, rows.own), initial)


# Methods with labels in a task can be applied to many parts of a graph without a job for each.
fennel.in_task = _fennel_labels


def balanced_cut(graph: PropertyGraph, k: int, load_limit: float = 1.05, passes: int = 10) -> DataFrame:
    """k parts of nearly equal size with few edges between them.

    Restreamed :func:`fennel` and then boundary refinement: a node moves to the
    part that holds most of its neighbours if that part has room.
    """

    def kernel(rows: SparseRows) -> np.ndarray:
        cap = max(1, int(np.ceil(load_limit * len(rows.ids) / k)))
        start, v, w = rows.start.tolist(), rows.v, rows.w
        label = _fennel_labels(rows, k, load_limit, num_iters=passes)
        size = np.bincount(label, minlength=k)
        for _ in range(passes):
            moved = 0
            for node in range(len(rows.ids)):
                at = slice(start[node], start[node + 1])
                pull = np.bincount(label[v[at]], None if w is None else w[at], k)
                old = label[node]
                allowed = size < cap
                allowed[old] = True
                new = int(np.where(allowed, pull, -np.inf).argmax())
                if pull[new] > pull[old] and size[old] > 1:
                    size[old] -= 1
                    size[new] += 1
                    label[node] = new
                    moved += 1
            if not moved:
                break
        return label

    return _in_one_task(graph, kernel)


def spread(graph: PropertyGraph, k: int, seed: int | None = None) -> DataFrame:
    """Clusters grow in turns from k seeds, each absorbing the node that is tied to it most.

    The tie of an unassigned node v is the sum of ``w(u, v) / strength(v)``
    over members u.  Seeds are the k nodes of highest degree, or drawn by
    degree if a random seed is given.  When no cluster can grow, a new one
    opens at the unassigned node of highest degree.  Ties go to the lower id.
    """

    def kernel(rows: SparseRows) -> np.ndarray:
        n, start, v, w = len(rows.ids), rows.start.tolist(), rows.v, rows.w
        degree, strength = np.diff(rows.start), rows.sums()
        strength[strength == 0] = 1.0
        by_degree = np.lexsort((rows.ids, -degree))
        if seed is None:
            seeds = by_degree[: min(k, n)]
        else:
            draw = np.log(np.maximum(degree, 1e-12)) + np.random.default_rng(seed).gumbel(size=n)
            seeds = np.argsort(-draw, kind="stable")[: min(k, n)]
        label = np.full(n, -1)
        # Ties by cluster and node, and an upper bound of them for each block of nodes.
        width = 1024
        blocks = -(-n // width)
        ties = mapped_zeros((len(seeds), blocks * width))
        none = 0.0 if w is None or all((w[at] > 0).all() for *_, at in rows.chunks()) else -np.inf
        if none:
            ties[:] = none
        most = np.full((len(seeds), blocks), none)

        def take(node: int, cluster: int, r: int) -> None:
            label[node] = cluster
            ties[:, node] = none
            near = v[start[node] : start[node + 1]]
            free = label[near] < 0
            near = near[free]
            if not len(near):
                return
            gain = (1.0 if w is None else w[start[node] : start[node + 1]][free]) / strength[near]
            own = ties[r]
            if (near[1:] == near[:-1]).any():
                own[near[own[near] == none]] = 0.0
                np.add.at(own, near, gain)
                tied = own[near]
            else:
                tied = own[near]
                tied[tied == none] = 0.0
                tied += gain
                own[near] = tied
            np.maximum.at(most[r], near // width, tied)

        def strongest(r: int) -> int:
            while True:
                b = int(most[r].argmax())
                if most[r, b] == none:
                    return -1
                node = b * width + int(ties[r, b * width : (b + 1) * width].argmax())
                if ties[r, node] == most[r, b]:
                    return node
                most[r, b] = ties[r, node]

        label[seeds] = np.arange(len(seeds))
        for c, node in enumerate(seeds):
            take(int(node), c, c)
        # A cluster without ties gains none any more, and its row is empty.
        live, opened, place = [(c, c) for c in range(len(seeds))], len(seeds), 0
        left = n - len(seeds)
        while left:
            growing = []
            for c, r in live:
                node = strongest(r) if left else -1
                if node >= 0:
                    take(node, c, r)
                    left -= 1
                    growing.append((c, r))
            live = growing
            if not live and left:
                while label[by_degree[place]] >= 0:
                    place += 1
                take(int(by_degree[place]), opened, 0)
                live = [(opened, 0)]
                opened += 1
                left -= 1
        return label

    return _in_one_task(graph, kernel)


def modularity(graph: PropertyGraph, partition: DataFrame, resolution: float = 1.0) -> float | None:
    """Newman modularity of a partition over the stored edges, with a resolution; None without edges."""
    a = partition.select(F.col("node").alias("src"), F.col("cluster").alias("ca"))
    b = partition.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
    marked = graph.weighted_edges.join(a, "src").join(b, "dst")
    sides = marked.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("out"))
    row = sides.agg(F.sum("out").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("out") * F.col("out")).alias("q")).first()
    return None if not row["m"] else row["i"] / row["m"] - resolution * row["q"] / row["m"] ** 2


def modularity_clusters(
    graph: PropertyGraph, max_levels: int = 64, rounds: int = 1_000, resolution: float = 1.0, initial: DataFrame | None = None, seed: int = 0
) -> DataFrame:
    """Clusters of high modularity: local moves in rounds, then contraction, until nothing improves.

    In a round one half of the nodes, by a seeded hash that changes every
    other round, may move to the neighbouring cluster with the largest gain; a round that doesn't raise the
    modularity is undone.  A larger ``resolution`` gives smaller clusters;
    ``initial(node, cluster)`` is where the moves start from, by default every
    node is a cluster.  Clusters are named by their smallest node.  Levels or
    rounds that are used up before nothing improves are an error.
    """
    base = graph.weighted_edges
    current = PropertyGraph(base, graph.nodes, False)
    members = materialize(graph.nodes.select(F.col("id").alias("node"), F.col("id").alias("cluster")), "members")
    for level in range(max_levels + 1):
        labels, improved = _local_moves(current, rounds, resolution, initial if level == 0 else None, seed)
        if not improved:
            break
        if level == max_levels:
            raise RuntimeError(f"the modularity still improves after {max_levels} levels")
        members = materialize(
            members.join(labels.select(F.col("node").alias("cluster"), F.col("cluster").alias("up")), "cluster").select("node", F.col("up").alias("cluster")), "members"
        )
        a = labels.select(F.col("node").alias("src"), F.col("cluster").alias("ca"))
        b = labels.select(F.col("node").alias("dst"), F.col("cluster").alias("cb"))
        edges = current.edges.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("weight").alias("weight"))
        current = PropertyGraph(materialize(edges, "contracted"), materialize(labels.select(F.col("cluster").alias("id")).distinct(), "contracted-nodes"), False)
    names = members.groupBy("cluster").agg(F.min("node").alias("name"))
    return members.join(names, "cluster").select("node", F.col("name").alias("cluster"))


def _local_moves(graph: PropertyGraph, rounds: int, resolution: float, initial: DataFrame | None, seed: int) -> tuple[DataFrame, bool]:
    strength = materialize(graph.strength().withColumnRenamed("id", "node"), "strength")
    total = strength.agg(F.sum("strength")).first()[0] or 0.0
    alone = graph.nodes.select(F.col("id").alias("node"), F.col("id").alias("cluster"))
    if initial is not None:
        # Clusters are named by a member, so that a given number can't meet another node's own.
        named = initial.groupBy("cluster").agg(F.min("node").alias("name"))
        given = initial.join(named, "cluster").select("node", "name")
        alone = alone.join(given, "node", "left").select("node", F.coalesce("name", "cluster").alias("cluster"))
    labels = materialize(alone, "labels")
    if not total:
        return labels, initial is not None
    best = modularity(graph, labels, resolution)
    improved, idle = initial is not None, 0
    for step in range(rounds * 2):
        volume = labels.join(strength, "node").groupBy("cluster").agg(F.sum("strength").alias("volume"), F.count(F.lit(1)).alias("n"))
        pull = (
            graph.edges.where("src <> dst")
            .join(labels.select(F.col("node").alias("dst"), "cluster"), "dst")
            .groupBy(F.col("src").alias("node"), "cluster")
            .agg(F.sum("weight").alias("pull"))
        )
        own = labels.join(strength, "node").select("node", F.col("cluster").alias("own"), "strength")
        options = pull.join(own, "node").join(volume, "cluster")
        others = F.col("volume") - F.when(F.col("cluster") == F.col("own"), F.col("strength")).otherwise(0.0)
        gain = F.col("pull") - F.lit(resolution) * F.col("strength") * others / F.lit(total)
        # Two clusters of one node each would only swap: the one with the larger name moves.
        alone = volume.where("n = 1").select(F.col("cluster").alias("own"), F.lit(True).alias("alone"))
        swaps = F.coalesce("alone", F.lit(False)) & (F.col("n") == 1) & (F.col("cluster") > F.col("own"))
        scored = options.join(alone, "own", "left").where(~swaps).select("node", "cluster", "own", gain.alias("gain"))
        stay = scored.where("cluster = own").select("node", F.col("gain").alias("stay"))
        top = scored.groupBy("node", "own").agg(F.max(F.struct("gain", (-F.col("cluster")).alias("c"))).alias("b"))
        moves = (
            top.join(stay, "node", "left")
            .where((F.col("b.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12) & (F.pmod(F.xxhash64(F.lit(seed + step // 2), "node"), F.lit(2)) == step % 2))
            .select("node", (-F.col("b.c")).alias("to"))
        )
        moved = materialize(labels.join(moves, "node", "left").select("node", F.coalesce("to", "cluster").alias("cluster")), "labels")
        value = modularity(graph, moved, resolution)
        if value > best + 1e-9:
            best, labels, improved, idle = value, moved, True, 0
        else:
            idle += 1
            if idle >= 4:
                break
    else:
        raise RuntimeError(f"nodes still move after {rounds} rounds")
    return labels, improved


def label_spread(graph: PropertyGraph, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Clusters grow from ``seeds(node, cluster)`` a neighbourhood a round; unreached nodes form clusters of one.

    Each unassigned node joins the cluster to which most of its weight goes,
    the smaller one at a tie.  It goes on until no node is reached; if a number
    of ``rounds`` is given and doesn't suffice, it raises.
    """
    labels = materialize(seeds.select("node", "cluster"), "spread")
    step = 0
    while True:
        met = (
            graph.weighted_edges.join(labels.select(F.col("node").alias("src"), "cluster"), "src")
            .groupBy(F.col("dst").alias("node"), "cluster")
            .agg(F.sum("weight").alias("w"))
            .join(labels.select("node"), "node", "left_anti")
        )
        first = met.groupBy("node").agg(F.max(F.struct("w", (-F.col("cluster")).alias("c"))).alias("b")).select("node", (-F.col("b.c")).alias("cluster"))
        first = materialize(first, "spread-step")
        if first.isEmpty():
            break
        if step == rounds:
            raise RuntimeError(f"nodes are still reached after {rounds} rounds")
        step += 1
        labels = labels.unionByName(first)
        # The plan would grow by a union a round.
        if step % 20 == 0:
            labels = materialize(labels, "spread")
    top = labels.agg(F.max("cluster")).first()[0]
    alone = graph.nodes.select(F.col("id").alias("node")).join(labels, "node", "left_anti")
    ordered = number_rows(materialize(alone.repartitionByRange("node").sortWithinPartitions("node"), "alone"))
    return labels.unionByName(ordered.select("node", (F.col("row_no") + F.lit((-1 if top is None else top) + 1)).alias("cluster")))


ClusterFunction = Callable[[PropertyGraph, int], DataFrame]


def hierarchical_agglomerative(graph: PropertyGraph, cluster: ClusterFunction, branch_factors: list[int] | None = None, levels: int | None = None) -> list[DataFrame]:
    """``(node, cluster)`` per level, each clustering the clusters of the level before.

    The numbers of clusters are the products of the branch factors from the
    top; by default ``levels`` equal factors of ``n^(1 / (levels + 1))``.
    """
    if branch_factors is None:
        if levels is None or levels < 1:
            raise ValueError("give branch factors or a number of levels")
        factor = max(2, round(graph.num_nodes ** (1 / (levels + 1))))
        branch_factors = [factor] * levels
    sizes = list(np.cumprod(branch_factors))[::-1]
    if hasattr(cluster, "in_task") and sizes and sizes[0] <= MAX_QUOTIENT_IN_TASK:
        return _agglomerated_in_task(graph, cluster.in_task, [int(size) for size in sizes])
    out, current = [], graph
    for size in sizes:
        level = cluster(current, int(size))
        out.append(level)
        current = current.quotient(level, self_loops=True)
    return out


def _agglomerated_in_task(graph: PropertyGraph, labels_of: LabelFunction, sizes: list[int]) -> list[DataFrame]:
    def run(rows: SparseRows) -> Iterator[pa.RecordBatch]:
        for level, size in enumerate(sizes):
            label = labels_of(rows, size).astype(np.int64)
            yield from in_batches({"level": np.full(len(label), level, np.int32), "node": rows.ids, "cluster": label})
            rows = rows.quotient(label)

    levels = materialize(in_one_task(_graph_rows(graph), run, "level int, node long, cluster long"), "levels")
    return [levels.where(F.col("level") == level).select("node", "cluster") for level in range(len(sizes))]


def compose_hierarchy(hierarchy: list[DataFrame]) -> DataFrame:
    """The clusters of the last level as a partition of the first level's nodes."""
    whole = hierarchy[0].select("node", "cluster")
    for level in hierarchy[1:]:
        whole = whole.join(level.select(F.col("node").alias("cluster"), F.col("cluster").alias("up")), "cluster").select("node", F.col("up").alias("cluster"))
    return whole


def hierarchical_divisive(graph: PropertyGraph, cluster: ClusterFunction, max_size: int, branches: int = 2, max_depth: int | None = None) -> DataFrame:
    """``node, path``: clusters are divided until none has more than ``max_size`` nodes.

    The path names a cluster by its choices from the top, as ``0/1/0``.  A
    cluster that its method doesn't divide stays as it is.  If ``max_depth`` is
    given and larger clusters could still be divided there, it raises.
    """
    if hasattr(cluster, "in_task") and max_depth is None:
        return _divided_in_task(graph, cluster.in_task, max_size, branches)
    state = materialize(cluster(graph, branches).select("node", F.col("cluster").cast("string").alias("path")), "divisive")
    depth = 0
    undivided: set[str] = set()
    while True:
        # Only clusters above max_size come to the driver: at most nodes / max_size.
        large = [r["path"] for r in state.groupBy("path").count().where(F.col("count") > max_size).select("path").orderBy("path").collect()]
        large = [path for path in large if path not in undivided]
        changed = False
        for path in large:
            part = graph.induced(state.where(F.col("path") == path).select(F.col("node").alias("id")))
            divided = cluster(part, branches)
            if divided.select("cluster").distinct().count() < 2:
                undivided.add(path)
                continue
            if depth == max_depth:
                raise RuntimeError(f"clusters above {max_size} nodes are left at depth {max_depth}")
            changed = True
            renamed = divided.select("node", F.concat(F.lit(path + "/"), F.col("cluster").cast("string")).alias("new"))
            state = materialize(state.join(renamed, "node", "left").select("node", F.coalesce("new", "path").alias("path")), "divisive")
        if not changed:
            break
        depth += 1
    return state


def _divided_in_task(graph: PropertyGraph, labels_of: LabelFunction, max_size: int, branches: int) -> DataFrame:
    def run(rows: SparseRows) -> Iterator[pa.RecordBatch]:
        paths, names = np.zeros(len(rows.ids), np.int64), []
        # A part, its positions in the whole and its path; the whole is always divided, even into one.
        waiting = [(rows, np.arange(len(rows.ids)), "")]
        while waiting:
            part, at, path = waiting.pop()
            label = labels_of(part, branches)
            found = np.unique(label)
            if path and len(found) < 2:
                continue
            for c in found:
                inside = np.flatnonzero(label == c)
                names.append(f"{path}/{c}" if path else str(c))
                paths[at[inside]] = len(names) - 1
                if len(inside) > max_size:
                    waiting.append((part.induced(inside), at[inside], names[-1]))
        path = pa.DictionaryArray.from_arrays(pa.array(paths.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        yield from in_batches({"node": rows.ids, "path": path})

    return materialize(in_one_task(_graph_rows(graph), run, "node long, path string"), "divisive")


def partition_index(partition: DataFrame) -> DataFrame:
    """``cluster, nodes`` with the sorted nodes of each cluster."""
    return partition.groupBy("cluster").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def cluster_sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def size_histogram(partition: DataFrame) -> DataFrame:
    """``size, n_clusters``."""
    return cluster_sizes(partition).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


def merge_small_clusters(graph: PropertyGraph, partition: DataFrame, min_size: int) -> DataFrame:
    """Clusters below ``min_size`` are merged into the neighbour they have most edges to, per volume.

    The smallest cluster goes first, the lower number at a tie; one without
    edges to others joins the second smallest.  The remaining clusters are
    numbered 0.. in the order of their old numbers.  Works on one row per pair
    of adjacent clusters, of at most ``MAX_CLUSTERS`` clusters.
    """
    rows = cluster_sizes(partition).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters; merge a coarser partition")
    sizes = {r["cluster"]: r["size"] for r in rows}
    quotient = graph.quotient(partition, self_loops=True)
    links: dict[int, dict[int, float]] = {c: {} for c in sizes}
    for r in quotient.edges.collect():
        links[r["src"]][r["dst"]] = links[r["src"]].get(r["dst"], 0.0) + r["weight"]
    target = {c: c for c in sizes}
    while len(sizes) > 1:
        small = min(sizes, key=lambda c: (sizes[c], c))
        if sizes[small] >= min_size:
            break
        volume = {c: sum(links[c].values()) for c in sizes}
        near = [c for c in links[small] if c != small and links[small][c] > 0]
        into = min(near, key=lambda c: (-links[small][c] / max(volume[c], 1e-300), c)) if near else min((c for c in sizes if c != small), key=lambda c: (sizes[c], c))
        for c, w in links.pop(small).items():
            if c == small:
                c = into
            links[into][c] = links[into].get(c, 0.0) + w
        for row in links.values():
            if small in row:
                row[into] = row.get(into, 0.0) + row.pop(small)
        sizes[into] += sizes.pop(small)
        target = {c: into if t == small else t for c, t in target.items()}
    number = {c: k for k, c in enumerate(sorted(sizes))}
    spark = partition.sparkSession
    renamed = spark.createDataFrame([(c, number[t]) for c, t in target.items()], "cluster long, merged long")
    return partition.join(F.broadcast(renamed), "cluster").select("node", F.col("merged").alias("cluster"))
