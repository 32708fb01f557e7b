"""Similarity clusters by Markov clustering on a sparse similarity graph.

A group of mutually similar records is a clique, and a clique of the whole
group would be quadratic in its size.  The graph is therefore built on cells: a
grid so fine that its cell diagonal is below the gap between groups puts only
records of one group in a cell.  A group touches a number of cells that
geometry bounds, whatever its number of records, and a cell weighs as much as
the records in it.  Cells are joined where their centres are within the link
distance; the flow on that graph is squared, inflated and pruned until it
stands.  Rows that keep flow are attractors, each cell belongs to the attractor
of its strongest flow.

A column keeps all its entries unless a number is given.  Columns of one group
may settle on different attractors; those that the graph links are one system,
which the links decide exactly.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import pick
from tessera.session import materialize, replace_table

BLOCK_DIMS = 3


def grid_cells(vectors: DataFrame, dim: int, gap: float) -> tuple[DataFrame, DataFrame]:
    """``members(node, vector, cell)`` and ``cells(cell, mass, centre)``.

    The grid's cell diagonal is just below ``gap``.  A cell is named by its
    smallest node, so names don't depend on partitioning.
    """
    side = gap / math.sqrt(dim) * 0.999
    coords = [F.floor(F.get("vector", F.lit(i)) / F.lit(side)).cast("long") for i in range(dim)]
    placed = vectors.select("node", "vector", F.array(*coords).alias("box"))
    cells = (
        placed.groupBy("box")
        .agg(
            F.min("node").alias("cell"),
            F.count(F.lit(1)).alias("mass"),
            *[F.avg(F.get("vector", F.lit(i))).alias(f"c{i}") for i in range(dim)],
        )
        .select("box", "cell", "mass", F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("centre"))
    )
    cells = materialize(cells, "cells")
    members = materialize(placed.join(cells.select("box", "cell"), "box").drop("box"), "cell-members")
    return members, cells.drop("box")


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity_links(cells: DataFrame, dim: int, link: float) -> DataFrame:
    """``a, b, d`` with a < b: all pairs of cells whose centres are within ``link``.

    Cells are blocked by the first coordinates in boxes as wide as ``link``;
    each looks into its own box and those of the neighbouring boxes that come
    after it, so no pair is missed and none is met twice.
    """
    used = min(dim, BLOCK_DIMS)
    box = [F.floor(F.get("centre", F.lit(i)) / F.lit(link)).cast("long") for i in range(used)]
    homes = cells.select(F.col("cell").alias("b"), F.col("centre").alias("cb"), *[x.alias(f"x{i}") for i, x in enumerate(box)])
    own = (0,) * used
    steps = [F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=used) if step >= own]
    same_box = F.forall("step", lambda s: s == 0)
    looks = (
        cells.select(F.col("cell").alias("a"), F.col("centre").alias("ca"), *[x.alias(f"x{i}") for i, x in enumerate(box)])
        .withColumn("step", F.explode(F.array(*steps)))
        .select("a", "ca", same_box.alias("same_box"), *[(F.col(f"x{i}") + F.get("step", F.lit(i))).alias(f"x{i}") for i in range(used)])
    )
    return (
        looks.join(homes, [f"x{i}" for i in range(used)])
        .where("not same_box or a < b")
        .withColumn("d", distance(F.col("ca"), F.col("cb")))
        .where(F.col("d") <= link)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    )


def _pruned(entries: DataFrame, prune: float, column_entries: int | None) -> DataFrame:
    """The entries of each column that reach ``prune`` times its largest, summing up to one.

    If ``column_entries`` is given, only so many of the strongest; ties go to the smaller row.
    """
    whole = Window.partitionBy("j")
    if column_entries is not None:
        strongest = Window.partitionBy("j").orderBy(F.desc("v"), "i")
        entries = entries.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= column_entries)
    kept = entries.withColumn("top", F.max("v").over(whole)).where(F.col("v") >= F.col("top") * F.lit(prune))
    return kept.select("i", "j", (F.col("v") / F.sum("v").over(whole)).alias("v"))


def flow_matrix(cells: DataFrame, links: DataFrame, link: float, column_entries: int | None = None) -> DataFrame:
    """``i, j, v``: the flow from j to i by similarity and weight of the target, with loops."""
    weight = F.exp(-F.pow(F.col("d") / F.lit(link), 2))
    mass = cells.select("cell", F.col("mass").cast("double").alias("m"))
    both = links.select(F.col("a").alias("i"), F.col("b").alias("j"), weight.alias("w")).unionByName(
        links.select(F.col("b").alias("i"), F.col("a").alias("j"), weight.alias("w"))
    )
    linked = both.join(mass.withColumnRenamed("cell", "i"), "i").select("i", "j", (F.col("w") * F.col("m")).alias("v"))
    loops = mass.join(both.select(F.col("j").alias("cell")).distinct(), "cell", "left_semi").select(
        F.col("cell").alias("i"), F.col("cell").alias("j"), F.col("m").alias("v")
    )
    return _pruned(linked.unionByName(loops), 0.0, column_entries)


def markov_step(flow: DataFrame, inflation: float, prune: float, column_entries: int | None = None) -> DataFrame:
    """Square, inflate, prune, normalise.

    The products are put together by column once; sums, ranks and norms of a
    column need no further exchange.
    """
    left = flow.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    right = flow.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    products = left.join(right, "k").select("i", "j", (F.col("a") * F.col("b")).alias("v")).repartition("j")
    squared = products.groupBy("j", "i").agg(F.sum("v").alias("v"))
    return _pruned(squared.withColumn("v", F.pow("v", F.lit(inflation))), prune, column_entries)


def markov_clusters(
    cells: DataFrame,
    links: DataFrame,
    link: float,
    inflation: float = 2.0,
    prune: float = 1e-3,
    max_rounds: int = 60,
    column_entries: int | None = None,
    links_decide: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``labels(cell, label)`` and ``strength(cell, flow)``.

    The loop ends when no column has an entry between ``prune`` and
    1 - ``prune`` any more, or when the flow matrix no longer changes; one that
    still moves after ``max_rounds`` is an error.  Attractors that share a
    column belong to one attractor system and get its smallest name, and so do
    linked ones where a link is proof of one group (``links_decide``); ties
    between attractors go to the smallest.  ``flow`` is the mass
    that flows into a cell in the first squared round, the strength of a
    member.  Cells without links keep to themselves.
    """
    flow = materialize(flow_matrix(cells, links, link, column_entries), "flow")
    first = None
    before = None
    for _ in range(max_rounds):
        # The first squared round is kept for the strengths.
        flow = replace_table(markov_step(flow, inflation, prune, column_entries), "flow", None if flow is first else flow)
        if first is None:
            first = flow
        state = flow.agg(F.count(F.lit(1)), F.sum(F.when(F.col("v").between(prune, 1 - prune), 1).otherwise(0)), F.round(F.sum(F.col("v") * F.col("v")), 6)).first()
        if not state[1] or state == before:
            break
        before = state
    else:
        raise RuntimeError(f"the flow has not settled after {max_rounds} rounds")
    labels = _attractor_labels(flow, links if links_decide else links.limit(0))
    labels = cells.select("cell").join(labels, "cell", "left").select("cell", F.coalesce("label", "cell").alias("label"))
    mass = cells.select(F.col("cell").alias("j"), "mass")
    inflow = first.join(mass, "j").groupBy(F.col("i").alias("cell")).agg(F.sum(F.col("v") * F.col("mass")).alias("flow"))
    strength = cells.select("cell", "mass").join(inflow, "cell", "left").select(
        "cell", F.coalesce("flow", F.lit(0.0)).alias("flow")
    )
    return labels, strength


def _attractor_labels(flow: DataFrame, links: DataFrame) -> DataFrame:
    """The attractor system of each column."""
    chosen = flow.groupBy("j").agg(F.max(F.struct("v", (-F.col("i")).alias("i"))).alias("best")).select(F.col("j").alias("cell"), (-F.col("best.i")).alias("label"))
    labels = materialize(chosen, "labels")
    # Attractors met in one column, and those that are linked, are one system: the smallest of them names it.
    attractors = materialize(labels.select("label").unionByName(flow.select(F.col("i").alias("label"))).distinct(), "attractors")
    in_columns = flow.join(flow.groupBy("j").agg(F.min("i").alias("name")), "j").select(F.col("i").alias("label"), "name")
    linked = links.join(attractors.withColumnRenamed("label", "a"), "a").join(attractors.withColumnRenamed("label", "b"), "b").select("a", "b")
    pairs = in_columns.select(F.col("label").alias("a"), F.col("name").alias("b")).unionByName(linked).where("a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "systems")
    met = materialize(attractors.withColumn("name", F.col("label")), "names")
    while True:
        # Every attractor takes the smallest name among its neighbours, and then that name's own.
        near = both.join(met.select(F.col("label").alias("b"), "name"), "b").groupBy(F.col("a").alias("label")).agg(F.min("name").alias("near"))
        step = met.join(near, "label", "left").select("label", "name", F.least("name", F.coalesce("near", "name")).alias("to"))
        further = step.join(met.select(F.col("label").alias("to"), F.col("name").alias("further")), "to", "left")
        nxt = materialize(further.select("label", F.least("to", F.coalesce("further", "to")).alias("name"), F.col("name").alias("was")), "names")
        if nxt.where("name <> was").isEmpty():
            break
        met = nxt.drop("was")
    return labels.join(met, "label", "left").select("cell", F.coalesce("name", "label").alias("label"))


def vector_clusters(
    vectors: DataFrame,
    dim: int = 8,
    link: float = 2.0,
    gap: float = 3.0,
    min_size: int = 10,
    inflation: float = 2.0,
    prune: float = 1e-3,
) -> DataFrame:
    """Members of each cluster of at least ``min_size`` records.

    ``vectors(node, vector)`` with unique nodes; records of one group are at
    most ``link`` apart, those of different groups at least ``gap``.  Returns
    ``cluster_node, node, size, flow, spread``: the smallest node names the
    cluster, ``flow`` is the strength of the record's cell and ``spread`` the
    record's distance from that cell's centre.

    Equal vectors are members like others.  No vectors give no clusters.
    """
    members, cells = grid_cells(pick(vectors, "node", "vector"), dim, gap)
    links = materialize(similarity_links(cells, dim, link), "links")
    labels, strength = markov_clusters(cells, links, link, inflation, prune, links_decide=True)
    described = labels.join(strength, "cell").join(cells.select("cell", "mass", "centre"), "cell")
    # Cells are far fewer than records: sizes and names come from them.
    groups = described.groupBy("label").agg(F.sum("mass").alias("size"), F.min("cell").alias("cluster_node"))
    kept = materialize(described.join(groups.where(F.col("size") >= min_size), "label"), "clusters")
    return members.join(kept, "cell").select(
        "cluster_node", "node", "size", "flow", distance(F.col("vector"), F.col("centre")).alias("spread")
    )


def cluster_report(clusters: DataFrame, n_typical: int = 3) -> DataFrame:
    """``cluster_node, size, rank, node`` of the most typical members.

    These are the members nearest to the centre of the cell with the strongest
    flow; ties go to the smaller node.
    """
    typical = Window.partitionBy("cluster_node").orderBy(F.desc("flow"), "spread", "node")
    return (
        clusters.withColumn("rank", F.row_number().over(typical))
        .where(F.col("rank") <= n_typical)
        .select("cluster_node", "size", "rank", "node")
    )


def majority_labels(clusters: DataFrame, nodes: DataFrame, key: str = "id", label: str = "y") -> DataFrame:
    """``cluster_node, y, n_rows``: the label that most node rows of a cluster have.

    Rows with a null label or key don't count; of equally frequent labels the
    smallest is given.  A cluster without labelled rows has a null label.
    """
    counts = (
        pick(nodes, key, label)
        .where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("node"), F.col(label).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_label = clusters.select("cluster_node", "node").join(counts, "node").groupBy("cluster_node", "y").agg(F.sum("n").alias("n_rows"))
    best = by_label.groupBy("cluster_node").agg(F.max(F.struct("n_rows", (-F.col("y")).alias("y"))).alias("b"))
    best = best.select("cluster_node", (-F.col("b.y")).alias("y"), F.col("b.n_rows").alias("n_rows"))
    names = clusters.select("cluster_node", "size").distinct()
    return names.join(best, "cluster_node", "left")
