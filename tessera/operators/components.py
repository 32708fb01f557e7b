"""Connected components, the largest one, and breadth-first order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators.hot_keys import number_rows
from tessera.session import materialize


def component_roots(graph: PropertyGraph, max_rounds: int = 100) -> DataFrame:
    """``id, root``: the smallest id of each node's weakly connected component.

    Alternating stars: every node links its larger neighbours, then its smaller
    ones, to the smallest it knows.  The edges shrink to stars around the roots
    in a number of rounds that is logarithmic in the longest path, and no
    node's neighbours are ever collected.
    """
    ends = graph.edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    links = materialize(ends, "links")
    state = None
    for _ in range(max_rounds):
        links = materialize(_star(_star(links, large=True), large=False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return graph.nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
    return made.where("u <> v").distinct()


def connected_components(graph: PropertyGraph) -> DataFrame:
    """``id, component, size, root``: components numbered from 0 by falling size.

    Components of equal size are numbered by their smallest id.
    """
    roots = materialize(component_roots(graph), "roots")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    order = [F.desc("size"), F.asc("root")]
    ranked = number_rows(materialize(sizes.repartitionByRange(*order).sortWithinPartitions(*order), "components"))
    return roots.join(ranked.withColumnRenamed("row_no", "component"), "root").select("id", "component", "size", "root")


def largest_component(graph: PropertyGraph, relabel: bool = False) -> PropertyGraph:
    """The subgraph of component 0."""
    return graph.induced(connected_components(graph).where("component = 0").select("id"), relabel)


def bfs_order(graph: PropertyGraph, start: int | None = None) -> DataFrame:
    """``id, position, level``: breadth-first order with neighbours in id order.

    The search begins at ``start``, by default the smallest id, and when its
    component is exhausted goes on at the smallest id not yet visited.  The
    graph is taken as undirected.  All components advance together, one level
    a round: inside a level nodes are ranked by the rank of the neighbour that
    met them first, then by id, which is the order of a queue.
    """
    roots = materialize(component_roots(graph), "roots")
    if start is not None:
        home = roots.where(F.col("id") == start).first()
        if home is None:
            raise ValueError(f"{start} is no node")
        moved = F.col("root") == home["root"]
        roots = roots.withColumn("first", F.when(moved, F.lit(start)).otherwise(F.col("root"))).withColumn("group", F.when(moved, F.lit(-1 << 62)).otherwise(F.col("root")))
    else:
        roots = roots.withColumn("first", F.col("root")).withColumn("group", F.col("root"))
    ends = graph.edges.select("src", "dst").where("src <> dst")
    both = materialize(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both-ways")
    frontier = _ranked(roots.where("id = first").select("id", "group", F.lit(0).cast("long").alias("parent")), 0)
    visited, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        met = (
            both.join(frontier.select(F.col("id").alias("src"), "group", "rank"), "src")
            .groupBy(F.col("dst").alias("id"), "group")
            .agg(F.min("rank").alias("parent"))
            .join(visited.select("id"), "id", "left_anti")
        )
        frontier = _ranked(met, level)
        visited = visited.unionByName(frontier)
    order = ["group", "level", "rank"]
    placed = number_rows(materialize(visited.select("id", *order).repartitionByRange(*order).sortWithinPartitions(*order), "bfs"))
    return placed.select("id", F.col("row_no").alias("position"), "level")


def directed_bfs_order(graph: PropertyGraph, start: int | None = None) -> DataFrame:
    """``id, position, level`` of the same search along edge directions.

    What a restart can reach depends on all searches before it, so searches run
    one after another, each level a round; meant for graphs with few restarts.
    """
    spark = graph.edges.sparkSession
    out = materialize(graph.edges.select("src", "dst").where("src <> dst").distinct(), "out-edges")
    left = materialize(graph.nodes.select("id").distinct(), "unvisited")
    visited, search = spark.createDataFrame([], "id long, group long, level long, rank long"), 0
    first = start if start is not None else left.agg(F.min("id")).first()[0]
    while first is not None:
        frontier = _ranked(spark.createDataFrame([(first, search, 0)], "id long, group long, parent long"), 0)
        level = 0
        while not frontier.isEmpty():
            visited, level = visited.unionByName(frontier), level + 1
            met = (
                out.join(frontier.select(F.col("id").alias("src"), "group", "rank"), "src")
                .groupBy(F.col("dst").alias("id"), "group")
                .agg(F.min("rank").alias("parent"))
                .join(visited.select("id"), "id", "left_anti")
            )
            frontier = _ranked(met, level)
        search += 1
        first = left.join(visited.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
    order = ["group", "level", "rank"]
    placed = number_rows(materialize(visited.select("id", *order).repartitionByRange(*order).sortWithinPartitions(*order), "bfs"))
    return placed.select("id", F.col("row_no").alias("position"), "level")


def _ranked(met: DataFrame, level: int) -> DataFrame:
    order = ["group", "parent", "id"]
    rows = number_rows(materialize(met.select("id", "group", "parent").repartitionByRange(*order).sortWithinPartitions(*order), "level"))
    return materialize(rows.select("id", "group", F.lit(level).cast("long").alias("level"), F.col("row_no").alias("rank")), "level-ranks")
