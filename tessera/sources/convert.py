"""Edge and node tables to snapshots and graphs, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.schema import EDGE_KEYS, NODE_KEYS, feature_columns, require


def coalesced_edges(edges: DataFrame) -> DataFrame:
    """One row per timestamp, src and dst; of repeated edges the one with the smallest features stays."""
    require(edges, *EDGE_KEYS)
    features = feature_columns(edges, EDGE_KEYS)
    rows = edges.where("src is not null and dst is not null")
    if not features:
        return rows.select(*EDGE_KEYS).distinct()
    first = F.min(F.struct(*features)).alias("f")
    return rows.groupBy(*EDGE_KEYS).agg(first).select(*EDGE_KEYS, "f.*")


def first_node_features(nodes: DataFrame) -> DataFrame:
    """One row per id with the features of its earliest row."""
    require(nodes, *NODE_KEYS)
    features = feature_columns(nodes, NODE_KEYS)
    if not features:
        return nodes.select("id").where("id is not null").distinct()
    return (
        nodes.where("id is not null")
        .groupBy("id")
        .agg(F.min(F.struct("timestamp", *features)).alias("f"))
        .select("id", *[F.col(f"f.{c}").alias(c) for c in features])
    )


def node_count(edges: DataFrame) -> int:
    """Largest id of all snapshots plus one; 0 without edges."""
    top = edges.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0]
    return 0 if top is None else top + 1


def snapshots(edges: DataFrame, nodes: DataFrame | None = None) -> Iterator[tuple[object, PropertyGraph]]:
    """``(timestamp, graph)`` for each distinct timestamp in order.

    The graphs are filters on one table: partition it by timestamp to prune.
    One timestamp per snapshot comes to the driver.
    """
    rows = coalesced_edges(edges)
    features = first_node_features(nodes) if nodes is not None else None
    for (when,) in rows.select("timestamp").distinct().orderBy("timestamp").collect():
        part = rows.where(F.col("timestamp").eqNullSafe(F.lit(when))).drop("timestamp")
        yield when, PropertyGraph(part, features if features is not None else PropertyGraph.from_edges(part).nodes)


def frames_by_date(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(edges, nodes)`` of all snapshots at once, with their timestamps.

    The same rows as the stacked graphs of :func:`snapshots`, from one scan and
    one plan whatever the number of dates: the timestamp stays a column.
    """
    rows = coalesced_edges(edges)
    if nodes is None:
        ids = rows.select("timestamp", F.explode(F.array("src", "dst")).alias("id")).distinct()
        return rows, ids
    # One row per date comes to the driver.
    dates = [r[0] for r in rows.select("timestamp").distinct().orderBy("timestamp").collect()]
    stamps = F.array(*[F.lit(d) for d in dates]) if dates else F.array().cast("array<timestamp>")
    return rows, first_node_features(nodes).select("*", F.explode(stamps).alias("timestamp"))


def frames_from_snapshots(graphs: list[tuple[object, PropertyGraph]]) -> tuple[DataFrame, DataFrame]:
    """``(edges, nodes)`` stacked with their timestamps; a missing timestamp is 0."""
    edges = nodes = None
    for when, graph in graphs:
        stamp = F.lit(0 if when is None else when).alias("timestamp")
        e, n = graph.edges.select("*", stamp), graph.nodes.select("*", stamp)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
    if edges is None:
        raise ValueError("there are no snapshots")
    return edges, nodes


def temporal_statistics(edges: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, n_temporal_edges, earliest, latest``; edges are distinct pairs."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    edge_side = pairs.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_temporal_edges"), F.min("a").alias("earliest"), F.max("b").alias("latest"))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id is not null").distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    # Two rows of one: the statistics of the whole table.
    return ids.crossJoin(edge_side)


def snapshot_counts(edges: DataFrame) -> DataFrame:
    """``timestamp, n_edges, n_nodes`` of each coalesced snapshot."""
    rows = coalesced_edges(edges.select(*EDGE_KEYS))
    counts = rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n_edges"))
    ids = rows.select("timestamp", F.col("src").alias("id")).union(rows.select("timestamp", "dst")).distinct()
    return counts.join(ids.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n_nodes")), "timestamp")


def previous_snapshot(edges: DataFrame) -> DataFrame:
    """``timestamp, previous`` of the distinct timestamps."""
    days = edges.select("timestamp").where("timestamp is not null").distinct()
    # One row per snapshot.
    return days.withColumn("previous", F.lag("timestamp").over(Window.orderBy("timestamp")))


def to_edge_list(graph: PropertyGraph) -> list[tuple]:
    """``(src, dst, weight)`` rows of a small graph, in order; what graph libraries read."""
    rows = graph.weighted_edges.orderBy("src", "dst").collect()
    if not graph.directed:
        rows = [r for r in rows if r["src"] <= r["dst"]]
    return [(r["src"], r["dst"], r["weight"]) for r in rows]


def from_data(spark, data) -> PropertyGraph:
    """A graph from an object with arrays: ``edge_index`` of two rows and, if it has them, ``edge_weight``, ``x``, ``y``, ``num_nodes``.

    It is undirected if its edges equal their transpose.
    """
    src, dst = (np.asarray(end, np.int64) for end in data.edge_index)
    weight, x, y = (getattr(data, name, None) for name in ("edge_weight", "x", "y"))
    edges = pd.DataFrame({"src": src, "dst": dst} | ({} if weight is None else {"weight": np.asarray(weight, float)}))
    n = getattr(data, "num_nodes", None)
    n = int(n if n is not None else len(x) if x is not None else max(src.max(initial=-1), dst.max(initial=-1)) + 1)
    nodes = pd.DataFrame({"id": np.arange(n)} | ({} if x is None else {"x": np.asarray(x, float).tolist()}) | ({} if y is None else {"y": np.asarray(y, np.int64)}))
    node_schema = "id long" + ("" if x is None else ", x array<double>") + ("" if y is None else ", y long")
    edge_rows = spark.createDataFrame(edges, "src long, dst long" + ("" if weight is None else ", weight double"))
    node_rows = spark.createDataFrame(nodes, node_schema)
    pairs = set(zip(src.tolist(), dst.tolist()))
    return PropertyGraph(edge_rows, node_rows, directed=any((b, a) not in pairs for a, b in pairs))


def from_networkx(spark, graph, weight: str | None = None) -> PropertyGraph:
    """A graph from an object with ``nodes``, ``edges(data=True)`` and ``is_directed()``."""
    rows = [(int(a), int(b), None if weight is None or data.get(weight) is None else float(data[weight])) for a, b, data in graph.edges(data=True)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(int(n),) for n in graph.nodes], "id long")
    return PropertyGraph.from_edges(edges if weight else edges.drop("weight"), nodes, graph.is_directed(), "weight" if weight else None)
