"""Graphs, points and patches made from the test tables, and the SQL of the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators.affine import Frames, apply_frames
from tessera.session import materialize

SUPPLIER_BASE = 1_000_000
NATION_BASE = 2_000_000
RING = 10
DIM = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts and the suppliers they were bought from, undirected."""
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst")
    )
    return PropertyGraph.from_edges(pairs.distinct(), directed=False)


def stored_trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The same with its pairs written once, for methods that read the graph several times."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst"))
    pairs = materialize(items.distinct(), "trade-pairs")
    nodes = materialize(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), "trade-nodes")
    return PropertyGraph.from_edges(pairs, nodes, directed=False)


def nation_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations by the number of line items between their customers and suppliers, undirected and weighted."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    counted = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = counted.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n").union(counted.select("b", "a", "n"))
    edges = both.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight"))
    return PropertyGraph.from_edges(edges, directed=False, weight="weight", symmetric=True)


def home_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and suppliers tied to their nation: a component per nation, undirected."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + NATION_BASE).cast("long").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("src"), (F.col("s_nationkey") + NATION_BASE).cast("long").alias("dst"))
    return PropertyGraph.from_edges(customers.union(suppliers), directed=False)


def snapshot_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """All edges that any snapshot of edge_df holds, undirected."""
    edges = table(spark, sf_dir, "edge_df").select("src", "dst").where("src is not null and dst is not null and src <> dst")
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return PropertyGraph.from_edges(pairs, directed=False)


def points(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """``node, coords, cluster``: the first coordinates of the embeddings, rounded to two decimals."""
    coords = F.transform(F.slice("embedding", 1, dim), lambda x: F.round(x.cast("double"), 2))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), coords.alias("coords"), F.col("label").cast("long").alias("cluster"))


def ring_frames(dim: int = DIM, ring: int = RING) -> Frames:
    """Known frames of the patches of a ring; patch 0 keeps its coordinates."""
    scale, rot, shift = [], [], []
    for p in range(ring):
        g = np.eye(dim)
        for k in range(dim - 1):
            angle = p * (k + 1)
            turn = np.eye(dim)
            turn[k, k] = turn[k + 1, k + 1] = np.cos(angle)
            turn[k, k + 1], turn[k + 1, k] = -np.sin(angle), np.sin(angle)
            g = g @ turn
        scale.append(1 + p / 4)
        rot.append(g.T)
        shift.append(np.full(dim, 10.0 * p))
    return Frames(list(range(ring)), np.array(scale), np.array(rot), np.array(shift))


def ring_members(spark: SparkSession, sf_dir: str, dim: int = DIM, ring: int = RING) -> DataFrame:
    """``patch_id, node, coords`` of overlapping patches of all points, in one frame."""
    near = F.array(F.pmod("node", F.lit(ring)), F.pmod(F.col("node") - 1, F.lit(ring)))
    return points(spark, sf_dir, dim).select(F.explode(near).alias("patch_id"), "node", "coords").withColumn("patch_id", F.col("patch_id").cast("int"))


def ring_patches(spark: SparkSession, sf_dir: str, dim: int = DIM, ring: int = RING) -> DataFrame:
    """The same patches, each in its own frame."""
    return apply_frames(ring_members(spark, sf_dir, dim, ring), ring_frames(dim, ring))


def usable_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the patch table with eight finite coordinates, one per patch and node."""
    ok = F.forall("coordinates", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = table(spark, sf_dir, "patch").where((F.size("coordinates") == DIM) & ok & F.col("patch_id").isNotNull() & F.col("node").isNotNull())
    return rows.groupBy("patch_id", "node").agg(F.min("coordinates").alias("coords"))


# -- the same in SQL ---------------------------------------------------------------------------

TRADE = f"""trade AS MATERIALIZED (
  SELECT DISTINCT l_partkey AS src, {SUPPLIER_BASE} + l_suppkey AS dst FROM lineitem
  UNION
  SELECT DISTINCT {SUPPLIER_BASE} + l_suppkey, l_partkey FROM lineitem
)"""

NATIONS = """counted AS (
  SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), nations AS MATERIALIZED (
  SELECT src, dst, CAST(sum(n) AS DOUBLE) AS weight
  FROM (SELECT a AS src, b AS dst, n FROM counted UNION ALL SELECT b, a, n FROM counted) GROUP BY 1, 2
)"""

HOMES = f"""homes_one AS (
  SELECT c_custkey AS src, CAST(c_nationkey + {NATION_BASE} AS BIGINT) AS dst FROM customer
  UNION ALL
  SELECT s_suppkey + {SUPPLIER_BASE}, CAST(s_nationkey + {NATION_BASE} AS BIGINT) FROM supplier
), homes AS MATERIALIZED (
  SELECT src, dst FROM homes_one UNION ALL SELECT dst, src FROM homes_one
), home_nodes AS MATERIALIZED (
  SELECT id, home, count(*) OVER (PARTITION BY home) AS size, min(id) OVER (PARTITION BY home) AS root
  FROM (SELECT src AS id, dst AS home FROM homes_one UNION SELECT dst, dst FROM homes_one)
), home_components AS MATERIALIZED (
  SELECT id, home, size, root, dense_rank() OVER (ORDER BY size DESC, root) - 1 AS component FROM home_nodes
)"""

POINTS = """points AS MATERIALIZED (
  SELECT vec_id AS node, list_transform(embedding[1:8], lambda x: round(CAST(x AS DOUBLE), 2)) AS coords, CAST(label AS BIGINT) AS cluster FROM embeddings
)"""

RING_SQL = (
    POINTS
    + """, ring AS MATERIALIZED (
  SELECT p.patch_id, node, coords FROM points, (SELECT CAST(range AS INTEGER) AS patch_id FROM range(10)) p
  WHERE node % 10 = p.patch_id OR node % 10 = (p.patch_id + 1) % 10
)"""
)

USABLE = """usable AS MATERIALIZED (
  SELECT patch_id, node, min(coordinates) AS coords FROM patch
  WHERE len(coordinates) = 8 AND patch_id IS NOT NULL AND node IS NOT NULL
    AND len(list_filter(coordinates, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY patch_id, node
)"""


def flat(coords: str = "coords", dim: int = DIM, digits: int = 2) -> list:
    """Spark columns ``c0..`` of a vector, rounded, with -0.0 as 0.0."""
    return [(F.round(F.get(coords, F.lit(k)), digits) + F.lit(0.0)).alias(f"c{k}") for k in range(dim)]


def flat_sql(coords: str = "coords", dim: int = DIM, digits: int = 2) -> str:
    return ", ".join(f"round({coords}[{k + 1}], {digits}) + 0.0 AS c{k}" for k in range(dim))
