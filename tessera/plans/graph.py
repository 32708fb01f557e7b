"""Queries of the graph operators over the test tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import MODULUS, MULTIPLIER, lcg
from tessera.graph import PropertyGraph, dense_ids
from tessera.operators import clustering as C
from tessera.operators import components as K
from tessera.operators import patches as P
from tessera.operators import sparsify as S
from tessera.operators.spanning import spanning_forest, spanning_tree_edges
from tessera.plans.fixtures import (
    HOMES,
    NATION_BASE,
    NATIONS,
    POINTS,
    SUPPLIER_BASE,
    TRADE,
    home_graph,
    nation_graph,
    points,
    snapshot_graph,
    table,
    stored_trade_graph,
    trade_graph,
)
from tessera.session import materialize, scratch_path
from tessera.sources import convert, files
from tessera.streaming.snapshots import edge_stream, run_once, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


# -- primitives --------------------------------------------------------------------------------


@query("degree", f"WITH {TRADE} SELECT src AS id, count(*) AS degree FROM trade GROUP BY src")
def degree(spark, d):
    return trade_graph(spark, d).degree()


@query("strength", f"WITH {NATIONS} SELECT src AS id, sum(weight) AS strength FROM nations GROUP BY src")
def strength(spark, d):
    return nation_graph(spark, d).strength()


@query(
    "is_undirected",
    f"""WITH {NATIONS} SELECT count(*) FILTER (b.src IS NULL) = 0 AS is_undirected
FROM nations a LEFT JOIN nations b ON a.src = b.dst AND a.dst = b.src AND a.weight = b.weight""",
)
def is_undirected(spark, d):
    return spark.createDataFrame([(nation_graph(spark, d).is_symmetric(),)], "is_undirected boolean")


@query("symmetrize", f"WITH {TRADE} SELECT src, dst FROM trade")
def symmetrize(spark, d):
    return trade_graph(spark, d).edges


@query(
    "adjacency_list",
    f"WITH {NATIONS} SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS position, dst, weight FROM nations",
)
def adjacency_list(spark, d):
    return nation_graph(spark, d).adjacency()


_SEEDS = f"seeds AS (SELECT s_suppkey + {SUPPLIER_BASE} AS id FROM supplier WHERE s_nationkey = 0)"


def _seeds(spark, d):
    return table(spark, d, "supplier").where("s_nationkey = 0").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("id"))


@query("neighbours_of_set", f"WITH {TRADE}, {_SEEDS} SELECT DISTINCT dst AS id FROM trade WHERE src IN (SELECT id FROM seeds)")
def neighbours_of_set(spark, d):
    return trade_graph(spark, d).neighbours(_seeds(spark, d))


@query(
    "is_edge_batch",
    f"""WITH {TRADE}, pairs AS (SELECT DISTINCT l_partkey AS src, {SUPPLIER_BASE} + l_suppkey + l_linenumber AS dst FROM lineitem)
SELECT p.src, p.dst, t.src IS NOT NULL AS is_edge FROM pairs p LEFT JOIN trade t ON p.src = t.src AND p.dst = t.dst""",
)
def is_edge_batch(spark, d):
    pairs = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber") + SUPPLIER_BASE).alias("dst")
    )
    return trade_graph(spark, d).is_edge(pairs.distinct())


@query(
    "khop_2",
    f"""WITH RECURSIVE {HOMES}, seeds AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5),
reach(id, hop) AS (
  SELECT id, 0 FROM seeds UNION
  SELECT h.dst, r.hop + 1 FROM reach r JOIN homes h ON h.src = r.id WHERE r.hop < 2
) SELECT id, min(hop) AS hop FROM reach GROUP BY id""",
)
def khop_2(spark, d):
    seeds = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return home_graph(spark, d).k_hop(seeds, 2)


_CHOSEN = f"""chosen AS (
  SELECT p_partkey AS id FROM part WHERE p_size <= 25
  UNION ALL SELECT s_suppkey + {SUPPLIER_BASE} FROM supplier WHERE s_nationkey <= 12
)"""


def _chosen(spark, d):
    parts = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return parts.union(table(spark, d, "supplier").where("s_nationkey <= 12").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("id")))


@query(
    "induced_subgraph",
    f"WITH {TRADE}, {_CHOSEN} SELECT src, dst FROM trade WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen)",
)
def induced_subgraph(spark, d):
    return trade_graph(spark, d).induced(_chosen(spark, d)).edges


@query(
    "induced_relabelled",
    f"""WITH {TRADE}, {_CHOSEN}, numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM chosen)
SELECT a.n AS src, b.n AS dst FROM trade t JOIN numbered a ON t.src = a.id JOIN numbered b ON t.dst = b.id""",
)
def induced_relabelled(spark, d):
    return trade_graph(spark, d).induced(_chosen(spark, d), relabel=True).edges


@query(
    "induced_with_hops",
    f"""WITH {HOMES}, seeds AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5),
wide AS (SELECT id FROM seeds UNION SELECT h.src FROM homes h JOIN seeds s ON h.dst = s.id)
SELECT src, dst FROM homes WHERE src IN (SELECT id FROM wide) AND dst IN (SELECT id FROM wide)""",
)
def induced_with_hops(spark, d):
    seeds = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return home_graph(spark, d).induced_with_hops(seeds, 1).edges


@query("densify_ids", f"WITH {TRADE} SELECT src AS id, row_number() OVER (ORDER BY src) - 1 AS new_id FROM (SELECT DISTINCT src FROM trade)")
def densify_ids(spark, d):
    return dense_ids(trade_graph(spark, d).nodes, "id")


# -- components and order --------------------------------------------------------------------------


@query("connected_components", f"WITH {HOMES} SELECT id, component, size, root FROM home_components")
def connected_components(spark, d):
    return K.connected_components(home_graph(spark, d))


@query(
    "connected_components_snapshots",
    """WITH RECURSIVE ends AS MATERIALIZED (
  SELECT src, dst FROM edge_df WHERE src <> dst UNION SELECT dst, src FROM edge_df WHERE src <> dst
), reach(id, root) USING KEY (id) AS (
  SELECT DISTINCT src, src FROM ends
  UNION
  SELECT e.dst, min(r.root) FROM reach r JOIN ends e ON e.src = r.id JOIN recurring.reach k ON k.id = e.dst
  WHERE r.root < k.root GROUP BY e.dst
) SELECT id, root FROM reach""",
)
def connected_components_snapshots(spark, d):
    return K.component_roots(snapshot_graph(spark, d))


@query("lcc_nodes", f"WITH {HOMES} SELECT id FROM home_components WHERE component = 0")
def lcc_nodes(spark, d):
    return K.connected_components(home_graph(spark, d)).where("component = 0").select("id")


@query(
    "lcc_subgraph",
    f"WITH {HOMES} SELECT src, dst FROM homes WHERE src IN (SELECT id FROM home_components WHERE component = 0)",
)
def lcc_subgraph(spark, d):
    return K.largest_component(home_graph(spark, d)).edges


@query(
    "bfs_order",
    f"""WITH {HOMES}, levels AS (
  SELECT id, root, CASE WHEN id = root THEN 0 WHEN id = home THEN 1 ELSE 2 END AS level FROM home_components
) SELECT id, row_number() OVER (ORDER BY root, level, id) - 1 AS position, CAST(level AS BIGINT) AS level FROM levels""",
)
def bfs_order(spark, d):
    return K.bfs_order(home_graph(spark, d))


# -- quotients and measures ----------------------------------------------------------------------------


def _mod8(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.select(F.col("id").alias("node"), F.pmod("id", F.lit(8)).alias("cluster"))


@query(
    "partition_graph",
    f"WITH {TRADE} SELECT src % 8 AS src, dst % 8 AS dst, CAST(count(*) AS DOUBLE) AS weight FROM trade WHERE src % 8 <> dst % 8 GROUP BY 1, 2",
)
def partition_graph(spark, d):
    graph = trade_graph(spark, d)
    return graph.quotient(_mod8(graph)).edges


@query(
    "partition_graph_loops",
    f"WITH {TRADE} SELECT src % 8 AS src, dst % 8 AS dst, CAST(count(*) AS DOUBLE) AS weight FROM trade GROUP BY 1, 2",
)
def partition_graph_loops(spark, d):
    graph = trade_graph(spark, d)
    return graph.quotient(_mod8(graph), self_loops=True).edges


@query(
    "conductance_by_cluster",
    f"""WITH {TRADE}, each AS (
  SELECT src % 8 AS cluster, CAST(sum(CASE WHEN src % 8 <> dst % 8 THEN 1 ELSE 0 END) AS BIGINT) AS cut, count(*) AS volume FROM trade GROUP BY 1
) SELECT cluster, cut, volume, cut / least(volume, (SELECT count(*) FROM trade) - volume) AS conductance FROM each""",
)
def conductance_by_cluster(spark, d):
    graph = trade_graph(spark, d)
    return graph.cluster_conductance(_mod8(graph))


@query(
    "conductance",
    f"""WITH {TRADE} SELECT round(count(*) FILTER (src < {SUPPLIER_BASE} AND dst >= {SUPPLIER_BASE})
  / least(count(*) FILTER (src < {SUPPLIER_BASE}), count(*) FILTER (src >= {SUPPLIER_BASE})), 9) AS conductance FROM trade""",
)
def conductance(spark, d):
    graph = trade_graph(spark, d)
    value = graph.conductance(graph.nodes.where(F.col("id") < SUPPLIER_BASE))
    return spark.createDataFrame([(round(value, 9),)], "conductance double")


@query(
    "conductance_weights",
    f"""WITH {NATIONS}, s AS (SELECT src AS id, sum(weight) AS strength FROM nations GROUP BY src)
SELECT n.src, n.dst, round(n.weight / least(a.strength, b.strength), 12) AS weight
FROM nations n JOIN s a ON n.src = a.id JOIN s b ON n.dst = b.id""",
)
def conductance_weights(spark, d):
    return S.conductance_weights(nation_graph(spark, d)).withColumn("weight", F.round("weight", 12))


# The engine's uniform numbers and draws in SQL: hexadecimal digits of an MD5.
_U = "(('0x' || substr(md5('1:' || src || ':' || dst), 1, 13))::BIGINT + 0.5) * pow(2, -52)"


def _draw(seed: int, column: str, n: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {column}), 1, 15))::BIGINT % {n}"


@query(
    "edge_sample",
    f"""WITH {TRADE}, numbered AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS row_no FROM trade)
SELECT d.range AS draw, src, dst FROM range(1000) d JOIN numbered ON row_no = {_draw(1, "d.range", "(SELECT count(*) FROM trade)")}""",
)
def edge_sample(spark, d):
    return trade_graph(spark, d).sample_edges(1000)


@query(
    "non_edge_sample",
    f"""WITH {TRADE}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS no FROM (SELECT DISTINCT src AS id FROM trade)),
n AS (SELECT count(*) AS n FROM ids), drawn AS (SELECT range AS draw, {_draw(1, "range", "n")} AS a, {_draw(2, "range", "n")} AS b FROM range(20000), n)
SELECT draw, x.id AS src, y.id AS dst FROM drawn JOIN ids x ON x.no = a JOIN ids y ON y.no = b
WHERE a <> b AND NOT EXISTS (SELECT 1 FROM trade t WHERE t.src = x.id AND t.dst = y.id) ORDER BY draw LIMIT 1000""",
)
def non_edge_sample(spark, d):
    return trade_graph(spark, d).sample_non_edges(1000)


# -- spanning trees and sparsification ------------------------------------------------------------------

# Minimax paths over the 25 nations: an edge is in the tree iff no path of earlier edges joins its ends.
def _tree_sql(order: str, before: str = "", rows: str = "nations") -> str:
    return f"""WITH RECURSIVE {NATIONS}, {before} ranked AS MATERIALIZED (
  SELECT src AS u, dst AS v, weight, row_number() OVER (ORDER BY weight {order}, src, dst) AS r FROM {rows} WHERE src < dst
), both_ways AS MATERIALIZED (SELECT u, v, r FROM ranked UNION ALL SELECT v, u, r FROM ranked),
reach(a, b, top) USING KEY (a, b) AS (
  SELECT * FROM (
    SELECT u, v, r FROM both_ways
    UNION ALL
    SELECT a.u, b.u, 1000000 FROM (SELECT DISTINCT u FROM both_ways) a, (SELECT DISTINCT u FROM both_ways) b
    WHERE a.u <> b.u AND NOT EXISTS (SELECT 1 FROM both_ways e WHERE e.u = a.u AND e.v = b.u)
  )
  UNION
  SELECT x.a, e.v, min(greatest(x.top, e.r)) FROM reach x JOIN both_ways e ON e.u = x.b JOIN recurring.reach k ON k.a = x.a AND k.b = e.v
  WHERE greatest(x.top, e.r) < k.top AND x.a <> e.v GROUP BY x.a, e.v
), tree AS (SELECT t.u, t.v, t.weight FROM ranked t JOIN reach x ON x.a = t.u AND x.b = t.v WHERE x.top = t.r)
"""


@query("spanning_tree", _tree_sql("DESC") + "SELECT u, v, weight FROM tree")
def spanning_tree(spark, d):
    return spanning_forest(nation_graph(spark, d), maximise=True)


@query("spanning_tree_edges", _tree_sql("ASC") + "SELECT u AS src, v AS dst, weight FROM tree UNION ALL SELECT v, u, weight FROM tree")
def spanning_edges(spark, d):
    return spanning_tree_edges(nation_graph(spark, d))


@query("spanning_tree_rounds", _tree_sql("DESC") + "SELECT u, v, weight FROM tree")
def spanning_tree_rounds(spark, d):
    """The same forest by rounds of Boruvka on the executors."""
    return spanning_forest(nation_graph(spark, d), maximise=True, driver_edges=0)


@query(
    "topk_edges",
    f"""WITH {NATIONS}, r AS (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS position FROM nations)
SELECT src, dst, weight, position FROM r WHERE position <= 3""",
)
def topk_edges(spark, d):
    return S.strongest_edges(nation_graph(spark, d), 3)


@query(
    "gumbel_topk",
    f"""WITH {NATIONS} SELECT src, dst, weight FROM nations WHERE src < dst
ORDER BY ln(weight) - ln(-ln((((src * 1000 + dst) * {MULTIPLIER} + 7) % {MODULUS} + 0.5) / {MODULUS})) DESC, src, dst LIMIT 40""",
)
def gumbel_topk(spark, d):
    u = (lcg(F.col("src") * 1000 + F.col("dst"), 7) + F.lit(0.5)) / F.lit(MODULUS)
    return S.gumbel_top_k(nation_graph(spark, d).edges.where("src < dst"), 40, u=u)


@query(
    "neighbour_sparsify",
    _tree_sql("DESC")
    + """, kept AS (
  SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM nations) WHERE k <= 3
  UNION SELECT u, v FROM tree UNION SELECT v, u FROM tree
) SELECT n.src, n.dst, n.weight FROM nations n JOIN kept a ON a.src = n.src AND a.dst = n.dst JOIN kept b ON b.src = n.dst AND b.dst = n.src""",
)
def neighbour_sparsify(spark, d):
    return S.neighbour_sparsify(nation_graph(spark, d), 3).edges


@query("effective_resistance", f"WITH {NATIONS} SELECT CAST(count(DISTINCT src) - 1 AS DOUBLE) AS foster_sum FROM nations")
def effective_resistance(spark, d):
    graph = nation_graph(spark, d)
    total = S.effective_resistance(graph).join(graph.weighted_edges, ["src", "dst"])
    return total.agg(F.round(F.sum(F.col("weight") * F.col("resistance")), 6).alias("foster_sum"))


# In a tree the resistance of an edge is that of the edge alone, which is stored in both directions: two parallel ones.
@query(
    "effective_resistance_tree",
    _tree_sql("DESC") + "SELECT u AS src, v AS dst, round(1 / (2 * weight), 9) AS resistance FROM tree UNION ALL SELECT v, u, round(1 / (2 * weight), 9) FROM tree",
)
def effective_resistance_tree(spark, d):
    graph = nation_graph(spark, d)
    tree = PropertyGraph(materialize(spanning_tree_edges(graph, maximise=True), "tree"), graph.nodes, False)
    return S.effective_resistance(tree).select("src", "dst", F.round("resistance", 9).alias("resistance"))


@query("resistance_sparsify")
def resistance_sparsify(spark, d):
    return S.resistance_sparsify(nation_graph(spark, d), 6).edges


@query(
    "conductance_sparsify",
    _tree_sql(
        "DESC",
        """strengths AS (SELECT src AS id, sum(weight) AS s FROM nations GROUP BY src), scored AS MATERIALIZED (
  SELECT n.src, n.dst, n.weight / least(a.s, b.s) AS weight FROM nations n JOIN strengths a ON a.id = n.src JOIN strengths b ON b.id = n.dst
),""",
        "scored",
    )
    + f""", size AS (SELECT 3 * count(DISTINCT src) AS n FROM nations), others AS (
  SELECT src, dst, row_number() OVER (ORDER BY ln(weight) - ln(-ln({_U})) DESC, src, dst) AS k FROM scored s
  WHERE src < dst AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.u = s.src AND t.v = s.dst)
), chosen AS (
  SELECT u, v FROM tree UNION ALL SELECT src, dst FROM others WHERE k <= (SELECT n FROM size) - (SELECT count(*) FROM tree)
) SELECT n.src, n.dst, n.weight FROM nations n JOIN chosen c ON c.u = least(n.src, n.dst) AND c.v = greatest(n.src, n.dst)""",
)
def conductance_sparsify(spark, d):
    return S.conductance_sparsify(nation_graph(spark, d), 6).edges


@query(
    "relaxed_spanning_tree",
    _tree_sql("DESC")
    + """, best AS (SELECT src AS id, max(weight) AS w FROM nations GROUP BY src), kept AS (
  SELECT t.u, t.v FROM ranked t JOIN reach x ON x.a = t.u AND x.b = t.v JOIN ranked weakest ON weakest.r = x.top
    JOIN best p ON p.id = t.u JOIN best q ON q.id = t.v
  WHERE x.top = t.r OR weakest.weight - 0.1 * (p.w + q.w) < t.weight
) SELECT n.src, n.dst, n.weight FROM nations n JOIN kept k ON k.u = least(n.src, n.dst) AND k.v = greatest(n.src, n.dst)""",
)
def relaxed_spanning_tree(spark, d):
    return S.relaxed_spanning_tree(nation_graph(spark, d), 0.1).edges


@query("hierarchical_sparsify")
def hierarchical_sparsify(spark, d):
    level = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("cluster"))
    return S.hierarchical_sparsify(nation_graph(spark, d), [level], 3, 2).edges


@query(
    "multi_range",
    """SELECT s_suppkey AS id, unnest(range(CAST(s_nationkey AS BIGINT), CAST(2 * s_nationkey AS BIGINT))) AS value FROM supplier""",
)
def multi_range(spark, d):
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("start"), (2 * F.col("s_nationkey")).cast("long").alias("stop")
    )
    return S.multi_range(rows).select("id", "value")


# -- partitions ------------------------------------------------------------------------------------------


@query(
    "partition_index",
    f"WITH {POINTS} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY node) - 1 AS position, node FROM points",
)
def partition_index(spark, d):
    index = C.partition_index(points(spark, d).select("node", "cluster"))
    return index.select("cluster", F.posexplode("nodes").alias("position", "node")).withColumn("position", F.col("position").cast("long"))


@query("cluster_sizes", f"WITH {POINTS} SELECT cluster, count(*) AS size FROM points GROUP BY cluster")
def cluster_sizes(spark, d):
    return C.cluster_sizes(points(spark, d).select("node", "cluster"))


@query(
    "size_histogram",
    f"WITH {POINTS}, s AS (SELECT cluster, count(*) AS size FROM points GROUP BY cluster) SELECT size, count(*) AS n_clusters FROM s GROUP BY size",
)
def size_histogram(spark, d):
    return C.size_histogram(points(spark, d).select("node", "cluster"))


def _covers(graph: PropertyGraph, partition: DataFrame) -> DataFrame:
    """One row of facts that hold for any partition of the graph."""
    return partition.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("node").alias("n_nodes")).withColumn("all_nodes", F.col("n_nodes") == F.lit(graph.num_nodes))


_COVER_SQL = f"WITH {TRADE}, n AS (SELECT count(DISTINCT src) AS n FROM trade) SELECT n AS n_rows, n AS n_nodes, TRUE AS all_nodes FROM n"
_NATION_COVER_SQL = f"WITH {NATIONS}, n AS (SELECT count(DISTINCT src) AS n FROM nations) SELECT n AS n_rows, n AS n_nodes, TRUE AS all_nodes FROM n"


@query("fennel", _COVER_SQL)
def fennel(spark, d):
    graph = stored_trade_graph(spark, d)
    return _covers(graph, C.fennel(graph, 8))


@query(
    "fennel_nations",
    f"""WITH RECURSIVE {NATIONS}, ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS t FROM (SELECT DISTINCT src AS id FROM nations)),
near AS MATERIALIZED (SELECT a.t, list(b.t) AS adj FROM nations n JOIN ids a ON a.id = n.src JOIN ids b ON b.id = n.dst GROUP BY a.t),
price AS MATERIALIZED (SELECT (SELECT count(*) FROM nations) * pow(4, 0.5) / pow(count(*), 1.5) AS price, ceil(1.1 * count(*) / 4) AS cap FROM ids),
steps(t, labels) AS (
  SELECT 0::BIGINT, []::INT[]
  UNION ALL
  SELECT t + 1, list_append(labels, (list_position(score, list_max(score)) - 1)::INT)
  FROM (
    SELECT s.t, s.labels, list_transform(range(4), lambda c: CASE WHEN len(list_filter(s.labels, lambda l: l = c)) >= cap THEN -1e300
      ELSE len(list_filter(adj, lambda j: s.labels[j + 1] = c)) - price * 1.5 * pow(len(list_filter(s.labels, lambda l: l = c)), 0.5) END) AS score
    FROM steps s JOIN near n ON n.t = s.t, price
  )
), done AS (SELECT labels FROM steps ORDER BY t DESC LIMIT 1)
SELECT id AS node, (SELECT labels FROM done)[t + 1]::BIGINT AS cluster FROM ids""",
)
def fennel_nations(spark, d):
    return C.fennel(nation_graph(spark, d), 4)


@query("balanced_cut", _COVER_SQL)
def balanced_cut(spark, d):
    graph = stored_trade_graph(spark, d)
    return _covers(graph, C.balanced_cut(graph, 8, passes=2))


@query("spread_clustering", _NATION_COVER_SQL)
def spread_clustering(spark, d):
    graph = nation_graph(spark, d)
    return _covers(graph, C.spread(graph, 4))


# Every nation's customers and suppliers are a star, and stars are the clusters of highest modularity.
@query("modularity_clusters", f"WITH {HOMES} SELECT id AS node, root AS cluster FROM home_components")
def modularity_clusters(spark, d):
    return C.modularity_clusters(home_graph(spark, d))


@query(
    "label_spread",
    f"WITH {HOMES} SELECT id AS node, home AS cluster FROM home_nodes",
)
def label_spread(spark, d):
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + NATION_BASE).cast("long").alias("node"))
    graph = home_graph(spark, d)
    seeds = nations.join(graph.nodes.withColumnRenamed("id", "node"), "node", "left_semi")
    return C.label_spread(graph, seeds.withColumn("cluster", F.col("node")))


@query("hierarchical_agglomerative", _NATION_COVER_SQL)
def hierarchical_agglomerative(spark, d):
    graph = nation_graph(spark, d)
    return _covers(graph, C.compose_hierarchy(C.hierarchical_agglomerative(graph, C.fennel, [2, 3])))


_HALF = "ntile(2) OVER (PARTITION BY path ORDER BY node) - 1"


@query(
    "hierarchical_divisive_halves",
    f"""WITH {NATIONS}, one AS (SELECT node, CAST(ntile(2) OVER (ORDER BY node) - 1 AS VARCHAR) AS path FROM (SELECT DISTINCT src AS node FROM nations)),
two AS (SELECT node, CASE WHEN n > 4 THEN path || '/' || half ELSE path END AS path FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, {_HALF} AS half FROM one)),
three AS (SELECT node, CASE WHEN n > 4 THEN path || '/' || half ELSE path END AS path FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, {_HALF} AS half FROM two))
SELECT node, path FROM three""",
)
def hierarchical_divisive_halves(spark, d):
    """Division by a method that SQL has too: the lower and the upper half of the ids."""

    def halves(graph: PropertyGraph, k: int) -> DataFrame:
        # The ids of one small graph.
        ids = Window.partitionBy().orderBy("id")
        return graph.nodes.select(F.col("id").alias("node"), (F.ntile(k).over(ids) - 1).cast("long").alias("cluster"))

    return C.hierarchical_divisive(nation_graph(spark, d), halves, 4)


@query("hierarchical_divisive")
def hierarchical_divisive(spark, d):
    return C.hierarchical_divisive(nation_graph(spark, d), C.fennel, 8)


# The same three over the part-supplier graph, where their size matters.


@query("spread_clustering_trade", _COVER_SQL)
def spread_clustering_trade(spark, d):
    graph = stored_trade_graph(spark, d)
    return _covers(graph, C.spread(graph, 8))


@query("hierarchical_agglomerative_trade", _COVER_SQL)
def hierarchical_agglomerative_trade(spark, d):
    graph = stored_trade_graph(spark, d)
    return _covers(graph, C.compose_hierarchy(C.hierarchical_agglomerative(graph, C.fennel, [4, 8])))


@query("hierarchical_divisive_trade", _COVER_SQL)
def hierarchical_divisive_trade(spark, d):
    graph = stored_trade_graph(spark, d)
    return _covers(graph, C.hierarchical_divisive(graph, C.fennel, 3000))


@query("merge_small_clusters")
def merge_small_clusters(spark, d):
    graph = nation_graph(spark, d)
    regions = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("cluster"))
    return C.merge_small_clusters(graph, regions.join(graph.nodes.withColumnRenamed("id", "node"), "node", "left_semi"), 8)


# -- patches from graphs -------------------------------------------------------------------------------------


@query(
    "rolling_window_graph",
    """SELECT a.range AS i, b.range AS j FROM range(100) a, range(100) b WHERE abs(a.range - b.range) BETWEEN 1 AND 3""",
)
def rolling_window_graph(spark, d):
    return P.rolling_window_graph(spark, 100, 4)


@query(
    "create_patch_data",
    f"WITH {TRADE}, n AS (SELECT count(DISTINCT src) AS n FROM trade) SELECT n AS n_nodes, TRUE AS overlaps_reached FROM n",
)
def create_patch_data(spark, d):
    graph = trade_graph(spark, d)
    # Read several times from here on, so it is written once.
    graph = PropertyGraph(materialize(graph.edges, "trade-edges"), materialize(graph.nodes, "trade-nodes"), directed=False)
    partition = graph.nodes.select(F.col("id").alias("node"), F.pmod("id", F.lit(10)).alias("cluster"))
    patches, edges = P.create_patch_data(graph, partition, min_overlap=10, target_overlap=20, mean_degree=4)
    a = patches.select(F.col("patch_id").alias("i"), "node")
    b = patches.select(F.col("patch_id").alias("j"), "node")
    shared = a.join(b, "node").where("i <> j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    poor = edges.join(shared, ["i", "j"], "left").where(F.coalesce("n", F.lit(0)) < 10)
    return patches.agg(F.countDistinct("node").alias("n_nodes")).withColumn("overlaps_reached", F.lit(poor.isEmpty()))


# -- temporal tables and files ----------------------------------------------------------------------------------


def _edges(spark, d) -> DataFrame:
    return table(spark, d, "edge_df").where("timestamp is not null").withColumn("timestamp", F.date_trunc("day", "timestamp").cast("timestamp_ntz"))


_DAYS = """days AS MATERIALIZED (
  SELECT date_trunc('day', "timestamp")::TIMESTAMP AS "timestamp", src, dst, edge_feature_0 FROM edge_df WHERE "timestamp" IS NOT NULL
)"""


@query(
    "snapshot_edges",
    f"""WITH {_DAYS} SELECT "timestamp", src, dst, first(edge_feature_0 ORDER BY edge_feature_0 NULLS FIRST) AS edge_feature_0
FROM days WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3""",
)
def snapshot_edges(spark, d):
    return convert.coalesced_edges(_edges(spark, d).drop("loaded_at"))


@query(
    "snapshot_counts",
    f"""WITH {_DAYS}, e AS (SELECT DISTINCT "timestamp", src, dst FROM days WHERE src IS NOT NULL AND dst IS NOT NULL)
SELECT a."timestamp", a.n_edges, b.n_nodes FROM (SELECT "timestamp", count(*) AS n_edges FROM e GROUP BY 1) a
JOIN (SELECT "timestamp", count(DISTINCT id) AS n_nodes FROM (SELECT "timestamp", src AS id FROM e UNION ALL SELECT "timestamp", dst FROM e) GROUP BY 1) b
ON a."timestamp" = b."timestamp" """,
)
def snapshot_counts(spark, d):
    return convert.snapshot_counts(_edges(spark, d))


@query(
    "temporal_stats",
    f"""WITH {_DAYS}, e AS (SELECT * FROM days WHERE src IS NOT NULL AND dst IS NOT NULL)
SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_nodes, count(DISTINCT (src, dst)) AS n_edges,
  count(*) AS n_temporal_edges, min("timestamp") AS earliest, max("timestamp") AS latest FROM e""",
)
def temporal_stats(spark, d):
    return convert.temporal_statistics(_edges(spark, d).where("src is not null and dst is not null"))


@query(
    "snapshots_to_frames",
    f"""WITH {_DAYS}, e AS (SELECT DISTINCT "timestamp", src, dst FROM days WHERE src IS NOT NULL AND dst IS NOT NULL) SELECT "timestamp", src, dst FROM e""",
)
def snapshots_to_frames(spark, d):
    edges, _ = convert.frames_by_date(_edges(spark, d).select("timestamp", "src", "dst"))
    return edges.select("timestamp", "src", "dst")


@query(
    "previous_snapshot",
    f"""WITH {_DAYS} SELECT "timestamp", lag("timestamp") OVER (ORDER BY "timestamp") AS previous FROM (SELECT DISTINCT "timestamp" FROM days)""",
)
def previous_snapshot(spark, d):
    return convert.previous_snapshot(_edges(spark, d))


@query(
    "snapshot_nodes",
    f"""WITH {_DAYS} SELECT DISTINCT "timestamp", src AS id FROM days""",
)
def snapshot_nodes(spark, d):
    return files.snapshot_nodes(_edges(spark, d))


@query(
    "first_node_features",
    """WITH r AS (SELECT id, node_feature_0, node_feature_1, y, row_number() OVER (PARTITION BY id
  ORDER BY "timestamp" NULLS FIRST, node_feature_0 NULLS FIRST, node_feature_1 NULLS FIRST, y NULLS FIRST) AS k FROM node_df WHERE id IS NOT NULL)
SELECT id, node_feature_0, node_feature_1, y FROM r WHERE k = 1""",
)
def first_node_features(spark, d):
    return convert.first_node_features(table(spark, d, "node_df"))


@query("graph_round_trip", f"WITH {NATIONS} SELECT src, dst, weight FROM nations")
def graph_round_trip(spark, d):
    path = scratch_path(spark, "graph")
    files.save_graph(nation_graph(spark, d), path)
    return files.load_graph(spark, path).edges


@query(
    "snapshot_ingest",
    r"""WITH raw AS (
  SELECT CAST(regexp_extract(file_name, 'as(\d{8})\.txt$', 1) AS BIGINT) AS snapshot,
         string_split(regexp_replace(content, '^' || chr(65279), ''), chr(10)) AS lines
  FROM raw_file WHERE regexp_matches(file_name, '(^|/)as\d{8}\.txt$')
), clean AS (SELECT snapshot, rtrim(unnest(lines), chr(13)) AS line FROM raw)
SELECT snapshot, CAST(regexp_extract(line, '^[ \t]*(\d+)[ \t]+(\d+)[ \t]*$', 1) AS BIGINT) - 1 AS src, count(*) AS n_rows
FROM clean WHERE regexp_full_match(line, '[ \t]*\d+[ \t]+\d+[ \t]*') GROUP BY 1, 2""",
)
def snapshot_ingest(spark, d):
    """Raw records counted per snapshot and source, repeats included."""
    from tessera.sources.compaction import raw_records

    return raw_records(table(spark, d, "raw_file")).groupBy("snapshot", "src").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "streamed_snapshot_counts",
    """SELECT date_trunc('day', "timestamp")::TIMESTAMP AS window_start, count(*) AS n_edges
FROM edge_df WHERE "timestamp" IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1""",
)
def streamed_snapshot_counts(spark, d):
    schema = table(spark, d, "edge_df").schema
    stream = edge_stream(spark, f"{d}/edge_df.parquet*", schema)
    run_once(windowed_counts(stream), "streamed_snapshots")
    return spark.table("streamed_snapshots").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_edges")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
