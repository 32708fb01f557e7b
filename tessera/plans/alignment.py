"""Queries of patches, alignment, embedding and measures over the test tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import register_sql_functions, vec_distance, vec_mean, vec_median
from tessera.graph import PropertyGraph
from tessera.operators import metrics as M
from tessera.operators.affine import Frames, apply_frames, mean_patches
from tessera.operators.alignment import get_aligner
from tessera.operators.embedding import AutoEncoder, bipartite_svd, distance_scores, patch_embeddings
from tessera.operators.pair_stats import node_multiplicity, pair_coordinates, patch_coordinates, node_patches, overlap_counts, pair_statistics, patch_degrees
from tessera.operators.patches import create_patch_data, patch_subgraphs, voronoi_patches
from tessera.operators.synchronise import relative_scale
from tessera.operators.synthetic import add_noise
from tessera.plans.fixtures import DIM, NATIONS, POINTS, RING_SQL, TRADE, USABLE, flat, flat_sql, nation_graph, points, ring_frames, ring_members, ring_patches, table, trade_graph, usable_patches
from tessera.session import materialize, scratch_path
from tessera.sources import files

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


# -- overlaps of patches -----------------------------------------------------------------------


@query(
    "patch_overlap_counts",
    f"WITH {USABLE} SELECT a.patch_id AS i, b.patch_id AS j, count(*) AS n_overlap FROM usable a JOIN usable b ON a.node = b.node AND a.patch_id <> b.patch_id GROUP BY 1, 2",
)
def patch_overlap_counts(spark, d):
    return overlap_counts(usable_patches(spark, d))


@query(
    "patch_degrees",
    f"""WITH {USABLE}, pairs AS (SELECT DISTINCT a.patch_id AS i, b.patch_id AS j FROM usable a JOIN usable b ON a.node = b.node AND a.patch_id <> b.patch_id)
SELECT i AS patch_id, count(*) AS degree FROM pairs GROUP BY i""",
)
def degrees(spark, d):
    return patch_degrees(overlap_counts(usable_patches(spark, d)))


@query(
    "node_multiplicity",
    f"WITH {USABLE}, n AS (SELECT node, count(*) AS n_patches FROM usable GROUP BY node) SELECT n_patches, count(*) AS n_nodes FROM n GROUP BY 1",
)
def multiplicity(spark, d):
    return node_multiplicity(usable_patches(spark, d))


@query(
    "node_patches",
    f"WITH {USABLE} SELECT node, row_number() OVER (PARTITION BY node ORDER BY patch_id) - 1 AS position, patch_id FROM usable",
)
def patches_of_nodes(spark, d):
    return node_patches(usable_patches(spark, d)).select("node", F.posexplode("patch_ids").alias("position", "patch_id")).withColumn(
        "position", F.col("position").cast("long")
    )


@query(
    "relative_scale",
    """SELECT a.range AS i, b.range AS j, round((1 + a.range / 4.0) / (1 + b.range / 4.0), 6) AS ratio
FROM range(10) a, range(10) b WHERE b.range = (a.range + 1) % 10 AND a.range < b.range OR a.range = 0 AND b.range = 9""",
)
def scale_ratio(spark, d):
    s = pair_statistics(ring_patches(spark, d), DIM)
    ratio = relative_scale(np.trace(s.s_i, axis1=1, axis2=2), np.trace(s.s_j, axis1=1, axis2=2))
    rows = [(int(s.ids[i]), int(s.ids[j]), round(float(r), 6)) for i, j, r in zip(s.i, s.j, ratio)]
    return spark.createDataFrame(rows, "i long, j long, ratio double")


@query(
    "relative_translation",
    f"""WITH {USABLE} SELECT a.patch_id AS i, b.patch_id AS j, {', '.join(f'round(sum(a.coords[{k + 1}] - b.coords[{k + 1}]), 6) + 0.0 AS c{k}' for k in range(DIM))}
FROM usable a JOIN usable b ON a.node = b.node AND a.patch_id < b.patch_id GROUP BY 1, 2""",
)
def relative_translation(spark, d):
    s = pair_statistics(usable_patches(spark, d), DIM)
    # Sums instead of means: they have as many decimals as the coordinates, so rounding meets no ties.
    total = (s.mean_i - s.mean_j) * s.n[:, None]
    rows = [(int(s.ids[i]), int(s.ids[j]), *[round(float(x), 6) + 0.0 for x in t]) for i, j, t in zip(s.i, s.j, total)]
    return spark.createDataFrame(rows, "i int, j int, " + ", ".join(f"c{k} double" for k in range(DIM)))


@query(
    "pair_intersections",
    f"""WITH {USABLE}, pairs AS (
  SELECT a.patch_id AS i, b.patch_id AS j, node, round(list_distance(a.coords, b.coords), 6) AS distance, count(*) OVER (PARTITION BY a.patch_id, b.patch_id) AS n
  FROM usable a JOIN usable b USING (node) WHERE a.patch_id < b.patch_id
) SELECT i, j, node, distance FROM pairs WHERE n >= 5""",
)
def pair_intersections(spark, d):
    pairs = pair_coordinates(usable_patches(spark, d), 5)
    return pairs.select("i", "j", "node", F.round(vec_distance(F.col("coords_i"), F.col("coords_j")), 6).alias("distance"))


@query(
    "coordinate_lookup",
    f"""WITH {USABLE}, asked AS (SELECT patch_id + 1 AS patch_id, node FROM usable)
SELECT a.patch_id, a.node, round(u.coords[1], 6) + 0.0 AS c0 FROM asked a LEFT JOIN usable u ON u.patch_id = a.patch_id AND u.node = a.node""",
)
def coordinate_lookup(spark, d):
    patches = usable_patches(spark, d)
    asked = patches.select((F.col("patch_id") + 1).alias("patch_id"), "node")
    return patch_coordinates(patches, asked).select("patch_id", "node", *flat(dim=1, digits=6))


@query("noise_profile", "SELECT TRUE AS exact_without_noise, TRUE AS grows_with_noise")
def noise_profile(spark, d):
    truth = points(spark, d).select("node", "coords")
    methods = {name: (lambda p, name=name: get_aligner(name, p, dim=DIM)) for name in ("sync", "weighted")}
    table = M.noise_profile(methods, truth, materialize(ring_members(spark, d), "ring"), DIM, [0.0, 0.5], add_noise)
    least, most = table[table["noise"] == 0]["error"].max(), table[table["noise"] > 0]["error"].min()
    return spark.createDataFrame([(bool(least < 1e-9), bool(most > least))], "exact_without_noise boolean, grows_with_noise boolean")


# -- embeddings from aligned patches ---------------------------------------------------------------


@query(
    "mean_embedding",
    f"WITH {USABLE} SELECT node, {', '.join(f'round(avg(coords[{k + 1}]), 9) + 0.0 AS c{k}' for k in range(DIM))} FROM usable GROUP BY node",
)
def mean_of_patches(spark, d):
    return usable_patches(spark, d).groupBy("node").agg(vec_mean(F.col("coords"), DIM).alias("coords")).select("node", *flat(digits=9))


@query(
    "median_embedding",
    f"WITH {USABLE} SELECT node, {', '.join(f'round(median(coords[{k + 1}]), 9) + 0.0 AS c{k}' for k in range(DIM))} FROM usable GROUP BY node",
)
def median_of_patches(spark, d):
    return usable_patches(spark, d).groupBy("node").agg(vec_median(F.col("coords"), DIM).alias("coords")).select("node", *flat(digits=9))


_TRUTH = f"WITH {POINTS} SELECT node, {flat_sql()} FROM points"


def _aligned(name: str, spark, d, **kwargs) -> DataFrame:
    problem = get_aligner(name, ring_patches(spark, d), dim=DIM, **kwargs)
    return problem.get_aligned_embedding(scale=True, frame_of=0).select("node", *flat())


@query("aligned_embedding", _TRUTH)
def aligned_embedding(spark, d):
    return _aligned("sync", spark, d)


@query("aligned_embedding_weighted", _TRUTH)
def aligned_embedding_weighted(spark, d):
    return _aligned("weighted", spark, d)


@query("aligned_embedding_svd", _TRUTH)
def aligned_embedding_svd(spark, d):
    return _aligned("svd", spark, d)


_WHOLE = 64
_WHOLE_POINTS = POINTS.replace("embedding[1:8]", "embedding")
_WHOLE_TRUTH = f"WITH {_WHOLE_POINTS} SELECT node, {flat_sql(dim=_WHOLE)} FROM points"


@query("aligned_embedding_whole", _WHOLE_TRUTH)
def aligned_embedding_whole(spark, d):
    """All 64 dimensions, in three patches that share enough nodes for them."""
    problem = get_aligner("sync", ring_patches(spark, d, _WHOLE, 3), dim=_WHOLE)
    return problem.get_aligned_embedding(scale=True, frame_of=0).select("node", *flat(dim=_WHOLE))


@query("aligned_embedding_median", _TRUTH)
def aligned_embedding_median(spark, d):
    problem = get_aligner("sync", ring_patches(spark, d), dim=DIM).align_patches(scale=True)
    return problem.median_embedding(frame_of=0).select("node", *flat())


@query(
    "sync_scales",
    "SELECT range AS patch_id, round((1 + range / 4.0) / avg(1 + range / 4.0) OVER (), 9) AS scale FROM range(10)",
)
def sync_scales(spark, d):
    problem = get_aligner("sync", ring_patches(spark, d), dim=DIM)
    rows = [(int(p), round(float(s), 9)) for p, s in zip(problem.start.ids, problem.synchronised_scales())]
    return spark.createDataFrame(rows, "patch_id long, scale double")


_RING_TRUTH = f"WITH {RING_SQL} SELECT patch_id, node, {flat_sql()} FROM ring"


def _moved_ring(spark, d, rotated: bool) -> DataFrame:
    """The ring's patches either rotated or shifted, and nothing else."""
    f, still = ring_frames(), Frames.identity(ring_frames().ids, DIM)
    return apply_frames(ring_members(spark, d), Frames(f.ids, still.scale, f.rot if rotated else still.rot, still.shift if rotated else f.shift))


@query("sync_rotations", _RING_TRUTH)
def sync_rotations(spark, d):
    """Every row of every patch, turned back by the synchronised rotations."""
    problem = get_aligner("sync", _moved_ring(spark, d, True), dim=DIM).rotate_patches()
    return problem.aligned_patches(frame_of=0).select("patch_id", "node", *flat())


@query("sync_translations", _RING_TRUTH)
def sync_translations(spark, d):
    problem = get_aligner("sync", _moved_ring(spark, d, False), dim=DIM).translate_patches()
    return problem.aligned_patches(frame_of=0).select("patch_id", "node", *flat())


_RING_RECOVERED = f"WITH {RING_SQL} SELECT patch_id, count(*) AS n_nodes, CAST(0 AS DOUBLE) AS worst FROM ring GROUP BY patch_id"


def _worst(spark, d, problem) -> DataFrame:
    """How far the aligned rows of each patch are from the known ones at most, to two digits."""
    truth = ring_members(spark, d).select("patch_id", "node", F.col("coords").alias("truth"))
    off = vec_distance(F.col("coords"), F.col("truth"))
    rows = problem.aligned_patches(frame_of=0).join(truth, ["patch_id", "node"]).groupBy("patch_id")
    return rows.agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.max(off), 2).alias("worst"))


@query("learned_affine_alignment", _RING_RECOVERED)
def learned_affine(spark, d):
    problem = get_aligner("geo", _moved_ring(spark, d, True), dim=DIM, num_epochs=6_000, learning_rate=0.005).align_patches()
    return _worst(spark, d, problem)


@query("learned_orthogonal_alignment", _RING_RECOVERED)
def learned_orthogonal(spark, d):
    problem = get_aligner("geo", _moved_ring(spark, d, True), dim=DIM, kind="orthogonal", num_epochs=6_000, learning_rate=0.005).align_patches()
    return _worst(spark, d, problem)


_COMPOSED = f"""WITH {RING_SQL} SELECT patch_id, node, {', '.join(f'round((coords[{k + 1}] * 2 + 1) * 3 - patch_id, 6) + 0.0 AS c{k}' for k in range(DIM))} FROM ring"""


@query("lazy_affine_compose", _COMPOSED)
def lazy_affine_compose(spark, d):
    one = np.ones((10, DIM))
    frames = Frames.identity(list(range(10)), DIM).scaled(np.full(10, 2.0)).translated(one).scaled(np.full(10, 3.0))
    frames = frames.translated(-np.arange(10.0)[:, None] * one)
    return apply_frames(ring_members(spark, d), frames).select("patch_id", "node", *flat(digits=6))


@query(
    "mean_aggregator",
    f"WITH {USABLE} SELECT CAST(patch_id // 4 AS INTEGER) AS patch_id, node, {', '.join(f'round(avg(coords[{k + 1}]), 9) + 0.0 AS c{k}' for k in range(DIM))} FROM usable GROUP BY 1, 2",
)
def mean_aggregator(spark, d):
    patches = usable_patches(spark, d)
    grouping = patches.select("patch_id", F.floor(F.col("patch_id") / 4).alias("super_patch")).distinct()
    return mean_patches(patches, grouping, DIM).select("patch_id", "node", *flat(digits=9))


@query(
    "patches_json_round_trip",
    f"WITH {USABLE} SELECT patch_id, node, {flat_sql(digits=6)} FROM usable",
)
def patches_json_round_trip(spark, d):
    path = files.save_patches(usable_patches(spark, d), scratch_path(spark, "patches"))
    return files.load_patches(spark, path).select("patch_id", "node", *flat(digits=6))


@query("embedding_json_round_trip", _WHOLE_TRUTH)
def embedding_json_round_trip(spark, d):
    path = files.save_embedding(points(spark, d, _WHOLE), scratch_path(spark, "embedding"))
    return files.load_embedding(spark, path).select("node", *flat(dim=_WHOLE))


# -- measures ---------------------------------------------------------------------------------------------


@query("procrustes_error", "SELECT TRUE AS equal_after_alignment, TRUE AS noise_seen")
def procrustes(spark, d):
    members = ring_patches(spark, d).where("patch_id = 3").select("node", "coords")
    truth = points(spark, d)
    same = M.procrustes_error(truth, members, DIM)
    noisy = add_noise(members.withColumn("patch_id", F.lit(0)), 1.0).select("node", "coords")
    return spark.createDataFrame([(same < 1e-9, M.procrustes_error(truth, noisy, DIM) > 1e-4)], "equal_after_alignment boolean, noise_seen boolean")


@query(
    "local_error",
    f"""WITH {USABLE}, m AS (SELECT node, [{', '.join(f'avg(coords[{k + 1}])' for k in range(DIM))}] AS mean FROM usable GROUP BY node),
f AS (SELECT node, arg_min(coords, patch_id) AS coords FROM usable GROUP BY node)
SELECT node, round(list_distance(mean, coords), 5) AS error FROM m JOIN f USING (node)""",
)
def local_error(spark, d):
    patches = usable_patches(spark, d)
    mean = patches.groupBy("node").agg(vec_mean(F.col("coords"), DIM).alias("coords"))
    first = patches.groupBy("node").agg(F.min(F.struct("patch_id", "coords")).alias("f")).select("node", F.col("f.coords").alias("coords"))
    return M.local_error(mean, first).withColumn("error", F.round("error", 5))


@query(
    "transform_error",
    f"""WITH {USABLE}, e AS (SELECT patch_id, unnest(range(1, {DIM + 1})) AS position, coords FROM usable),
m AS (SELECT patch_id, position, avg(coords[position]) AS value FROM e GROUP BY 1, 2),
s AS (SELECT stddev_pop(value) AS s FROM m GROUP BY position) SELECT round(avg(s), 6) AS error FROM s""",
)
def transform_error(spark, d):
    entries = usable_patches(spark, d).select("patch_id", F.posexplode("coords").alias("position", "v"))
    means = entries.groupBy("patch_id", "position").agg(F.avg("v").alias("value"))
    return spark.createDataFrame([(round(M.transform_error(means), 6),)], "error double")


_PAIRS = f"""WITH {_WHOLE_POINTS}, pairs AS (
  SELECT a.node AS src, b.node AS dst, a.coords AS x, b.coords AS y, CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END AS label
  FROM points a JOIN points b ON b.node = a.node + 1
)"""


def _pairs(spark, d) -> DataFrame:
    a = points(spark, d).select(F.col("node").alias("src"), F.col("cluster").alias("a"))
    b = points(spark, d).select(F.col("node").alias("dst"), F.col("cluster").alias("b"))
    return a.join(b, F.col("dst") == F.col("src") + 1).select("src", "dst", (F.col("a") == F.col("b")).cast("int").alias("label"))


@query("distance_decoder", _PAIRS + " SELECT src, dst, round(exp(-list_distance(x, y)), 9) AS score FROM pairs")
def distance_decoder(spark, d):
    scores = distance_scores(points(spark, d, _WHOLE).select("node", "coords"), _pairs(spark, d).select("src", "dst"))
    return scores.withColumn("score", F.round("score", 9))


@query(
    "auc_of_scores",
    _PAIRS
    + """, s AS (SELECT label, round(list_distance(x, y), 1) AS score FROM pairs),
c AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY score),
w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9) AS auc FROM w""",
)
def auc_of_scores(spark, d):
    scores = distance_scores(points(spark, d, _WHOLE).select("node", "coords"), _pairs(spark, d), raw=True)
    value = M.auc(scores.withColumn("score", F.round("score", 1)))
    return spark.createDataFrame([(round(value, 9),)], "auc double")


@query("reconstruction_auc")
def reconstruction_auc(spark, d):
    graph = nation_graph(spark, d)
    config = AutoEncoder(model="GAE", dim=8, hidden=16, epochs=60, rate=0.02)
    one = F.lit(0).alias("patch_id")
    embedding = materialize(patch_embeddings(graph.edges.select(one, "src", "dst"), graph.nodes.select(one, "id"), config), "nations").select("node", "coords")
    # Nations trade with all others, so the non-edges are those of the graph's own strongest links.
    strongest = PropertyGraph(graph.edges.where("weight > 0").groupBy("src").agg(F.max_by("dst", "weight").alias("dst")).select("src", "dst"), graph.nodes)
    return spark.createDataFrame([(M.reconstruction_auc(embedding, strongest),)], "auc double")


# -- models -------------------------------------------------------------------------------------------------


@query("gae_patch_embedding", f"WITH {NATIONS} SELECT CAST(count(DISTINCT src) AS BIGINT) AS n_nodes, 2 AS dim, TRUE AS loss_fell FROM nations")
def gae_patch_embedding(spark, d):
    graph = nation_graph(spark, d)
    patches = graph.nodes.select(F.lit(0).alias("patch_id"), F.col("id").alias("node"))
    edges, nodes = patch_subgraphs(graph, patches)
    z = patch_embeddings(edges.drop("weight"), nodes, AutoEncoder(model="VGAE", dim=2, hidden=16, epochs=120, rate=0.02, patience=200))
    return z.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(F.size("coords")).alias("dim"), (F.max("loss_last") < F.max("loss_first")).alias("loss_fell")
    )


@query("gae_patch_embedding_trade", f"WITH {TRADE}, n AS (SELECT count(DISTINCT src) AS n FROM trade) SELECT n AS n_nodes, 10 AS n_patches, 2 AS dim, TRUE AS loss_fell FROM n")
def gae_patch_embedding_trade(spark, d):
    """One model per patch of the part-supplier graph."""
    graph = trade_graph(spark, d)
    graph = PropertyGraph(materialize(graph.edges, "trade-edges"), materialize(graph.nodes, "trade-nodes"), directed=False)
    partition = graph.nodes.select(F.col("id").alias("node"), F.pmod("id", F.lit(10)).alias("cluster"))
    patches, _ = create_patch_data(graph, partition, min_overlap=10, target_overlap=20, mean_degree=4)
    edges, nodes = patch_subgraphs(graph, patches)
    z = patch_embeddings(edges.drop("weight"), nodes, AutoEncoder(model="VGAE", dim=2, hidden=16, epochs=120, rate=0.02, patience=200))
    return z.agg(
        F.countDistinct("node").alias("n_nodes"),
        F.countDistinct("patch_id").cast("int").alias("n_patches"),
        F.max(F.size("coords")).alias("dim"),
        F.min(F.col("loss_last") < F.col("loss_first")).alias("loss_fell"),
    )


@query("bipartite_svd", "SELECT 4 AS k, TRUE AS ascending, TRUE AS below_one")
def spectral(spark, d):
    # From the items: in the graph, parts beyond SUPPLIER_BASE have the ids of suppliers.
    bought = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"))
    entries = bought.where("row is not null and col is not null").distinct().withColumn("value", F.lit(1.0))
    rows, columns, values = bipartite_svd(entries, 4)
    return spark.createDataFrame([(len(values), bool((np.diff(values) >= 0).all()), bool((values < 1 + 1e-9).all()))], "k int, ascending boolean, below_one boolean")


@query(
    "voronoi_patches",
    f"WITH {POINTS} SELECT count(*) AS n_nodes, TRUE AS connected FROM points",
)
def voronoi(spark, d):
    cloud = materialize(points(spark, d, 2).select("node", "coords"), "points")
    patches = voronoi_patches(cloud, 2, 6, 1.2, min_overlap=5, min_size=20, min_degree=2)
    problem = get_aligner("sync", cloud.join(patches, "node").select("patch_id", "node", "coords"), dim=2, min_overlap=5)
    return patches.agg(F.countDistinct("node").alias("n_nodes")).withColumn("connected", F.lit(len(problem.start.ids) == 6))


@query(
    "sql_vector_functions",
    f"WITH {_WHOLE_POINTS} SELECT node, round(list_dot_product(coords, coords), 6) AS dot, round(sqrt(list_dot_product(coords, coords)), 6) AS norm FROM points",
)
def sql_vector_functions(spark, d):
    register_sql_functions(spark)
    return points(spark, d, _WHOLE).selectExpr("node", "round(vec_dot(coords, coords), 6) AS dot", "round(vec_norm(coords), 6) AS norm")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
