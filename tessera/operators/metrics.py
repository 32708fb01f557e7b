"""How good an alignment or an embedding is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import vec_distance, vec_dot
from tessera.graph import PropertyGraph
from tessera.operators.pair_stats import pair_statistics


def procrustes_error(a: DataFrame, b: DataFrame, dim: int) -> float | None:
    """Disparity of two embeddings after the best shift, scale and rotation, in [0, 1].

    Nodes in both count.  None if they share none, or all shared nodes of one
    embedding lie in a point.
    """
    both = a.select(F.lit(0).alias("patch_id"), "node", "coords").unionByName(b.select(F.lit(1).alias("patch_id"), "node", "coords"))
    s = pair_statistics(both, dim)
    if not len(s.n):
        return None
    size = np.sqrt(np.trace(s.s_i[0]) * np.trace(s.s_j[0]))
    if size <= 0:
        return None
    fit = np.linalg.svd(s.cov[0], compute_uv=False).sum() / size
    return float(max(0.0, 1 - fit**2))


def local_error(reference: DataFrame, embedding: DataFrame) -> DataFrame:
    """``node, error``: distance of each node's coordinates from the reference."""
    return reference.select("node", F.col("coords").alias("r")).join(embedding.select("node", F.col("coords").alias("c")), "node").select(
        "node", vec_distance(F.col("r"), F.col("c")).alias("error")
    )


def transform_error(entries: DataFrame, patch: str = "patch_id", position: str = "position", value: str = "value") -> float | None:
    """Mean over the entries of a transform of their population deviation over patches."""
    return entries.groupBy(position).agg(F.stddev_pop(value).alias("s")).agg(F.avg("s")).first()[0]


def deviation(values: np.ndarray) -> float:
    """The same of an array with one transform per patch."""
    return float(np.std(np.asarray(values, float), axis=0).mean())


def orthogonal_mse(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared difference of two sets of rotations after the best common one."""
    mean = np.einsum("pij,pik->jk", a, b) / len(a)
    return float(2 * (a.shape[1] - np.linalg.svd(mean, compute_uv=False).sum()))


def auc(scores: DataFrame, score: str = "score", label: str = "label") -> float | None:
    """Area under the ROC curve, ties counting half.

    Scores are counted per value; cumulative counts come from range partitions,
    so no window holds all rows.  None without both labels.
    """
    from tessera.session import materialize

    counts = scores.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")
    )
    ordered = materialize(counts.repartitionByRange("s").sortWithinPartitions("s"), "auc")
    placed = ordered.select("s", "pos", "neg", F.col("_metadata.file_name").alias("f"))
    # One row per file of the table just written.
    totals = placed.groupBy("f").agg(F.sum("neg").alias("t"))
    before = totals.select("f", F.coalesce(F.sum("t").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(before), "f")
    row = ranked.agg(
        F.sum((F.col("pos") * (F.col("base") + F.col("below") + F.col("neg") / 2)).cast("double")), F.sum("pos"), F.sum("neg")
    ).first()
    return None if not row[1] or not row[2] else float(row[0]) / (float(row[1]) * float(row[2]))


def edge_scores(embedding: DataFrame, pairs: DataFrame, distance: bool = False) -> DataFrame:
    """``pairs`` with ``score``: sigmoid of the inner product, or exp of minus the distance."""
    a = embedding.select(F.col("node").alias("src"), F.col("coords").alias("a"))
    b = embedding.select(F.col("node").alias("dst"), F.col("coords").alias("b"))
    score = F.exp(-vec_distance(F.col("a"), F.col("b"))) if distance else 1 / (1 + F.exp(-vec_dot(F.col("a"), F.col("b"))))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", score).drop("a", "b")


def reconstruction_auc(embedding: DataFrame, graph: PropertyGraph, max_samples: int = 1_000_000, distance: bool = False, seed: int = 1) -> float | None:
    """AUC of the scores of edges against as many non-edges.

    All edges count up to ``max_samples``; beyond, that many are drawn with
    replacement.  That cap is the measure's own sample size.
    """
    edges = graph.edges.select("src", "dst")
    n = graph.num_edges
    if n > max_samples:
        edges, n = graph.sample_edges(max_samples, seed).select("src", "dst"), max_samples
    others = graph.sample_non_edges(n, seed + 1).select("src", "dst")
    pairs = edges.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))
    return auc(edge_scores(embedding, pairs, distance))


def noise_profile(problem_factories: dict, points: DataFrame, patches: DataFrame, dim: int, levels: list[float], add_noise, scale: bool = False) -> pd.DataFrame:
    """``noise, method, error``: Procrustes error against the points for each noise level and aligner."""
    rows = []
    for level in levels:
        noisy = add_noise(patches, level)
        for name, factory in problem_factories.items():
            embedding = factory(noisy).get_aligned_embedding(scale=scale)
            rows.append((level, name, procrustes_error(points, embedding, dim)))
    return pd.DataFrame(rows, columns=["noise", "method", "error"])
