"""Test clouds, random frames and noise, all with explicit seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import gaussian, uniform
from tessera.operators.affine import Frames


def cluster_points(spark: SparkSession, dim: int, n_clusters: int = 5, max_size: int = 2000, std: float = 0.2, seed: int = 1) -> DataFrame:
    """``node, coords, cluster``: Gaussian clusters around points of the unit sphere, of random sizes up to ``max_size``."""
    if dim < 2:
        raise ValueError("dim must be at least 2")
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    ends = np.cumsum(rng.integers(max(1, max_size // 2), max_size + 1, n_clusters))
    cluster = F.lit(0)
    for c, end in enumerate(ends[:-1], 1):
        cluster = F.when(F.col("node") >= int(end), F.lit(c)).otherwise(cluster)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    rows = spark.range(int(ends[-1])).withColumnRenamed("id", "node").withColumn("cluster", cluster)
    coords = [F.get(F.get(table, F.col("cluster")), F.lit(k)) + F.lit(std) * gaussian(seed + 17 * k, F.col("node")) for k in range(dim)]
    return rows.select("node", F.array(*coords).alias("coords"), "cluster")


def random_orthogonal(dim: int, rng: np.random.Generator) -> np.ndarray:
    """Uniformly distributed, reflections included."""
    q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def random_scales(n: int, lo: float = 0.1, hi: float = 10.0, seed: int = 1) -> np.ndarray:
    """Log-uniform factors."""
    return np.exp(np.random.default_rng(seed).uniform(np.log(lo), np.log(hi), n))


def random_rotations(n: int, dim: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([random_orthogonal(dim, rng) for _ in range(n)])


def random_shifts(n: int, dim: int, size: float = 100.0, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).normal(scale=size, size=(n, dim))


def random_frames(ids: list[int], dim: int, seed: int = 1, scale: bool = True, keep_first: bool = True) -> Frames:
    """Random similarity frames; the first patch stays as it is if ``keep_first``."""
    n = len(ids)
    s = random_scales(n, seed=seed) if scale else np.ones(n)
    r, t = random_rotations(n, dim, seed + 1), random_shifts(n, dim, seed=seed + 2)
    if keep_first and n:
        s[0], r[0], t[0] = 1.0, np.eye(dim), 0.0
    return Frames(list(ids), s, r, t)


def add_noise(patches: DataFrame, std: float, seed: int = 1, scales: DataFrame | None = None) -> DataFrame:
    """Independent normal noise on every coordinate, times the patch's ``scale`` if a table of them is given."""
    rows = patches if scales is None else patches.join(scales.select("patch_id", F.col("scale").alias("_s")), "patch_id")
    factor = F.lit(std) if scales is None else F.lit(std) * F.col("_s")
    coords = F.transform("coords", lambda x, k: x + factor * gaussian(seed, F.col("patch_id"), F.col("node"), k))
    return rows.select("patch_id", "node", coords.alias("coords"))


def random_patches(points: DataFrame, n_patches: int, copies: int = 2, seed: int = 1) -> DataFrame:
    """``patch_id, node, coords``: each point in ``copies`` consecutive patches of a ring, by a hash."""
    first = F.floor(uniform(seed, F.col("node")) * n_patches).cast("int")
    steps = F.array(*[F.lit(c) for c in range(copies)])
    return points.select("node", "coords", first.alias("f"), F.explode(steps).alias("c")).select(
        F.pmod(F.col("f") + F.col("c"), F.lit(n_patches)).cast("int").alias("patch_id"), "node", "coords"
    ).dropDuplicates(["patch_id", "node"])


def farthest_first(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Positions of k rows, each the farthest from those chosen before."""
    chosen = [int(np.random.default_rng(seed).integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)
