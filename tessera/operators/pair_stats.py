"""What two overlapping patches have to say about each other.

One aggregate over the overlap join gives, per pair of patches, the count, both
means, the centred cross-covariance and the centred second moments.  Every
alignment method works on these statistics alone; coordinates are not read
again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import vec_mean


def overlaps(patches: DataFrame) -> DataFrame:
    """``i, j, node`` for every pair i < j and each node they share."""
    rows = patches.select("patch_id", "node").distinct()
    return rows.select(F.col("patch_id").alias("i"), "node").join(rows.select(F.col("patch_id").alias("j"), "node"), "node").where("i < j").select("i", "j", "node")


def overlap_counts(patches: DataFrame, both_ways: bool = True) -> DataFrame:
    """``i, j, n_overlap``; both orders of each pair unless ``both_ways`` is off."""
    half = overlaps(patches).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_overlap"))
    if not both_ways:
        return half
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "n_overlap"))


def patch_degrees(patch_edges: DataFrame) -> DataFrame:
    """``patch_id, degree`` over directed patch edges ``i, j``."""
    return patch_edges.groupBy(F.col("i").alias("patch_id")).agg(F.count(F.lit(1)).alias("degree"))


def node_multiplicity(patches: DataFrame) -> DataFrame:
    """``n_patches, n_nodes``: how many nodes lie in how many patches."""
    each = patches.select("patch_id", "node").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_patches"))
    return each.groupBy("n_patches").agg(F.count(F.lit(1)).alias("n_nodes"))


def node_patches(patches: DataFrame) -> DataFrame:
    """``node, patch_ids`` in ascending order."""
    return patches.select("patch_id", "node").distinct().groupBy("node").agg(F.sort_array(F.collect_list("patch_id")).alias("patch_ids"))


def pair_coordinates(patches: DataFrame, min_overlap: int = 0) -> DataFrame:
    """``i, j, node, coords_i, coords_j`` for i < j with at least ``min_overlap`` shared nodes."""
    left = patches.select(F.col("patch_id").alias("i"), "node", F.col("coords").alias("coords_i"))
    right = patches.select(F.col("patch_id").alias("j"), "node", F.col("coords").alias("coords_j"))
    pairs = left.join(right, "node").where("i < j").select("i", "j", "node", "coords_i", "coords_j")
    if min_overlap < 2:
        return pairs
    enough = overlap_counts(patches, both_ways=False).where(F.col("n_overlap") >= min_overlap)
    return pairs.join(enough.select("i", "j"), ["i", "j"], "left_semi")


def patch_coordinates(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``patch_id, node, coords`` for the asked ``(patch_id, node)``; null coordinates for nodes not in the patch."""
    return nodes.select("patch_id", "node").join(patches, ["patch_id", "node"], "left")


@dataclass(frozen=True)
class PairStats:
    """Arrays over pairs i < j, positions into ``ids``."""

    ids: list[int]
    i: np.ndarray
    j: np.ndarray
    n: np.ndarray
    mean_i: np.ndarray
    mean_j: np.ndarray
    cov: np.ndarray  # centred x_i' x_j
    s_i: np.ndarray  # centred x_i' x_i
    s_j: np.ndarray

    @property
    def dim(self) -> int:
        return self.mean_i.shape[1]

    def scaled(self, k: np.ndarray) -> PairStats:
        a, b = k[self.i], k[self.j]
        return replace(
            self, mean_i=self.mean_i * a[:, None], mean_j=self.mean_j * b[:, None], cov=self.cov * (a * b)[:, None, None],
            s_i=self.s_i * (a * a)[:, None, None], s_j=self.s_j * (b * b)[:, None, None],
        )

    def rotated(self, s: np.ndarray) -> PairStats:
        a, b = s[self.i], s[self.j]
        at, bt = a.transpose(0, 2, 1), b.transpose(0, 2, 1)
        return replace(
            self, mean_i=np.einsum("ei,eij->ej", self.mean_i, a), mean_j=np.einsum("ei,eij->ej", self.mean_j, b),
            cov=at @ self.cov @ b, s_i=at @ self.s_i @ a, s_j=bt @ self.s_j @ b,
        )

    def kept(self, mask: np.ndarray) -> PairStats:
        return replace(self, **{f: getattr(self, f)[mask] for f in ("i", "j", "n", "mean_i", "mean_j", "cov", "s_i", "s_j")})


def _centred(patches: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """``patch_id, node, x`` with coordinates minus their patch's mean, and these means.

    Without this the sums of products lose digits where a patch lies far from
    the origin.
    """
    means = patches.groupBy("patch_id").agg(vec_mean(F.col("coords"), dim).alias("mean"))
    rows = patches.join(means, "patch_id").select("patch_id", "node", F.zip_with("coords", "mean", lambda x, m: x - m).alias("x"))
    return rows, means


def pair_statistics(patches: DataFrame, dim: int, patch_edges: DataFrame | None = None) -> PairStats:
    """The statistics of all overlapping pairs, collected.

    The result has one row of O(dim^2) numbers per pair of patches; the rows of
    the overlaps are aggregated where they are.  ``patch_edges(i, j)``
    restricts the pairs.
    """
    rows, means = _centred(patches, dim)
    left = rows.select(F.col("patch_id").alias("i"), "node", F.col("x").alias("a"))
    right = rows.select(F.col("patch_id").alias("j"), "node", F.col("x").alias("b"))
    joined = left.join(right, "node").where("i < j")
    if patch_edges is not None:
        wanted = patch_edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
        joined = joined.join(wanted, ["i", "j"], "left_semi")
    # Every batch is reduced to one row of sums per pair before anything is shuffled.
    partial = joined.select("i", "j", "a", "b").mapInPandas(_partial_sums(dim), _SUMS)
    table = partial.groupBy("i", "j").applyInPandas(_add_up, _SUMS).toPandas().sort_values(["i", "j"])
    centre = means.toPandas().set_index("patch_id")["mean"]
    ids = sorted(int(p) for p in centre.index)
    at = {p: k for k, p in enumerate(ids)}
    offset = np.array([centre[p] for p in ids], float).reshape(len(ids), dim)
    i = np.array([at[p] for p in table["i"]], int)
    j = np.array([at[p] for p in table["j"]], int)
    n = table["n"].to_numpy(float)
    e = len(table)
    flat = np.array(table["s"].tolist(), float).reshape(e, 2 * dim + 3 * dim * dim)
    sa, sb, p, q, r = np.split(flat, np.cumsum([dim, dim, dim * dim, dim * dim]), 1)
    p, q, r = (x.reshape(e, dim, dim) for x in (p, q, r))
    mean_a, mean_b = sa / n[:, None], sb / n[:, None]
    outer = lambda u, v: np.einsum("ek,em->ekm", u, v) * n[:, None, None]
    return PairStats(
        ids, i, j, n, mean_a + offset[i], mean_b + offset[j], p - outer(mean_a, mean_b), q - outer(mean_a, mean_a), r - outer(mean_b, mean_b)
    )


_SUMS = "i int, j int, n long, s array<double>"


def _partial_sums(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values(["i", "j"], kind="stable")
            i, j = batch["i"].to_numpy(), batch["j"].to_numpy()
            x, y = np.array(batch["a"].tolist(), float), np.array(batch["b"].tolist(), float)
            starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            outer = [np.einsum("nk,nm->nkm", u, v).reshape(len(x), dim * dim) for u, v in ((x, y), (x, x), (y, y))]
            sums = np.add.reduceat(np.concatenate([x, y, *outer], 1), starts, axis=0)
            yield pd.DataFrame({"i": i[starts], "j": j[starts], "n": np.diff(np.r_[starts, len(i)]), "s": list(sums)})

    return run


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.array(rows["s"].tolist(), float), axis=0)
    return pd.DataFrame({"i": [rows["i"].iloc[0]], "j": [rows["j"].iloc[0]], "n": [rows["n"].sum()], "s": [total]})
