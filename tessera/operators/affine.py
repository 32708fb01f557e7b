"""Affine frames of patches: ``x * scale @ rot + shift`` with row vectors.

Frames are rows of a small table and are only applied when coordinates are
read; composing frames never touches coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import vec_mean
from tessera.schema import TRANSFORMS

BROADCAST_CELLS = 1 << 20
UNROLLED_DIM = 16


@dataclass(frozen=True)
class Frames:
    """One affine frame per patch id, composed without touching coordinates."""

    ids: list[int]
    scale: np.ndarray
    rot: np.ndarray
    shift: np.ndarray = field(repr=False)

    @staticmethod
    def identity(ids: list[int], dim: int) -> Frames:
        n = len(ids)
        return Frames(list(ids), np.ones(n), np.tile(np.eye(dim), (n, 1, 1)), np.zeros((n, dim)))

    def scaled(self, factors: np.ndarray) -> Frames:
        return Frames(self.ids, self.scale * factors, self.rot, self.shift * factors[:, None])

    def rotated(self, matrices: np.ndarray) -> Frames:
        """Coordinates are multiplied by ``matrices`` from the right."""
        return Frames(self.ids, self.scale, self.rot @ matrices, np.einsum("pi,pij->pj", self.shift, matrices))

    def translated(self, vectors: np.ndarray) -> Frames:
        return Frames(self.ids, self.scale, self.rot, self.shift + vectors)

    def relative_to(self, patch: int) -> Frames:
        """Frames that leave the coordinates of ``patch`` as they were."""
        at = self.ids.index(patch)
        back = np.linalg.inv(self.rot[at])
        moved = self.translated(np.tile(-self.shift[at], (len(self.ids), 1)))
        return moved.rotated(np.tile(back, (len(self.ids), 1, 1))).scaled(np.full(len(self.ids), 1 / self.scale[at]))

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(p), float(s), r.tolist(), t.tolist()) for p, s, r, t in zip(self.ids, self.scale, self.rot, self.shift)]
        return spark.createDataFrame(rows, TRANSFORMS)

    @staticmethod
    def from_table(table: DataFrame) -> Frames:
        rows = table.orderBy("patch_id").collect()
        return Frames(
            [r["patch_id"] for r in rows],
            np.array([r["scale"] for r in rows]),
            np.array([r["rot"] for r in rows]),
            np.array([r["shift"] for r in rows]),
        )


def apply_frames(patches: DataFrame, frames: Frames) -> DataFrame:
    """``patch_id, node, coords`` in the frames; lazy, evaluated in the JVM.

    Frames are broadcast up to ``BROADCAST_CELLS`` matrix cells and joined by
    patch id beyond; patches without a frame are dropped.
    """
    table = frames.to_table(patches.sparkSession)
    dim = frames.shift.shape[1]
    small = len(frames.ids) * dim * (dim + 1) <= BROADCAST_CELLS
    if dim > UNROLLED_DIM:
        # The expression would have dim squared terms: turned rows and higher-order functions instead, in the same order of sums.
        turned = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.transform("rot", lambda row: F.get(row, j)))
        table = F.broadcast(table.withColumn("rot", turned)) if small else table.withColumn("rot", turned)
        scaled = F.transform("coords", lambda v: v * F.col("scale"))
        moved = F.zip_with("shift", "rot", lambda t, column: F.aggregate(F.zip_with("scaled", column, lambda v, r: v * r), t, lambda total, term: total + term))
        return patches.join(table, "patch_id").withColumn("scaled", scaled).select("patch_id", "node", moved.alias("coords"))
    if small:
        table = F.broadcast(table)
    x = [F.get("coords", F.lit(i)) * F.col("scale") for i in range(dim)]
    columns = []
    for j in range(dim):
        terms = F.get("shift", F.lit(j))
        for i in range(dim):
            terms = terms + x[i] * F.get(F.get("rot", F.lit(i)), F.lit(j))
        columns.append(terms)
    return patches.join(table, "patch_id").select("patch_id", "node", F.array(*columns).alias("coords"))


def stored_patches(spark: SparkSession, path: str, frames: Frames | None = None, patch_ids: list[int] | None = None) -> DataFrame:
    """Patches of a parquet folder in their frames; nothing is read before the result is, and only the patches asked for.

    Frames can be changed any number of times without touching the file.
    """
    patches = spark.read.parquet(path).select("patch_id", "node", "coords")
    if patch_ids is not None:
        patches = patches.where(F.col("patch_id").isin(patch_ids))
    return patches if frames is None else apply_frames(patches, frames)


def mean_patches(patches: DataFrame, grouping: DataFrame, dim: int) -> DataFrame:
    """Union patches whose coordinates are the mean over their members.

    ``grouping(patch_id, super_patch)``; gives ``patch_id, node, coords`` of
    the super patches.  Groupings of groupings flatten by joining them first.
    """
    return (
        patches.join(grouping, "patch_id")
        .groupBy(F.col("super_patch").cast("int").alias("patch_id"), "node")
        .agg(vec_mean(F.col("coords"), dim).alias("coords"))
    )
