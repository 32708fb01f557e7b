"""The usable vector of every node of a patch table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import pick


def is_usable(coordinates: Column, dim: int) -> Column:
    """Exactly ``dim`` entries, none null, NaN or infinite, and not all zero."""
    finite = F.forall(
        coordinates, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return (
        coordinates.isNotNull()
        & (F.size(coordinates) == dim)
        & finite
        & F.exists(coordinates, lambda x: x != 0.0)
    )


def node_vectors(
    patches: DataFrame, dim: int = 8, patch_id: str = "patch_id", node: str = "node", coordinates: str = "coordinates"
) -> DataFrame:
    """``node, vector``: the coordinates of a node's usable row with the smallest patch id.

    Of several usable rows in that patch the smallest vector wins; a null
    patch id comes after all others, rows without a node don't count.  A table
    without usable rows gives no vectors.
    """
    usable = pick(patches, patch_id, node, coordinates).select(
        F.col(node).cast("long").alias("node"),
        F.coalesce(F.col(patch_id).cast("long"), F.lit((1 << 63) - 1)).alias("patch"),
        F.col(coordinates).cast("array<double>").alias("vector"),
    ).where(F.col("node").isNotNull() & is_usable(F.col("vector"), dim))
    return (
        usable.groupBy("node")
        .agg(F.min(F.struct("patch", "vector")).alias("first"))
        .select("node", F.col("first.vector").alias("vector"))
    )
