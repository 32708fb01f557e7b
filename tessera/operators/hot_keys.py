"""Per-key results when a few keys hold most of the rows.

Exact offset chunking.  The rows, reduced to one per (key, partner), are put in
key order in range partitions; the rows of every partition are counted, the
counts are prefix-summed to offsets, and offset plus position numbers each row.
Consecutive numbers form chunks of exactly equal size, so a hub is spread over
as many chunks as its rows need.  Each chunk gives one state per key it
touches, and the states of a key are merged in chunk order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import pick
from tessera.session import materialize

DEFAULT_CHUNK_ROWS = 1 << 17


def number_rows(table: DataFrame) -> DataFrame:
    """Add ``row_no``, the 0-based global number of each row of a parquet table.

    ``table`` must come straight from a parquet scan.  Rows per file are
    counted, counts are prefix-summed over the file names (one small row per
    file, whatever the row count) and added to the row's index in its file.
    The numbering depends on the files only, so a re-run task gives the same
    numbers.
    """
    meta = F.col("_metadata")
    counts = table.groupBy(meta["file_name"].alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    placed = table.select("*", meta["file_name"].alias("_file"), meta["row_index"].alias("_pos"))
    # One row per file of the table just written: bounded by its number of write tasks.
    return (
        placed.join(F.broadcast(offsets), "_file")
        .withColumn("row_no", F.col("_offset") + F.col("_pos"))
        .drop("_file", "_offset", "_pos")
    )


def key_stats(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    value: str = "edge_feature_0",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Rows, distinct partners and value sum for every id of either column.

    Returns ``side, id, n_rows, n_partners, sum_value``; side is the literal
    ``src`` or ``dst``.

    * A null id belongs to no key and gives no row; its partner still counts
      the row.  A null partner counts as a row, not as a partner.
    * Null values add nothing; a key with null values only has a null sum.
      NaN values make the sum NaN.
    * Repeated rows count each time in ``n_rows`` and once in ``n_partners``.
    * An empty table gives an empty result; extra columns are ignored.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    rows = pick(edges, src, dst, value).select(
        F.col(src).cast("long").alias("s"), F.col(dst).cast("long").alias("d"), F.col(value).cast("double").alias("v")
    )
    pairs = rows.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    keyed = pairs.selectExpr("stack(2, true, s, d, false, d, s) as (is_src, id, partner)", "n", "v").where(
        "id is not null"
    )
    ordered = keyed.repartitionByRange("is_src", "id", "partner").sortWithinPartitions("is_src", "id", "partner")
    numbered = number_rows(materialize(ordered, "key-order"))
    states = (
        numbered.withColumn("chunk", F.floor(F.col("row_no") / F.lit(chunk_rows)))
        .groupBy("is_src", "id", "chunk")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("partner").alias("n_partners"),
            F.min("partner").alias("first_partner"),
            F.max("partner").alias("last_partner"),
            F.sum("v").alias("sum_value"),
        )
    )
    return _merge_states(states)


def _merge_states(states: DataFrame) -> DataFrame:
    """Merge the chunk states of each key in chunk order.

    A partner that ends one chunk and begins the next was counted in both and
    is taken off once.
    """
    in_order = Window.partitionBy("is_src", "id").orderBy("chunk")
    twice: Column = F.when(F.col("first_partner") == F.lag("last_partner").over(in_order), 1).otherwise(0)
    return (
        states.withColumn("twice", twice)
        .groupBy("is_src", "id")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            (F.sum("n_partners") - F.sum("twice")).alias("n_partners"),
            F.sum("sum_value").alias("sum_value"),
        )
        .select(F.when(F.col("is_src"), "src").otherwise("dst").alias("side"), "id", "n_rows", "n_partners", "sum_value")
    )


def heavy_keys(edges: DataFrame, min_share: float = 0.02, **columns) -> DataFrame:
    """Keys whose rows are at least ``min_share`` of all rows, by side.

    Every row of the table counts in the total, those with nulls too.
    """
    total = edges.count()
    return key_stats(edges, **columns).where(F.col("n_rows") >= F.lit(min_share) * F.lit(total))
