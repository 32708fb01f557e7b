"""Snapshot statistics over a stream of timed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def edge_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 16) -> DataFrame:
    """A stream of the parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_counts(edges: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """``window_start, n_edges, n_pairs``: rows and roughly distinct pairs per event-time window.

    Rows later than ``delay`` are dropped by the watermark; rows without a
    timestamp or end don't count.
    """
    rows = edges.where("timestamp is not null and src is not null and dst is not null")
    # Watermarks need timestamps with zone.
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (
        rows.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", window))
        .agg(F.count(F.lit(1)).alias("n_edges"), F.approx_count_distinct(F.struct("src", "dst")).alias("n_pairs"))
        .select(F.col("window.start").alias("window_start"), "n_edges", "n_pairs")
    )


def run_once(counts: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into an in-memory table and stop."""
    query = counts.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
