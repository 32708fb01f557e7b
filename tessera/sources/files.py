"""Reading and writing graphs, patches, frames and embeddings."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators.affine import Frames


def with_extension(path: str, extension: str) -> str:
    """The path with the extension added, or ``ValueError`` if it has another."""
    suffix = PurePosixPath(path).suffix
    if not suffix:
        return path + extension
    if suffix != extension:
        raise ValueError(f"{path} does not end in {extension}")
    return path


def read_edge_list(spark: SparkSession, path: str, separator: str = "\t", comment: str = "#") -> DataFrame:
    """``src, dst`` of text files with two integer columns and comment lines.

    Lines that don't fit the two columns give nulls and are dropped.
    """
    return (
        spark.read.csv(path, sep=separator, comment=comment, schema="src long, dst long", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        .where("src is not null and dst is not null")
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp, src, dst`` of a directory of raw snapshot files named ``as<yyyymmdd>.txt``.

    Raw ids start at 1, ids here at 0.  All files are one scan.
    """
    rows = (
        spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long", pathGlobFilter="as*.txt", recursiveFileLookup=True)
        .withColumn("file", F.col("_metadata.file_name"))
        .where("src is not null and dst is not null")
    )
    day = F.to_timestamp(F.regexp_extract("file", r"as(\d{8})\.txt$", 1), "yyyyMMdd").cast("timestamp_ntz")
    return rows.select(day.alias("timestamp"), (F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))


def snapshot_nodes(edges: DataFrame, ends: str = "src") -> DataFrame:
    """``timestamp, id``: the distinct sources of each snapshot, or with ``ends="both"`` all ends."""
    if ends not in ("src", "both"):
        raise ValueError("ends is src or both")
    ids = edges.select("timestamp", F.col("src").alias("id"))
    if ends == "both":
        ids = ids.unionByName(edges.select("timestamp", F.col("dst").alias("id")))
    return ids.distinct()


def ingest_snapshots(
    spark: SparkSession, raw: str, processed: str, ends: str = "src", overwrite: bool = False, pre_transform: Callable | None = None
) -> tuple[str, str]:
    """Raw snapshot files to two sorted parquet tables; skipped if they exist.

    ``pre_transform`` maps edges and nodes before they are written.
    """
    edge_path, node_path = f"{processed}/edge_data.parquet", f"{processed}/node_data.parquet"
    if overwrite or not (path_exists(spark, edge_path) and path_exists(spark, node_path)):
        edges = read_snapshots(spark, raw)
        if pre_transform:
            edges, nodes = pre_transform(edges, snapshot_nodes(edges, ends))
        edges.orderBy("timestamp", "src", "dst").write.mode("overwrite").parquet(edge_path)
        nodes = nodes if pre_transform else snapshot_nodes(spark.read.parquet(edge_path), ends)
        nodes.orderBy("timestamp", "id").write.mode("overwrite").parquet(node_path)
    return edge_path, node_path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def save_graph(graph: PropertyGraph, path: str) -> None:
    """Parquet tables ``edges``, ``nodes`` and one row of ``info``."""
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    info = [(graph.num_nodes, not graph.directed)]
    graph.edges.sparkSession.createDataFrame(info, "num_nodes long, undir boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_graph(spark: SparkSession, path: str) -> PropertyGraph:
    undirected = spark.read.parquet(f"{path}/info").first()["undir"] if path_exists(spark, f"{path}/info") else False
    edges = spark.read.parquet(f"{path}/edges")
    if path_exists(spark, f"{path}/nodes"):
        return PropertyGraph(edges, spark.read.parquet(f"{path}/nodes"), not undirected)
    return PropertyGraph.from_edges(edges, directed=not undirected, symmetric=True, weight="weight" if "weight" in edges.columns else None)


def patches_to_json(patches: DataFrame) -> DataFrame:
    """``patch_id, value``: one JSON object per patch, ``{node: [coordinates]}``."""
    entry = F.struct(F.col("node").cast("string").alias("key"), F.col("coords").alias("value"))
    return patches.groupBy("patch_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def patches_from_json(lines: DataFrame) -> DataFrame:
    """The inverse of :func:`patches_to_json`."""
    parsed = lines.select("patch_id", F.from_json("value", "map<string, array<double>>").alias("m"))
    return parsed.select("patch_id", F.explode("m").alias("node", "coords")).select("patch_id", F.col("node").cast("long"), "coords")


def save_patches(patches: DataFrame, path: str) -> str:
    """A directory of JSON lines ``{"patch_id": .., "nodes": {node: [coordinates]}}``."""
    path = with_extension(path, ".json")
    patches_to_json(patches).select(
        F.to_json(F.struct("patch_id", F.from_json("value", "map<string, array<double>>").alias("nodes"))).alias("value")
    ).write.mode("overwrite").text(path)
    return path


def load_patches(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("patch_id int, nodes map<string, array<double>>").json(with_extension(path, ".json"))
    return rows.select("patch_id", F.explode("nodes").alias("node", "coords")).select("patch_id", F.col("node").cast("long"), "coords")


def save_embedding(embedding: DataFrame, path: str) -> str:
    path = with_extension(path, ".json")
    embedding.select("node", "coords").write.mode("overwrite").json(path)
    return path


def load_embedding(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, coords array<double>").json(with_extension(path, ".json"))


def save_frames(spark: SparkSession, frames: Frames, path: str) -> None:
    frames.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_frames(spark: SparkSession, path: str) -> Frames:
    return Frames.from_table(spark.read.parquet(path))


def save_points(points: DataFrame, path: str, dim: int) -> str:
    """CSV with a header: node and one column per coordinate."""
    path = with_extension(path, ".csv")
    points.select("node", *[F.get("coords", F.lit(k)).alias(f"x{k}") for k in range(dim)]).write.mode("overwrite").option("header", True).csv(path)
    return path
