"""Named graph datasets on local or shared paths."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.schema import EDGE_KEYS, NODE_KEYS, feature_columns, require
from tessera.sources.convert import coalesced_edges, first_node_features, snapshots
from tessera.sources.files import ingest_snapshots, path_exists

_DATASETS: dict[str, type[Dataset]] = {}


def register_dataset(name: str):
    """Decorator that makes a dataset class available under a name."""

    def add(cls):
        _DATASETS[name] = cls
        return cls

    return add


def list_available_datasets() -> list[str]:
    return sorted(_DATASETS)


def get_dataset(name: str, *args, **kwargs) -> Dataset:
    if name not in _DATASETS:
        raise ValueError(f"unknown dataset {name}, available: {', '.join(list_available_datasets())}")
    return _DATASETS[name](*args, **kwargs)


class Dataset:
    """An edge table and an optional node table under ``root``.

    ``pre_transform`` maps both tables before they are written,
    ``transform`` when they are read.
    """

    def __init__(self, spark: SparkSession, root: str, transform: Callable | None = None, pre_transform: Callable | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.transform, self.pre_transform = transform, pre_transform
        self._tables: tuple[DataFrame, DataFrame | None] | None = None

    @property
    def raw_dir(self) -> str:
        return f"{self.root}/raw"

    @property
    def processed_dir(self) -> str:
        return f"{self.root}/processed"

    @property
    def raw_file_names(self) -> list[str]:
        return []

    @property
    def processed_file_names(self) -> list[str]:
        return ["edge_data.parquet", "node_data.parquet"]

    def process(self) -> None:
        """Make the processed tables if they don't exist."""

    def tables(self) -> tuple[DataFrame, DataFrame | None]:
        """``(edges, nodes)``, read once."""
        if self._tables is None:
            self.process()
            edges = require(self.spark.read.parquet(f"{self.processed_dir}/edge_data.parquet"), *EDGE_KEYS)
            path = f"{self.processed_dir}/node_data.parquet"
            nodes = require(self.spark.read.parquet(path), *NODE_KEYS) if path_exists(self.spark, path) else None
            if self.transform:
                edges, nodes = self.transform(edges, nodes)
            self._tables = edges, nodes
        return self._tables

    def graph(self) -> PropertyGraph:
        """All snapshots as one directed graph with features of the earliest node rows."""
        edges, nodes = self.tables()
        # Of an edge on several dates the features of the first one stay.
        features = feature_columns(edges, EDGE_KEYS)
        first = F.min(F.struct("timestamp", *features)).alias("f")
        flat = coalesced_edges(edges).groupBy("src", "dst").agg(first).select("src", "dst", *[F.col(f"f.{c}").alias(c) for c in features])
        return PropertyGraph(flat, first_node_features(nodes) if nodes is not None else PropertyGraph.from_edges(flat).nodes)

    def to(self, form: str):
        """``spark``: the tables; ``graph``; ``snapshots``: a list; ``pandas``: collected tables."""
        edges, nodes = self.tables()
        if form == "spark":
            return edges, nodes
        if form == "graph":
            return self.graph()
        if form == "snapshots":
            return list(snapshots(edges, nodes))
        if form == "pandas":
            return edges.toPandas(), None if nodes is None else nodes.toPandas()
        raise ValueError(f"unknown form {form}, available: spark, graph, snapshots, pandas")

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.root!r})"


@register_dataset("as-733")
class SnapshotDataset(Dataset):
    """Daily snapshots in raw files ``as<yyyymmdd>.txt``."""

    def process(self) -> None:
        ingest_snapshots(self.spark, self.raw_dir, self.processed_dir, pre_transform=self.pre_transform)


class TableDataset(Dataset):
    """Parquet tables given by the user: ``raw/edges`` and optionally ``raw/nodes``."""

    def process(self) -> None:
        if path_exists(self.spark, f"{self.processed_dir}/edge_data.parquet"):
            return
        edges = self.spark.read.parquet(f"{self.raw_dir}/edges")
        nodes = self.spark.read.parquet(f"{self.raw_dir}/nodes") if path_exists(self.spark, f"{self.raw_dir}/nodes") else None
        if self.pre_transform:
            edges, nodes = self.pre_transform(edges, nodes)
        require(edges, *EDGE_KEYS).write.mode("overwrite").parquet(f"{self.processed_dir}/edge_data.parquet")
        if nodes is not None:
            require(nodes, *NODE_KEYS).write.mode("overwrite").parquet(f"{self.processed_dir}/node_data.parquet")


class RawTableDataset(TableDataset):
    """Tables made from the published raw files, or given ready as parquet."""

    def raw_tables(self) -> tuple[DataFrame, DataFrame]:
        raise NotImplementedError

    def process(self) -> None:
        if path_exists(self.spark, f"{self.raw_dir}/edges"):
            return super().process()
        if path_exists(self.spark, f"{self.processed_dir}/edge_data.parquet"):
            return
        edges, nodes = self.raw_tables()
        if self.pre_transform:
            edges, nodes = self.pre_transform(edges, nodes)
        edges.write.mode("overwrite").parquet(f"{self.processed_dir}/edge_data.parquet")
        nodes.write.mode("overwrite").parquet(f"{self.processed_dir}/node_data.parquet")


@register_dataset("Cora")
class CitationDataset(RawTableDataset):
    """A citation graph with word features and classes.

    Raw files are the published pair of tables: ``*.content`` with paper,
    words as 0 or 1 and class, and ``*.cites`` with cited and citing paper.
    Papers and classes get numbers in the order of their names; a citation is
    an edge both ways.  ``x`` has the positions of a paper's words,
    ``train_mask`` the first 20 papers of each class, ``val_mask`` the next
    500 of all others and ``test_mask`` the 1,000 after these.
    """

    def raw_tables(self) -> tuple[DataFrame, DataFrame]:
        lines = F.split(F.trim("value"), r"\s+")
        content = self.spark.read.text(f"{self.raw_dir}/*.content").select(lines.alias("f")).where(F.size("f") > 2)
        papers = content.select(F.get("f", F.lit(0)).alias("paper"), F.element_at("f", -1).alias("class"), F.slice("f", 2, F.size("f") - 2).alias("words"))
        # A list of classes, and one row per paper: the published table has thousands.
        by_class, order = Window.orderBy("class"), Window.orderBy("paper")
        papers = papers.withColumn("id", (F.row_number().over(order) - 1).cast("long")).withColumn("y", (F.dense_rank().over(by_class) - 1).cast("long"))
        in_class = Window.partitionBy("y").orderBy("id")
        papers = papers.withColumn("train_mask", F.row_number().over(in_class) <= 20)
        rest = F.sum((~F.col("train_mask")).cast("int")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
        papers = papers.withColumn("rest", rest).withColumn("val_mask", ~F.col("train_mask") & (F.col("rest") <= 500))
        papers = papers.withColumn("test_mask", ~F.col("train_mask") & F.col("rest").between(501, 1_500))
        marked = F.transform("words", lambda w, k: F.when(w == "1", k))
        zero = F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz").alias("timestamp")
        nodes = papers.select(zero, "id", F.filter(marked, lambda k: k.isNotNull()).alias("x"), "y", "train_mask", "val_mask", "test_mask", F.col("paper").alias("label"))
        cites = self.spark.read.text(f"{self.raw_dir}/*.cites").select(lines.alias("f")).where(F.size("f") == 2)
        ids = nodes.select("id", "label")
        pairs = (
            cites.select(F.get("f", F.lit(0)).alias("cited"), F.get("f", F.lit(1)).alias("citing"))
            .join(ids.select(F.col("label").alias("cited"), F.col("id").alias("a")), "cited")
            .join(ids.select(F.col("label").alias("citing"), F.col("id").alias("b")), "citing")
            .where("a <> b")
        )
        both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")).distinct()
        return both.select(zero, "src", "dst"), nodes


@register_dataset("DGraph")
class FinancialDataset(RawTableDataset):
    """A financial graph with timed edges.

    The raw file is the published archive of arrays: ``edge_index`` (two
    columns), ``edge_type``, ``edge_timestamp`` (a day number), ``x``, ``y`` and
    ``train_mask``, ``valid_mask``, ``test_mask`` as lists of ids.
    ``source_file`` names it; else the only ``*.npz`` of the raw folder is read.
    """

    def __init__(self, spark: SparkSession, root: str, source_file: str | None = None, **kwargs):
        super().__init__(spark, root, **kwargs)
        self.source_file = source_file

    def raw_tables(self) -> tuple[DataFrame, DataFrame]:
        path = self.source_file or next(iter(sorted(Path(self.raw_dir.removeprefix("file://")).glob("*.npz"))), None)
        if path is None or not Path(path).is_file():
            raise FileNotFoundError(f"there is no raw file {path or self.raw_dir}")
        with np.load(path) as arrays:
            ends = arrays["edge_index"]
            edges = pd.DataFrame({"day": arrays["edge_timestamp"].astype(np.int64), "src": ends[:, 0].astype(np.int64), "dst": ends[:, 1].astype(np.int64), "edge_type": arrays["edge_type"].astype(np.int64)})
            nodes = pd.DataFrame({"id": np.arange(len(arrays["x"])), "x": arrays["x"].astype(float).tolist(), "y": arrays["y"].astype(np.int64)})
            for name, mask in (("train_mask", "train_mask"), ("val_mask", "valid_mask"), ("test_mask", "test_mask")):
                nodes[name] = np.isin(nodes["id"], arrays[mask])
        when = F.timestamp_seconds(F.col("day") * 86_400).cast("timestamp_ntz").alias("timestamp")
        edge_rows = self.spark.createDataFrame(edges, "day long, src long, dst long, edge_type long").select(when, "src", "dst", "edge_type")
        node_rows = self.spark.createDataFrame(nodes, "id long, x array<double>, y long, train_mask boolean, val_mask boolean, test_mask boolean")
        return edge_rows, node_rows.select(F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz").alias("timestamp"), "*")
