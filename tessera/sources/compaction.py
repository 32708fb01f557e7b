"""Consolidating very many small files without losing or repeating records.

A :class:`VersionedTable` is a parquet table partitioned by one column, with a
log of snapshot versions beside its data.  Compaction is local to partitions:
it finds those holding more small files than allowed, rewrites only them with
dynamic partition overwrite into as few files of the wanted size as possible,
and leaves all others untouched.  The version it started from and the listing
of the partitions it rewrites are checked again before anything is replaced; a
writer that came in between makes it fail instead of losing that writer's rows.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import pick
from tessera.session import delete_path, scratch_path

DEFAULT_TARGET_BYTES = 128 << 20
_NAME, _FILES, _SLOT = "__partition_name", "__partition_files", "__file_slot"


class ConflictError(RuntimeError):
    """Another writer changed what this one was about to replace."""


@dataclass(frozen=True)
class CompactionResult:
    version: int
    partitions: int
    files_before: int
    files_after: int
    rows: int


class VersionedTable:
    """A partitioned parquet table with optimistic snapshot versions."""

    def __init__(self, spark: SparkSession, path: str, partition_column: str = "snapshot"):
        self.spark = spark
        self.path = path.rstrip("/")
        self.partition_column = partition_column
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    # -- versions ---------------------------------------------------------

    def _log(self) -> set[str]:
        log = self._at("_versions")
        return {s.getPath().getName() for s in self._fs.listStatus(log)} if self._fs.exists(log) else set()

    def version(self) -> int:
        """The last version that a writer took, 0 for a table without any."""
        return max([int(n[:12]) for n in self._log() if n.endswith(".json")], default=0)

    def begin(self) -> int:
        """The version to build on; fails while another writer is at work."""
        last = self.version()
        if last and f"{last:012d}.done" not in self._log():
            raise ConflictError(f"version {last} of {self.path} is being written; recover() completes it if its writer died")
        return last

    def commit(self, base: int, note: dict) -> int:
        """Take the version after ``base``; fails if another writer has.

        The log entry is created exclusively, so of two writers with the same
        base only one succeeds; the file system must support that.  Others
        can't begin until :meth:`finish`.
        """
        if not self._create(f"{base + 1:012d}.json", json.dumps(note | {"at": time.time()})):
            raise ConflictError(f"version {base + 1} of {self.path} was taken by another writer")
        return base + 1

    def finish(self, version: int) -> None:
        self._create(f"{version:012d}.done", "")

    def recover(self) -> bool:
        """Complete a compaction whose writer died after it took its version."""
        last = self.version()
        if not last or f"{last:012d}.done" in self._log():
            return False
        note = json.loads(self.spark.read.text(f"{self.path}/_versions/{last:012d}.json").first()[0])
        if note["operation"] != "compact":
            raise ConflictError(f"version {last} of {self.path} is an unfinished {note['operation']}")
        self._replace(note)
        self.finish(last)
        delete_path(self.spark, note["staging"])
        return True

    def _create(self, name: str, content: str) -> bool:
        entry = self._at("_versions", name)
        self._fs.mkdirs(self._at("_versions"))
        try:
            stream = self._fs.create(entry, False)
        except Exception:  # the file system's own exception, wrapped by the gateway
            if self._fs.exists(entry):
                return False
            raise
        stream.write(bytearray(content.encode()))
        stream.close()
        return True

    # -- data -------------------------------------------------------------

    def read(self, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path)

    def append(self, rows: DataFrame) -> int:
        """Add rows as they come, however many files that makes."""
        version = self.commit(self.begin(), {"operation": "append"})
        rows.write.mode("append").partitionBy(self.partition_column).parquet(self.path)
        self.finish(version)
        return version

    def files(self, partitions: DataFrame | None = None) -> DataFrame:
        """``partition, path, length, modified`` of every data file.

        Listed by Spark as file metadata; no content is read.
        """
        listed = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(self.path)
            .select("path", "length", F.col("modificationTime").alias("modified"))
        )
        named = listed.withColumn(
            "partition", F.regexp_extract("path", f"/{self.partition_column}=([^/]+)/[^/]+$", 1)
        ).where("partition <> ''")
        return named if partitions is None else named.join(partitions.select("partition"), "partition", "left_semi")

    def plan(self, small_bytes: int, max_small_files: int) -> DataFrame:
        """``partition, n_files, n_small, n_bytes, fingerprint`` of partitions to rewrite.

        Those with more than ``max_small_files`` files under ``small_bytes``.
        The fingerprint covers path, size and time of every file.
        """
        one = F.xxhash64("path", "length", "modified").cast("decimal(38,0)")
        return (
            self.files()
            .groupBy("partition")
            .agg(
                F.count(F.lit(1)).alias("n_files"),
                F.sum(F.when(F.col("length") < small_bytes, 1).otherwise(0)).alias("n_small"),
                F.sum("length").alias("n_bytes"),
                F.sum(one).alias("fingerprint"),
            )
            .where(F.col("n_small") > max_small_files)
        )

    def compact(
        self,
        target_bytes: int = DEFAULT_TARGET_BYTES,
        small_bytes: int | None = None,
        max_small_files: int = 1,
    ) -> CompactionResult | None:
        """Rewrite the partitions with too many small files.

        Returns None if there are none.  Rows are moved as they are: repeated
        rows stay repeated, and the number of rows and the sum of their hashes
        must be equal before and after, or nothing is replaced.
        Raises :class:`ConflictError` if the table got a new version or a
        rewritten partition got other files meanwhile.  From the moment the
        version is taken the new rows lie in a staging folder that the log
        names, until they have replaced the old ones.
        """
        if target_bytes < 1:
            raise ValueError("target_bytes must be positive")
        small_bytes = max(1, target_bytes // 2) if small_bytes is None else small_bytes
        base = self.begin()
        plan = self.plan(small_bytes, max_small_files)
        staged_plan = scratch_path(self.spark, "compaction-plan")
        plan.write.parquet(staged_plan)
        plan = self.spark.read.parquet(staged_plan)
        totals = plan.agg(F.count(F.lit(1)), F.sum("n_files")).first()
        if not totals[0]:
            delete_path(self.spark, staged_plan)
            return None
        staging = scratch_path(self.spark, "compaction")
        try:
            staged, n_rows = self._stage(plan, target_bytes, staging)
            self._check(base, plan, small_bytes, max_small_files)
            note = {"operation": "compact", "partitions": totals[0], "staging": staging, "schema": staged.schema.toDDL()}
            version = self.commit(base, note)
        except BaseException:
            delete_path(self.spark, staging)
            raise
        self._replace(note)
        self.finish(version)
        delete_path(self.spark, staging)
        files_after = self.files(plan).count()
        delete_path(self.spark, staged_plan)
        return CompactionResult(version, totals[0], totals[1], files_after, n_rows)

    def _stage(self, plan: DataFrame, target_bytes: int, staging: str) -> tuple[DataFrame, int]:
        """Write the planned partitions anew; same rows, or it fails."""
        rows = self.read()
        partition = F.col(self.partition_column).cast("string")
        # File counts per partition: one small row per partition of the table, not per record.
        wanted = plan.select(
            F.col("partition").alias(_NAME),
            F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / F.lit(target_bytes))).cast("int").alias(_FILES),
        )
        others = [c for c in rows.columns if c != self.partition_column]
        chosen = (
            rows.withColumn(_NAME, partition)
            .join(wanted, _NAME)
            .withColumn(_SLOT, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others]), F.col(_FILES)))
        )
        self._write(chosen.drop(_NAME, _FILES), staging)
        staged = self._staged(rows.schema.toDDL(), staging)
        before = self._digest(rows.withColumn(_NAME, partition).join(wanted, _NAME, "left_semi").drop(_NAME))
        after = self._digest(staged)
        if before != after:
            raise RuntimeError(f"compaction of {self.path} would change its rows: {before} became {after}")
        return staged, after[0]

    def _write(self, rows: DataFrame, path: str) -> None:
        """One folder with one file per partition and slot; rows keep an order that compresses."""
        spread = rows.repartition(self.partition_column, _SLOT)
        order = [self.partition_column, _SLOT, *[f"`{c}`" for c in rows.columns if c not in (self.partition_column, _SLOT)]]
        spread.sortWithinPartitions(*order).write.partitionBy(self.partition_column, _SLOT).parquet(path)

    def _staged(self, schema: str, path: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, {_SLOT} int").parquet(path).drop(_SLOT)

    def _replace(self, note: dict) -> None:
        """Dynamic overwrite: only partitions with staged rows are replaced.

        Every staged file is one read split and is written as one file.
        """
        # A session of its own, so that no other query sees these settings.
        session = self.spark.newSession()
        for k, v in self.spark.conf.getAll.items():
            if session.conf.isModifiable(k):
                session.conf.set(k, v)
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            session.conf.set(k, str(1 << 40))
        staged = session.read.schema(f"{note['schema']}, {_SLOT} int").parquet(note["staging"]).drop(_SLOT)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition_column).parquet(self.path)

    @staticmethod
    def _digest(rows: DataFrame) -> tuple:
        got = rows.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)"))
        ).first()
        return got[0], got[1]

    def _check(self, base: int, plan: DataFrame, small_bytes: int, max_small_files: int) -> None:
        if self.version() != base:
            raise ConflictError(f"{self.path} is at version {self.version()}, compaction began at {base}")
        now = self.plan(small_bytes, max_small_files).select("partition", "fingerprint")
        then = plan.select("partition", "fingerprint")
        if not then.exceptAll(now).isEmpty():
            raise ConflictError(f"files of {self.path} changed while they were compacted")


def raw_records(
    files: DataFrame, name: str = "file_name", content: str = "content"
) -> DataFrame:
    """Edge records in raw snapshot files: ``snapshot, src, dst``, as often as they stand there.

    Raw files are those named ``as<yyyymmdd>.txt``, exactly so written; the
    date is in the name.  Lines end in LF or CRLF, a byte-order mark at the
    start of the file belongs to no line, and a carriage return elsewhere is
    part of its line.  A record is a line of exactly two
    whole numbers separated by tabs or blanks, with blanks around them ignored.
    All other lines, and numbers beyond a bigint, are no records.  Raw ids
    start at 1, ids here at 0.  A null name or content holds no records.
    """
    raw = pick(files, name, content).select(F.col(name).alias("name"), F.col(content).alias("content")).where(
        F.col("name").rlike(r"(^|/)as\d{8}\.txt\z") & F.col("content").isNotNull()
    )
    lines = raw.select(
        F.regexp_extract("name", r"as(\d{8})\.txt\z", 1).cast("long").alias("snapshot"),
        F.explode(F.split(F.regexp_replace("content", "^﻿", ""), "\r?\n")).alias("line"),
    )
    record = r"\A[ \t]*(\d+)[ \t]+(\d+)[ \t]*\z"
    return (
        lines.where(F.col("line").rlike(record))
        .select(
            "snapshot",
            (F.regexp_extract("line", record, 1).try_cast("long") - 1).alias("src"),
            (F.regexp_extract("line", record, 2).try_cast("long") - 1).alias("dst"),
        )
        .where("src is not null and dst is not null")
    )


def consolidate_raw_files(
    files: DataFrame,
    path: str,
    target_bytes: int = DEFAULT_TARGET_BYTES,
    max_small_files: int = 1,
) -> VersionedTable:
    """Every edge record of the raw files once, in few files of a chosen size.

    The records are parsed, those delivered again are dropped, and the rest
    land in a table partitioned by snapshot in whatever files the writing tasks
    make; then the table is compacted.  An input without records makes an empty
    table of version 0.
    """
    spark = files.sparkSession
    table = VersionedTable(spark, path)
    # Placed by record, not by date: a date with most of the records is no single task's work.
    records = raw_records(files).groupBy("snapshot", "src", "dst").agg(F.lit(1).alias("one")).drop("one")
    table.append(records)
    table.compact(target_bytes, max_small_files=max_small_files)
    return table


def target_file_count(n_bytes: int, target_bytes: int) -> int:
    """Files of the wanted size that ``n_bytes`` make."""
    return max(1, math.ceil(n_bytes / target_bytes))
