"""Session helpers: where intermediate tables live and how lineage is cut.

Everything that has to outlive an executor goes to one shared folder, the one
the session names in ``spark.checkpoint.dir``.  Only a purely local session
without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``, else from a checkpoint directory that
    was set on the context.  A local session without either gets a temporary
    folder that ends with the process; a cluster session without either is an error, because a folder on
    one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    already = context.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[app] = "file://" + folder
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody used before."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result reads them any more."""
    delete_path(spark, _scratch_root(spark))


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a
    recomputation.  Parquet is several times smaller than a row checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, name: str, before: DataFrame | None) -> DataFrame:
    """Materialize the next state of a loop and delete the table of the state before, if that is given.

    ``before`` is a table that ``materialize`` returned and that nothing else reads.
    """
    result = materialize(df, name)
    if before is not None:
        for path in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
            delete_path(df.sparkSession, path)
    return result


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark) + "/checkpoints")
    return df.checkpoint(eager=True)
