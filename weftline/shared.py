"""Tables in the folder that all executors share: how iterative jobs cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Where the session names none, a temporary folder is set once, but only in local mode: on a cluster each machine has its
    own, so tables would be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query that has ended where this is on.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back. The shuffle files of the write go when it ends: what is read later is the table."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored = path
    return back


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is a table of ``stored``, else written and read back."""
    return df if getattr(df, "_stored", None) else stored(df, name)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``stored`` that no later step reads: what a loop's earlier rounds left. Other frames are passed over."""
    for df in tables:
        path = getattr(df, "_stored", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _status(spark: SparkSession, path: str):
    """The file system's entry of a path, or None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(at) if system.exists(at) else None


def exists(spark: SparkSession, paths) -> bool:
    return all(_status(spark, p) is not None for p in paths)


def version(spark: SparkSession, sf_dir: str, *tables: str) -> tuple:
    """Folder, and when the tables were written: what is kept of a folder holds for these tables alone."""
    found = [_status(spark, f"{sf_dir}/{t}.parquet") for t in tables]
    return sf_dir, *((s.getModificationTime(), s.getLen()) if s is not None else None for s in found)
