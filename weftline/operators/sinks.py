"""Catalog tables on disk: one folder a table, partitioned by upload, replaced upload by upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_catalog(tables: dict[str, DataFrame], upload_id: int, path: str) -> None:
    """Write one upload's rows of every table; writing again replaces them and leaves other uploads alone."""
    for name, df in tables.items():
        rows = df.withColumn("upload_id", F.lit(upload_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, name: str, upload_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("upload_id") == upload_id).drop("upload_id")


def written_counts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """name, upload_id, rows of every table."""
    out = None
    for name in names:
        part = spark.read.parquet(f"{path}/{name}").groupBy("upload_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "upload_id", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def delete_upload(spark: SparkSession, path: str, name: str, upload_id: int, target: str) -> DataFrame:
    """The table without one upload, written to ``target``; the removed count by upload."""
    rows = spark.read.parquet(f"{path}/{name}")
    rows.where(F.col("upload_id") != upload_id).write.mode("overwrite").partitionBy("upload_id").parquet(f"{target}/{name}")
    return rows.where(F.col("upload_id") == upload_id).groupBy("upload_id").agg(F.count("*").alias("removed"))


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str], uploads: DataFrame) -> DataFrame:
    """name, copied: rows whose upload exists are copied, orphans are left out."""
    for name in names:
        spark.read.parquet(f"{source}/{name}").join(uploads, "upload_id", "left_semi").write.mode("overwrite").parquet(f"{target}/{name}")
    out = None
    for name in names:
        part = spark.read.parquet(f"{target}/{name}").agg(F.count("*").alias("copied")).select(F.lit(name).alias("name"), "copied")
        out = part if out is None else out.unionByName(part)
    return out
