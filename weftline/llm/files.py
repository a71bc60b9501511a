"""Binary shard files in a shared folder: temporary names, one rename each, and a manifest as the commit.

Tasks write through Arrow file systems (local, HDFS, S3, GCS by the folder's URI). A shard's bytes depend
on its rows alone, so a task that runs twice renames the same bytes to the same name; files that no
manifest row names are not read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def output(folder: str, name: str):
    """A binary stream to ``folder/name`` that takes its name only when all is written."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/_temporary", recursive=True)
    temporary = f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as stream:
        yield stream
    system.move(temporary, f"{root}/{name}")


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Run the job whose rows name the written files, and keep the rows as ``folder/_manifest``."""
    manifest.write.parquet(f"{folder}/_manifest")
    return manifest.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def committed(spark: SparkSession, folder: str, suffix: str, manifest: DataFrame) -> DataFrame:
    """Contents of the files that the manifest names, with the manifest's columns.

    The manifest has a row for each file of tens of MB; it is broadcast only as Spark's size limit allows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(manifest, "file")
