"""Job exports as XML: a Spark job that writes them, and readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
INSTANCE = T.StructType([T.StructField("_NAME", _TEXT), T.StructField("_TYPE", _TEXT)])
SESSION = T.StructType([T.StructField("_NAME", _TEXT), T.StructField("_WORKFLOW", _TEXT), T.StructField("INSTANCE", T.ArrayType(INSTANCE))])
FOLDER = T.StructType([T.StructField("_NAME", _TEXT), T.StructField("_OWNER", _TEXT), T.StructField("SESSION", T.ArrayType(SESSION)), T.StructField("_corrupt_record", _TEXT)])


def write_exports(sessions: DataFrame, instances: DataFrame, folder: str) -> None:
    """One export file for each folder: a FOLDER element for each group of its sessions (by first digits)."""
    line = F.concat(F.lit('<INSTANCE NAME="'), "inst_name", F.lit('" TYPE="'), "transformation_type", F.lit('"/>'))
    inner = instances.groupBy("sid").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("xml"))
    one = F.concat(F.lit('<SESSION NAME="'), "name", F.lit('" WORKFLOW="'), "workflow", F.lit('">'), F.coalesce("xml", F.lit("")), F.lit("</SESSION>"))
    rows = sessions.join(inner, "sid", "left").select("folder", F.substring("name", 5, 2).alias("part"), one.alias("xml"))
    text = rows.groupBy("folder", "part").agg(F.array_join(F.sort_array(F.collect_list("xml")), "\n").alias("xml"))
    element = F.concat(F.lit('<FOLDER NAME="'), "folder", F.lit('" OWNER="etl">\n'), "xml", F.lit("\n</FOLDER>"))
    files = text.select("folder", element.alias("xml")).groupBy("folder").agg(F.array_join(F.sort_array(F.collect_list("xml")), "\n").alias("xml"))
    files.select(F.concat(F.lit("<REPOSITORY>\n"), "xml", F.lit("\n</REPOSITORY>")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def read_folders(spark: SparkSession, folder: str) -> DataFrame:
    """folder struct a row; a broken record is kept in ``_corrupt_record`` and leaves later ones readable."""
    return spark.read.option("rowTag", "FOLDER").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(FOLDER).xml(folder)


def sessions(folders: DataFrame) -> DataFrame:
    """folder, workflow, name, instances of every session in the exports."""
    rows = folders.select(F.col("_NAME").alias("folder"), F.explode("SESSION").alias("s"))
    return rows.select("folder", F.col("s._WORKFLOW").alias("workflow"), F.col("s._NAME").alias("name"), F.coalesce(F.size("s.INSTANCE"), F.lit(0)).cast("long").alias("instances"))


def instances(folders: DataFrame) -> DataFrame:
    """session, inst_name, type of every instance."""
    rows = folders.select(F.explode("SESSION").alias("s")).select(F.col("s._NAME").alias("session"), F.explode("s.INSTANCE").alias("i"))
    return rows.select("session", F.col("i._NAME").alias("inst_name"), F.col("i._TYPE").alias("type"))


def structure(spark: SparkSession, folder: str) -> DataFrame:
    """tag, n: opening tags over all files, read as text."""
    tags = F.explode(F.regexp_extract_all("value", F.lit(r"<([A-Z]+)[ >]"), F.lit(1)))
    return spark.read.text(folder).select(tags.alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
