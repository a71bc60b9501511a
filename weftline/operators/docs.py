"""Text documents about the catalog, their index, and searches over them; result tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.drill import per_type_topk


def doc_group(labels: DataFrame, access: DataFrame, tiers: DataFrame, scores: DataFrame, first: int = 20) -> DataFrame:
    """cluster, doc: a cluster's size, tier range, mean complexity, and the tables that its first members all use."""
    order = Window.partitionBy("cluster").orderBy("sid")
    head = labels.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first).select("cluster", "sid")
    n = head.groupBy("cluster").agg(F.count("*").alias("n"))
    used = head.join(access.select("sid", "tname").distinct(), "sid").groupBy("cluster", "tname").agg(F.count("*").alias("m")).join(n, "cluster").where("m = n")
    common = used.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("tname")), ",").alias("tables"))
    cents = F.sum(F.round(F.coalesce("score", F.lit(50.0)) * 100).cast("long"))
    facts = labels.join(tiers, "sid").join(scores.select("sid", "score"), "sid", "left").groupBy("cluster").agg(F.count("*").alias("members"), F.min("tier").alias("low"), F.max("tier").alias("high"), (F.floor((cents * 2 + F.count("*")) / (2 * F.count("*"))).cast("long")).alias("cents"))
    return facts.join(common, "cluster", "left").select("cluster", F.format_string("Group %s: %d sessions in tiers %d to %d, mean complexity %d hundredths, common tables: %s", "cluster", "members", "low", "high", "cents", F.coalesce("tables", F.lit(""))).alias("doc"))


def doc_environment(stats: DataFrame, folders: DataFrame) -> DataFrame:
    """doc: one summary of the catalog's counters and of its folders."""
    lists = folders.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "folder", F.col("sessions").cast("string")))), ", ").alias("folders"))
    return stats.crossJoin(F.broadcast(lists)).select(F.format_string("%d sessions in %d tiers, %d conflicts, %d chains, %d source tables, folders: %s", "sessions", "max_tier", "conflicts", "chains", "source_tables", "folders").alias("doc"))


def index_documents(parts: dict[str, DataFrame], upload_id: int, path: str) -> DataFrame:
    """type, documents: documents (id, doc) of all types in one table, replaced upload by upload."""
    rows = None
    for kind, docs in parts.items():
        part = docs.select(F.lit(kind).alias("type"), F.concat_ws(":", F.lit(kind), F.col("id").cast("string")).alias("id"), F.col("doc"), F.lit(upload_id).alias("upload_id"))
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path)
    spark = rows.sparkSession
    return spark.read.parquet(path).where(F.col("upload_id") == upload_id).groupBy("type").agg(F.count("*").alias("documents"))


def hybrid_search(vectors: DataFrame, names: DataFrame, query: str, k: int = 5, total: int = 15) -> DataFrame:
    """type, id, distance: vector hits (type, id, distance), and objects (type, id, name) that the query names, at distance 0."""
    words = F.split(F.upper(F.lit(query)), r"[^A-Z0-9_]+")
    exact = names.where(F.array_contains(words, F.upper("name"))).select("type", "id", F.lit(0.0).alias("distance"))
    return per_type_topk(vectors.select("type", "id", "distance").unionByName(exact), k, total)


def extract_references(answers: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """answer, kind, name: catalog names that occur as words in an answer's text, the first ``n`` of each kind by name.

    Words of answers are joined with names, so no answer meets every name.
    """
    words = answers.select("answer", F.explode(F.array_distinct(F.split(F.upper("text"), r"[^A-Z0-9_]+"))).alias("word"))
    found = words.join(names.select("kind", "name", F.upper("name").alias("word")), "word").select("answer", "kind", "name").distinct()
    return found.withColumn("r", F.row_number().over(Window.partitionBy("answer", "kind").orderBy("name"))).where(F.col("r") <= n).select("answer", "kind", "name")


def normalise_detail(expressions: DataFrame, sql: DataFrame, instances: DataFrame) -> DataFrame:
    """kind, sid, name, detail, complexity: mapping detail as one flat list; complexity counts parentheses and joins."""
    parens = lambda c: F.regexp_count(c, F.lit(r"\(")).cast("long")
    joins = F.regexp_count(F.upper("sql_text"), F.lit(r"\bJOIN\b")).cast("long")
    kind = F.when(F.upper("sql_text").startswith("SELECT"), "sql_select").when(F.upper("sql_text").startswith("BEGIN"), "sql_block").otherwise("sql_dml")
    a = expressions.select(F.lit("expression").alias("kind"), "sid", F.concat_ws(".", "transform", "field").alias("name"), F.col("expression_text").alias("detail"), parens("expression_text").alias("complexity"))
    b = sql.select(kind.alias("kind"), "sid", F.col("transform").alias("name"), F.col("sql_text").alias("detail"), (parens("sql_text") + joins).alias("complexity"))
    c = instances.select(F.lit("transform").alias("kind"), "sid", F.col("inst_name").alias("name"), F.col("transformation_type").alias("detail"), F.lit(0).cast("long").alias("complexity"))
    return a.unionByName(b).unionByName(c)


def write_results(analyses: dict[str, DataFrame], upload_id: int, path: str) -> DataFrame:
    """analysis, rows: each analysis as rows (sid, key, value), replaced by upload and analysis."""
    rows = None
    for name, found in analyses.items():
        values = F.explode(F.create_map(*[x for c in found.columns if c != "sid" for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value")
        part = found.select(F.lit(name).alias("analysis"), "sid", values).withColumn("upload_id", F.lit(upload_id))
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id", "analysis").parquet(path)
    return rows.sparkSession.read.parquet(path).where(F.col("upload_id") == upload_id).groupBy("analysis").agg(F.count("*").alias("rows"))


def result_view(spark: SparkSession, path: str, upload_id: int, analysis: str, key: str) -> DataFrame:
    """value, sessions, members (a sample of 20): a stored analysis of an upload, by the values of one key."""
    rows = spark.read.parquet(path).where((F.col("upload_id") == upload_id) & (F.col("analysis") == analysis) & (F.col("key") == key))
    head = rows.withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy("sid")))
    return head.groupBy("value").agg(F.count("*").alias("sessions"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= 20, F.col("sid")))), ",").alias("members"))


def export_sheets(sheets: dict[str, DataFrame], path: str) -> DataFrame:
    """sheet, rows, columns: each dataset as CSV with a header below ``path``, read back and counted."""
    out = None
    for name, rows in sheets.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        part = rows.sparkSession.read.option("header", True).schema(rows.schema).csv(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows", F.lit(len(rows.columns)).cast("long").alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def export_snapshot(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """kind, id, json: the whole state as JSON lines, written and read back."""
    rows = None
    for kind, (df, key) in parts.items():
        part = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.to_json(F.struct(*df.columns)).alias("json"))
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)
