"""Flow templates, job definitions, pipeline code, lineage rows and archives: writers for tests, readers, extraction."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.mappings import _joined, _tag

_S = T.StringType()
_END = T.StructType([T.StructField("id", _S)])
_ENTRY = T.StructType([T.StructField("key", _S), T.StructField("value", _S)])
PROCESSOR = T.StructType([T.StructField(c, _S) for c in ("id", "name", "type")] + [T.StructField("config", T.StructType([T.StructField("properties", T.StructType([T.StructField("entry", T.ArrayType(_ENTRY))]))]))])
CONNECTION = T.StructType([T.StructField("id", _S), T.StructField("source", _END), T.StructField("destination", _END), T.StructField("selectedRelationships", T.ArrayType(_S))])
SERVICE = T.StructType([T.StructField(c, _S) for c in ("id", "name", "type")])
PARAMETERS = T.StructType([T.StructField("name", _S), T.StructField("parameter", T.ArrayType(T.StructType([T.StructField(c, _S) for c in ("name", "value", "sensitive")])))])
_TASK = T.StructType([T.StructField("task_key", _S), T.StructField("sql_task", T.StructType([T.StructField("query", T.StructType([T.StructField("query", _S)]))])), T.StructField("notebook_task", T.StructType([T.StructField("notebook_path", _S)])), T.StructField("depends_on", T.ArrayType(T.StructType([T.StructField("task_key", _S)])))])
JOB = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("settings", T.StructType([T.StructField("name", _S), T.StructField("tasks", T.ArrayType(_TASK))]))])
#: Words in a property's or parameter's name that mark its value as secret.
SECRET = r"(?i)password|secret|token|key|credential"


def write_flows(spark: SparkSession, orders: DataFrame, folder: str) -> None:
    """A template for each order (k, priority, status): read, transform and write processors in a row, a service, parameters.

    Files are compressed: tags repeat, and as plain text they take several times the disk of the tables they come from."""
    k = F.col("k")
    child = lambda name, value: F.concat(F.lit(f"<{name}>"), value if not isinstance(value, str) else F.lit(value), F.lit(f"</{name}>"))
    entry = lambda key, value: child("entry", F.concat(child("key", key), child("value", value)))
    pid = lambda n: F.concat(F.lit(f"p{n}-"), k)

    def processor(n: int, kind: str, properties) -> object:
        return child("processors", F.concat(child("id", pid(n)), child("name", F.concat(F.lit(f"{kind}_"), k)), child("type", f"org.flow.processors.{kind}"), child("config", child("properties", properties))))

    def connection(n: int) -> object:
        return child("connections", F.concat(child("id", F.concat(F.lit(f"c{n}-"), k)), child("source", child("id", pid(n))), child("destination", child("id", F.when(k % 10 == 0, F.lit("0123456789abcdef")).otherwise(pid(n + 1)))), child("selectedRelationships", "success")))

    service = child("controllerServices", F.concat(child("id", F.concat(F.lit("svc-"), k)), child("name", F.concat(F.lit("Pool_"), k % 5)), child("type", "org.flow.dbcp.Pool")))
    parameter = lambda name, value, secret: child("parameter", F.concat(child("name", name), child("value", value), child("sensitive", secret)))
    context = child("parameterContext", F.concat(child("name", F.concat(F.lit("ctx "), k)), parameter("Batch-Size", k.cast("string"), "false"), parameter("db.password", "x", "false"), parameter("region", "eu", "false")))
    body = F.concat(
        processor(1, "QueryDatabaseTable", F.concat(entry("Table Name", F.concat(F.lit("SRC_"), k % 50)), entry("Pool", F.concat(F.lit("svc-"), k)), entry("Password", "hidden"))),
        processor(2, "JoltTransform", entry("Spec", "shift")), processor(3, "PutDatabaseRecord", F.concat(entry("Table Name", F.concat(F.lit("DW_"), k % 50)))),
        connection(1), connection(2), service, context)
    text = orders.select(F.floor(k / 50).cast("long").alias("f"), child("snippet", body).alias("xml")).groupBy("f").agg(_joined(F.col("xml")).alias("xml"))
    text.select(F.concat(F.lit("<template>"), "xml", F.lit("</template>")).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


def _rows(spark: SparkSession, folder: str, tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("rowTag", tag).schema(schema).xml(folder)


def flow_links(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, relationship: links between processors by name; an unknown id is cut to 12 characters."""
    names = _rows(spark, folder, "processors", PROCESSOR).select("id", "name")
    links = _rows(spark, folder, "connections", CONNECTION).select(F.col("source.id").alias("s"), F.col("destination.id").alias("d"), F.array_join("selectedRelationships", ",").alias("relationship"))
    both = links.join(names.select(F.col("id").alias("s"), F.col("name").alias("sn")), "s", "left").join(names.select(F.col("id").alias("d"), F.col("name").alias("dn")), "d", "left")
    return both.select(F.coalesce("sn", F.substring("s", 1, 12)).alias("src"), F.coalesce("dn", F.substring("d", 1, 12)).alias("dst"), "relationship")


def _properties(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, "processors", PROCESSOR).select("name", F.substring_index("type", ".", -1).alias("kind"), F.explode("config.properties.entry").alias("e")).select("name", "kind", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def flow_services(spark: SparkSession, folder: str) -> DataFrame:
    """processor, property, service, service_type: properties that name a controller service; secret ones are dropped."""
    services = _rows(spark, folder, "controllerServices", SERVICE).select(F.col("id").alias("value"), F.col("name").alias("service"), F.substring_index("type", ".", -1).alias("service_type"))
    rows = _properties(spark, folder).where(~F.rlike("key", F.lit(SECRET)))
    return rows.join(services, "value").select(F.col("name").alias("processor"), F.col("key").alias("property"), "service", "service_type")


def flow_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """context, key, value, inferred_type, variable; secret values are blanked."""
    rows = _rows(spark, folder, "parameterContext", PARAMETERS).select(F.col("name").alias("context"), F.explode("parameter").alias("p"))
    secret = (F.lower("p.sensitive") == "true") | F.rlike("p.name", F.lit(SECRET))
    kind = F.when(secret, "secret").when(F.expr("try_cast(trim(p.value) as double)").isNotNull(), "numeric").otherwise("string")
    slug = F.lower(F.trim(F.regexp_replace(F.concat_ws("_", "context", "p.name"), "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return rows.select("context", F.col("p.name").alias("key"), F.when(secret, "").otherwise(F.col("p.value")).alias("value"), kind.alias("inferred_type"), slug.alias("variable"))


def flow_resources(spark: SparkSession, folder: str) -> DataFrame:
    """processor, class, resource: source, sink or transform by the kind's prefix, and the table, topic or folder it names."""
    rows = _properties(spark, folder).groupBy("name", "kind").agg(F.max(F.when(F.lower("key").isin("table name", "topic", "directory"), F.col("value"))).alias("resource"))
    kind = F.when(F.rlike("kind", F.lit("^(Query|Get|List|Fetch|Consume)")), "source").when(F.rlike("kind", F.lit("^(Put|Publish|Send)")), "sink").otherwise("transform")
    return rows.select(F.col("name").alias("processor"), kind.alias("class"), "resource")


def write_jobs(orders: DataFrame, lines: DataFrame, folder: str) -> None:
    """Job definitions as JSON lines: a job an order, a task a line, each depending on the one before."""
    n = F.col("l_linenumber")
    code = F.when(n % 2 == 0, F.concat(F.lit("INSERT INTO dw.t"), F.col("l_partkey") % 50, F.lit(" SELECT * FROM raw.s"), F.col("l_suppkey") % 20)).otherwise(F.concat(F.lit("select a from raw.s"), F.col("l_suppkey") % 20, F.lit(" join raw.r on 1 = 1")))
    depends = F.when(n > 1, F.array(F.struct(F.concat(F.lit("t"), n - 1).alias("task_key"))))
    task = F.struct(F.concat(F.lit("t"), n).alias("task_key"), F.struct(F.struct(code.alias("query")).alias("query")).alias("sql_task"), depends.alias("depends_on"))
    tasks = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), F.col("l_partkey").alias("p"), F.to_json(task).alias("t")))).alias("ts"))
    made = orders.join(tasks, F.col("k") == F.col("l_orderkey"), "left")
    body = F.array_join(F.transform("ts", lambda x: x["t"]), ",")
    made.select(F.concat(F.lit('{"job_id": '), "k", F.lit(', "settings": {"name": "job_'), "k", F.lit('", "tasks": ['), F.coalesce(body, F.lit("")), F.lit("]}}")).alias("value")).write.text(folder)


def job_edges(spark: SparkSession, folder: str) -> DataFrame:
    """from_id, to_id, conn_type: tables that a task's code reads and writes, and tasks that wait for others."""
    tasks = spark.read.schema(JOB).json(folder).select("job_id", F.explode("settings.tasks").alias("t"))
    sid = F.concat_ws("_", F.lit("job"), "job_id", "t.task_key")
    code = F.coalesce("t.sql_task.query.query", "t.notebook_task.notebook_path", F.lit(""))
    named = lambda pattern: F.array_distinct(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)))
    read = tasks.select(F.explode(named(r"(?i)\b(?:FROM|JOIN)\s+([\w.]+)")).alias("from_id"), sid.alias("to_id"), F.lit("source_read").alias("conn_type"))
    wrote = tasks.select(sid.alias("from_id"), F.explode(named(r"(?i)\bINSERT\s+(?:INTO|OVERWRITE)\s+([\w.]+)")).alias("to_id"), F.lit("write_clean").alias("conn_type"))
    waits = tasks.select("job_id", F.col("t.task_key").alias("task"), F.explode("t.depends_on").alias("d"))
    chain = waits.select(F.concat_ws("_", F.lit("job"), "job_id", "d.task_key").alias("from_id"), F.concat_ws("_", F.lit("job"), "job_id", "task").alias("to_id"), F.lit("chain").alias("conn_type"))
    return read.unionByName(wrote).unionByName(chain).distinct()


def write_pipelines(orders: DataFrame, folder: str) -> None:
    """Declarative pipeline sources, SQL for even orders and Python for others; a file for each hundred."""
    k = F.col("k")
    sql = F.concat(F.lit("CREATE OR REFRESH LIVE TABLE t"), k, F.lit(" (CONSTRAINT ok_"), k, F.lit(" EXPECT (id > 0)) AS SELECT * FROM LIVE.t"), k + 1, F.lit(";"))
    code = F.concat(F.lit('@dlt.table(name="t'), k, F.lit('")\n@dlt.expect("ok_'), k, F.lit('", "id > 0")\ndef make():\n    return dlt.read("t'), k + 1, F.lit('")\n'))
    rows = orders.select(F.floor(k / 100).cast("long").alias("f"), F.when(k % 2 == 0, sql).otherwise(code).alias("x"))
    rows.groupBy("f").agg(F.array_join(F.sort_array(F.collect_list("x")), "\n\n").alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)


def pipeline_tables(spark: SparkSession, folder: str) -> DataFrame:
    """table, reads, expectation of each table that pipeline sources declare, in either language."""
    text = spark.read.text(folder, wholetext=True)
    blocks = text.select(F.explode(F.split("value", r"(?=CREATE OR REFRESH|@dlt\.table)")).alias("b")).where("trim(b) <> ''")
    pick = lambda sql, python: F.coalesce(F.nullif(F.regexp_extract("b", sql, 1), F.lit("")), F.regexp_extract("b", python, 1))
    return blocks.select(pick(r"LIVE TABLE\s+(\w+)", r'@dlt\.table\(name="(\w+)"').alias("table"), pick(r"FROM LIVE\.(\w+)", r'dlt\.read\("(\w+)"').alias("reads"), pick(r"CONSTRAINT (\w+) EXPECT", r'@dlt\.expect\("(\w+)"').alias("expectation"))


def lineage_rows(rows: DataFrame, days: int = 30, catalog: str | None = None) -> DataFrame:
    """from_id, to_id, conn_type of lineage rows (source, target, catalog, event_time) of the last days before the newest row."""
    newest = rows.agg(F.max("event_time").alias("newest"))
    recent = rows.crossJoin(F.broadcast(newest)).where(F.col("event_time") > F.col("newest") - F.expr(f"interval {days} days"))
    recent = recent if catalog is None else recent.where(F.col("catalog") == catalog)
    flow = F.concat(F.lit("flow_"), "source", F.lit("_to_"), "target")
    pairs = recent.select("source", "target", flow.alias("flow")).distinct()
    return pairs.select(F.col("source").alias("from_id"), F.col("flow").alias("to_id"), F.lit("source_read").alias("conn_type")).unionByName(pairs.select(F.col("flow").alias("from_id"), F.col("target").alias("to_id"), F.lit("write_clean").alias("conn_type")))


def zip_archives(files: DataFrame) -> DataFrame:
    """archive, content of rows (archive, member, text): small archives, made where their members meet."""

    def pack(batches):
        for batch in batches:
            names, contents = batch.column("archive").to_pylist(), []
            for members in batch.column("members").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in members:
                        z.writestr(m["member"], m["text"])
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["archive", "content"])

    grouped = files.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("member", "text"))).alias("members"))
    return grouped.mapInArrow(pack, "archive string, content binary")


def zip_members(archives: DataFrame, cap_bytes: int) -> DataFrame:
    """archive, member, size, sha256 of the XML members of archives (archive, content), in their order.

    Folders and other kinds are skipped; from the member on that takes an archive past ``cap_bytes`` nothing is read.
    """

    def unpack(batches):
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows, total = [], 0
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for info in z.infolist():
                        total += info.file_size
                        if total > cap_bytes:
                            break
                        if not info.is_dir() and info.filename.lower().endswith(".xml"):
                            rows.append((info.filename, z.read(info)))
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.binary())], ["archive", "member", "content"])

    found = archives.mapInArrow(unpack, "archive string, member string, content binary")
    return found.select("archive", "member", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
