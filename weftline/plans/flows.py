"""Queries over flow templates, jobs, pipeline code, lineage rows and archives that are written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.shared import shared_dir
from weftline.sources import flows

#: Bytes that are read of an archive at most.
CAP = 500 << 20


def _orders(c):
    return c.table("orders").select(F.col("o_orderkey").alias("k"))


def _flows(c):
    path = shared_dir(c.spark, "flows")
    flows.write_flows(c.spark, _orders(c), path)
    return path


def _jobs(c):
    path = shared_dir(c.spark, "jobs")
    flows.write_jobs(_orders(c), _first_lines(c), path)
    return path


def _first_lines(c):
    """One line for each order and line number: that of the least part."""
    rows = c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.col("m.l_partkey").alias("l_partkey"), F.col("m.l_suppkey").alias("l_suppkey"))


def _pipelines(c):
    path = shared_dir(c.spark, "pipelines")
    flows.write_pipelines(_orders(c), path)
    return path


def _lineage(c):
    rows = c.table("events").select(F.concat(F.lit("a.s"), F.col("user_id") % 30).alias("source"), F.concat(F.lit("b.t"), F.col("event_id") % 40).alias("target"), F.lit("a").alias("catalog"), F.col("ts").alias("event_time"))
    return flows.lineage_rows(rows, 30, "a")


def _archives(c):
    """Documents as members of archives, about fifty each; every fifth is no XML."""
    d = c.table("documents")
    member = F.concat(F.format_string("%012d", "doc_id"), F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".xml"))
    return flows.zip_archives(d.select(F.concat(F.lit("a"), F.floor(F.col("doc_id") / 50).cast("long")).alias("archive"), member.alias("member"), F.coalesce("text", F.lit("")).alias("text")))


_PROCESSORS = "WITH k AS (SELECT o_orderkey AS k FROM orders), "
_FIRST = "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, arg_min(l_suppkey, (l_partkey, l_suppkey)) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) "

QUERIES = {
    "src_flow_xml": (lambda c: flows.flow_links(c.spark, _flows(c)), _PROCESSORS + "n AS (SELECT 1 AS n, 'QueryDatabaseTable_' AS a, 'JoltTransform_' AS b UNION ALL SELECT 2, 'JoltTransform_', 'PutDatabaseRecord_') SELECT concat(a, k) AS src, CASE WHEN k % 10 = 0 THEN '0123456789ab' ELSE concat(b, k) END AS dst, 'success' AS relationship FROM k, n"),
    "src_flow_services": (lambda c: flows.flow_services(c.spark, _flows(c)), _PROCESSORS + "x AS (SELECT 1) SELECT concat('QueryDatabaseTable_', k) AS processor, 'Pool' AS property, concat('Pool_', k % 5) AS service, 'Pool' AS service_type FROM k"),
    "src_flow_parameters": (lambda c: flows.flow_parameters(c.spark, _flows(c)), _PROCESSORS + "x AS (SELECT 1) SELECT concat('ctx ', k) AS context, 'Batch-Size' AS key, CAST(k AS VARCHAR) AS value, 'numeric' AS inferred_type, concat('ctx_', k, '_batch_size') AS variable FROM k UNION ALL SELECT concat('ctx ', k), 'db.password', '', 'secret', concat('ctx_', k, '_db_password') FROM k UNION ALL SELECT concat('ctx ', k), 'region', 'eu', 'string', concat('ctx_', k, '_region') FROM k"),
    "ext_flow_resources": (lambda c: flows.flow_resources(c.spark, _flows(c)), _PROCESSORS + "x AS (SELECT 1) SELECT concat('QueryDatabaseTable_', k) AS processor, 'source' AS class, concat('SRC_', k % 50) AS resource FROM k UNION ALL SELECT concat('JoltTransform_', k), 'transform', NULL FROM k UNION ALL SELECT concat('PutDatabaseRecord_', k), 'sink', concat('DW_', k % 50) FROM k"),
    "src_job_json": (lambda c: flows.job_edges(c.spark, _jobs(c)), _FIRST + """SELECT concat('raw.s', s % 20) AS from_id, concat('job_', k, '_t', n) AS to_id, 'source_read' AS conn_type FROM l UNION SELECT 'raw.r', concat('job_', k, '_t', n), 'source_read' FROM l WHERE n % 2 = 1
        UNION SELECT concat('job_', k, '_t', n), concat('dw.t', p % 50), 'write_clean' FROM l WHERE n % 2 = 0 UNION SELECT concat('job_', k, '_t', n - 1), concat('job_', k, '_t', n), 'chain' FROM l WHERE n > 1"""),
    "src_pipeline_code": (lambda c: flows.pipeline_tables(c.spark, _pipelines(c)), _PROCESSORS + "x AS (SELECT 1) SELECT concat('t', k) AS \"table\", concat('t', k + 1) AS reads, concat('ok_', k) AS expectation FROM k"),
    "src_lineage_rows": (_lineage, "WITH e AS (SELECT DISTINCT concat('a.s', user_id % 30) AS s, concat('b.t', event_id % 40) AS t FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAYS) SELECT s AS from_id, concat('flow_', s, '_to_', t) AS to_id, 'source_read' AS conn_type FROM e UNION ALL SELECT concat('flow_', s, '_to_', t), t, 'write_clean' FROM e"),
    "src_zip_members": (lambda c: flows.zip_members(_archives(c), CAP), f"""WITH d AS (SELECT doc_id, concat('a', CAST(floor(doc_id / 50) AS BIGINT)) AS archive, coalesce(text, '') AS x, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY floor(doc_id / 50) ORDER BY doc_id) AS upto FROM documents)
        SELECT archive, concat(lpad(CAST(doc_id AS VARCHAR), 12, '0'), '.xml') AS member, octet_length(encode(x)) AS size, sha256(x) AS sha256 FROM d WHERE upto <= {CAP} AND doc_id % 5 <> 0"""),
}
