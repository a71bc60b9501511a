"""Queries that run a job first: catalog writes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import sinks
from weftline.shared import shared_dir
from weftline.streaming import events

_NAMES = ["access", "connections", "tables"]


def _written(c):
    """Two uploads written, the first of them twice."""
    path = shared_dir(c.spark, "catalog")
    tables = {"access": c.access, "connections": c.connections, "tables": c.tables}
    for upload in (1, 2, 1):
        sinks.write_catalog(tables, upload, path)
    return path


_COUNTS = "SELECT 'access' AS name, u AS upload_id, count(*) AS rows FROM cat_access, (VALUES (1), (2)) v(u) GROUP BY u UNION ALL SELECT 'connections', u, count(*) FROM cat_connection, (VALUES (1), (2)) v(u) GROUP BY u UNION ALL SELECT 'tables', u, count(*) FROM cat_table, (VALUES (1), (2)) v(u) GROUP BY u"

QUERIES = {
    "write_catalog": (lambda c: sinks.written_counts(c.spark, _written(c), _NAMES), _COUNTS),
    "read_catalog": (lambda c: sinks.read_catalog(c.spark, _written(c), "connections", 2), "SELECT * FROM cat_connection"),
    "delete_upload": (lambda c: sinks.delete_upload(c.spark, _written(c), "access", 1, shared_dir(c.spark, "kept")), "SELECT 1 AS upload_id, count(*) AS removed FROM cat_access"),
    "copy_tables": (lambda c: sinks.copy_tables(c.spark, _written(c), shared_dir(c.spark, "copy"), _NAMES, c.spark.range(2, 3).select(F.col("id").cast("int").alias("upload_id"))), "SELECT 'access' AS name, count(*) AS copied FROM cat_access UNION ALL SELECT 'connections', count(*) FROM cat_connection UNION ALL SELECT 'tables', count(*) FROM cat_table"),
    "stream_route_latency": (lambda c: events.stream_route_latency(c.spark, c.sf_dir).withColumn("start", F.date_format("start", "yyyy-MM-dd")), "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS start, event_type AS route, value, 200 + 3 * CAST(regexp_extract(props, 'k.: *([0-9]+)', 1) AS INTEGER) AS status FROM events) SELECT start, route, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 7) AS mean FROM e GROUP BY ALL"),
    "stream_recent_errors": (lambda c: events.stream_error_counts(c.spark, c.sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error') SELECT day, count(*) AS errors FROM e GROUP BY 1"),
    "recent_errors": (lambda c: events.recent_errors(c.table("events")), "WITH e AS (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT event_id, user_id, value FROM e"),
}
