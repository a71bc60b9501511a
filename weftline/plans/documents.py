"""Queries over documents about the catalog, stored results, exports, and the ingestion stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.operators import docs, views
from weftline.plans.code import HITS_SQL, document_hits
from weftline.plans.scores import _LABELS, _SCORE, _by_tier, _labels, _scores
from weftline.shared import shared_dir
from weftline.streaming import events


def _stats(c):
    return views.catalog_stats(c.tiers, c.tables, c.connections)


def _folders(c):
    return c.session.groupBy("folder").agg(F.count("*").alias("sessions"))


def _indexed(c):
    """Documents of two uploads, the first written twice."""
    path = shared_dir(c.spark, "index")
    parts = {"session": c.session.select(F.col("sid").alias("id"), F.col("full_name").alias("doc")), "table": c.usage.select(F.col("tname").alias("id"), F.col("tname").alias("doc")), "text": c.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("doc"))}
    for upload in (1, 2):
        docs.index_documents(parts, upload, path)
    return docs.index_documents(parts, 1, path)


def _names(c):
    return c.session.select(F.lit("session").alias("kind"), "name").unionByName(c.usage.select(F.lit("table").alias("kind"), F.col("tname").alias("name")))


def _hybrid(c):
    """Documents by the distance of their vectors, and the catalog objects that the question names."""
    near = document_hits(c).withColumn("id", F.col("id").cast("string"))
    named = c.session.select(F.lit("session").alias("type"), F.col("sid").alias("id"), "name").unionByName(c.usage.select(F.lit("table").alias("type"), F.col("tname").alias("id"), F.col("tname").alias("name")))
    return docs.hybrid_search(near, named, "does s_m_25 write l1_3 or L2_7?").select("type", "id", F.round("distance", 6).alias("distance"))


def _answers(c):
    """Answers that name a table and a session each, one an event."""
    e = c.table("events")
    text = F.concat(F.lit("table L1_"), F.col("user_id") % 50, F.lit(" is read by s_m_"), F.col("event_id") % 40, F.lit(", not by l2_"), F.col("event_id") % 30, F.lit("."))
    return docs.extract_references(e.select(F.col("event_id").alias("answer"), text.alias("text")), _names(c))


def _results(c):
    """Two analyses of two uploads, the first written twice."""
    path = shared_dir(c.spark, "results")
    analyses = {"tiers": c.tiers, "scores": _scores(c).select("sid", "score", "bucket")}
    for upload in (1, 2, 1):
        counts = docs.write_results(analyses, upload, path)
    return path, counts


def _sheets(c):
    s = c.tiered.select("sid", "name", "tier", "transforms", "critical")
    return docs.export_sheets({"sessions": s, "tables": c.tables, "connections": c.connections, "statistics": _stats(c), "complexity": _scores(c)}, shared_dir(c.spark, "sheets"))


def _snapshot(c):
    return docs.export_snapshot({"session": (c.session.select("sid", "name", "workflow"), "sid"), "table": (c.usage, "tname")}, shared_dir(c.spark, "snapshot"))


def _entities(c):
    """doc_id, entity: upper-case identifiers of four and more characters, once for each document."""
    return c.table("documents").select("doc_id", F.explode(F.array_distinct(t.entities(F.coalesce("text", F.lit(""))))).alias("entity"))


QUERIES = {
    "doc_group": (lambda c: docs.doc_group(_labels(c), c.access, c.tiers, _scores(c)), _SCORE + _LABELS + """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sid) AS r FROM labels) WHERE r <= 20), hn AS (SELECT cluster, count(*) AS n FROM h GROUP BY cluster),
        u AS (SELECT cluster, string_agg(tname, ',' ORDER BY tname) AS t FROM (SELECT cluster, tname, count(DISTINCT sid) AS m FROM h JOIN cat_access USING (sid) GROUP BY ALL) JOIN hn USING (cluster) WHERE m = n GROUP BY cluster),
        f AS (SELECT cluster, count(*) AS m, min(tier) AS lo, max(tier) AS hi, CAST(floor((CAST(sum(CAST(round(coalesce(score, 50.0) * 100) AS BIGINT)) AS BIGINT) * 2 + count(*)) / (2 * count(*))) AS BIGINT) AS ce FROM labels JOIN tiers USING (sid) LEFT JOIN scores USING (sid) GROUP BY cluster)
        SELECT cluster, concat('Group ', cluster, ': ', m, ' sessions in tiers ', lo, ' to ', hi, ', mean complexity ', ce, ' hundredths, common tables: ', coalesce(t, '')) AS doc FROM f LEFT JOIN u USING (cluster)"""),
    "doc_environment": (lambda c: docs.doc_environment(_stats(c), _folders(c)), """, fo AS (SELECT string_agg(concat(folder, ' ', n), ', ' ORDER BY concat(folder, ' ', n)) AS x FROM (SELECT folder, count(*) AS n FROM cat_names GROUP BY folder))
        SELECT concat((SELECT count(*) FROM tiers), ' sessions in ', (SELECT max(tier) FROM tiers), ' tiers, ', count(*) FILTER (type = 'conflict'), ' conflicts, ', count(*) FILTER (type = 'chain'), ' chains, ', count(*) FILTER (type = 'source'), ' source tables, folders: ', (SELECT x FROM fo)) AS doc FROM cat_table"""),
    "index_documents": (_indexed, "SELECT 'session' AS type, count(*) AS documents FROM cat_names UNION ALL SELECT 'table', count(*) FROM usage UNION ALL SELECT 'text', count(*) FROM documents"),
    "hybrid_search": (_hybrid, ", " + HITS_SQL + """, x AS (SELECT type, CAST(id AS VARCHAR) AS id, distance FROM hits UNION ALL SELECT 'session', sid, 0.0 FROM cat_names WHERE name = 's_m_25' UNION ALL SELECT 'table', tname, 0.0 FROM usage WHERE tname IN ('L1_3', 'L2_7')),
        r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY distance, id) AS r FROM x) SELECT type, id, round(distance, 6) AS distance FROM (SELECT * FROM r WHERE r <= 5 ORDER BY distance, type, id LIMIT 15)"""),
    "extract_references": (_answers, """, w AS (SELECT event_id AS answer, unnest([concat('L1_', user_id % 50), concat('S_M_', event_id % 40), concat('L2_', event_id % 30)]) AS w FROM events)
        SELECT DISTINCT answer, kind, name FROM w JOIN (SELECT 'session' AS kind, name FROM cat_names UNION ALL SELECT 'table', tname FROM usage) ON upper(name) = w"""),
    "extract_entities": (_entities, r"WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9_]{3,}'))) AS e FROM documents) SELECT doc_id, unnest(e) AS entity FROM d"),
    "normalise_detail": (lambda c: docs.normalise_detail(c.expression, c.sql, c.instance), r"""SELECT 'expression' AS kind, sid, concat(transform, '.', field) AS name, expression_text AS detail, len(regexp_extract_all(expression_text, '\(')) AS complexity FROM cat_expression
        UNION ALL SELECT CASE WHEN starts_with(sql_text, 'SELECT') THEN 'sql_select' WHEN starts_with(sql_text, 'BEGIN') THEN 'sql_block' ELSE 'sql_dml' END, sid, transform, sql_text, len(regexp_extract_all(sql_text, '\(')) + len(regexp_extract_all(sql_text, '\bJOIN\b')) FROM cat_sql UNION ALL SELECT 'transform', sid, inst_name, transformation_type, 0 FROM cat_instance"""),
    "write_results": (lambda c: _results(c)[1], "SELECT 'tiers' AS analysis, count(*) AS rows FROM tiers UNION ALL SELECT 'scores', 2 * count(*) FROM cat_names"),
    "result_views": (lambda c: docs.result_view(c.spark, _results(c)[0], 2, "tiers", "tier"), "SELECT CAST(tier AS VARCHAR) AS value, count(*) AS sessions, array_to_string(list(sid ORDER BY sid)[1:20], ',') AS members FROM tiers GROUP BY tier"),
    "export_sheets": (_sheets, "SELECT 'sessions' AS sheet, count(*) AS rows, 5 AS columns FROM cat_names UNION ALL SELECT 'tables', count(*), 6 FROM usage UNION ALL SELECT 'connections', count(*), 3 FROM cat_connection UNION ALL SELECT 'statistics', 1, 6 UNION ALL SELECT 'complexity', count(*), 4 FROM cat_names"),
    "export_snapshot": (_snapshot, """SELECT 'session' AS kind, sid AS id, concat('{"sid":"', sid, '","name":"', name, '","workflow":"', workflow, '"}') AS json FROM cat_names UNION ALL SELECT 'table', tname, concat('{"tname":"', tname, '","writers":', writers, ',"readers":', readers, ',"lookup_users":', lookup_users, '}') FROM usage"""),
    "stream_ingest": (lambda c: events.stream_ingest(c.spark, c.table("documents").select(F.coalesce("text", F.lit("")).alias("value"))), "WITH d AS (SELECT sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS size FROM documents) SELECT sha256, any_value(size) AS size FROM d GROUP BY sha256"),
}
