"""Queries over mapping exports that are written from the catalog and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.shared import exists, shared_dir, version
from weftline.sources import mappings as m

_PATHS: dict[tuple, str] = {}


def _path(c) -> str:
    """The exports of the whole catalog, written once a session and input folder."""
    key = (c.spark.sparkContext.applicationId, *version(c.spark, c.sf_dir, "orders", "lineitem", "part"))
    if key not in _PATHS or not exists(c.spark, [_PATHS[key]]):
        path = shared_dir(c.spark, "mapping-exports")
        m.write_exports(c.base, c.access, path)
        _PATHS[key] = path
    return _PATHS[key]


def _on(operator):
    return lambda c: operator(m.read_folders(c.spark, _path(c)))


def _platforms(c):
    """Platforms that the exports are taken for; their number of files depends on the cluster."""
    return m.classify_platform(c.spark, _path(c)).groupBy("platform").agg((F.count("*") > 0).alias("any"))


_BATCH = ", b AS (SELECT sid, k, CAST(floor(k / 20) AS BIGINT) AS b, concat('s_m_', k) AS session FROM cat_session0) "
_LOOKED = ", looked AS (SELECT DISTINCT b % 7 AS f, concat('lkp_', tname) AS transform, upper(tname) AS tname FROM cat_access JOIN (SELECT sid, CAST(floor(k / 20) AS BIGINT) AS b FROM cat_session0) USING (sid) WHERE role = 'lookup') "
_LIST = "coalesce((SELECT array_to_string(list_sort(list_distinct(list({name}))), ',') FROM cat_access a WHERE a.sid = s.sid AND role = '{role}'), '') AS {role}s"

#: Places of a batch's sessions in its worklets, and which worklets (mapplets) each reaches.
_HELD = """(SELECT 0 AS root, 0 AS i UNION ALL SELECT 0, 1 UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 1 UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 2)"""
_CIRCLE = """(SELECT x.root, y.i FROM (VALUES (0), (1), (2)) x(root), (VALUES (0), (1), (2)) y(i))"""
_WORKLETS = _BATCH + f""", w AS (SELECT b, session, CAST(floor(k % 20 / 5) AS INTEGER) AS i FROM b WHERE k % 20 < 15)
SELECT DISTINCT concat('wl_', b, '_', root) AS worklet, session FROM w JOIN {_HELD} h USING (i) WHERE b % 2 <> 0 UNION SELECT concat('wl_', b, '_', root), session FROM w JOIN {_CIRCLE} c USING (i) WHERE b % 2 = 0"""
_MAPPLETS = _BATCH + """, u AS (SELECT concat('m_', k) AS mapping, b, k % 6 = 0 AS outer_ FROM b WHERE k % 3 = 0)
SELECT mapping, 'target' AS role, concat('MT_', b) AS tname FROM u UNION ALL SELECT mapping, 'source', concat('MS_', b) FROM u WHERE outer_ OR b % 3 = 0 UNION ALL SELECT mapping, 'lookup', concat('ML_', b) FROM u WHERE outer_ OR b % 3 = 0"""
_CONDITIONS = """, s AS (SELECT k, concat('m_', k) AS mapping FROM cat_session0)
SELECT mapping, concat('JNR_', k) AS transform, 'join' AS kind, concat('A.id = B.id', k % 4) AS text, 'Normal Join' AS extra FROM s WHERE k % 3 = 0
UNION ALL SELECT mapping, concat('FIL_', k), 'filter', concat('AMT < ', k % 100), '' FROM s WHERE k % 4 = 1 UNION ALL SELECT mapping, concat('SQ_', k), 'sql', concat('SELECT a FROM T', k % 9), '' FROM s WHERE k % 6 = 4
UNION ALL SELECT mapping, concat('RTR_', k), 'router', concat('X = ', k % 7), 'G1' FROM s WHERE k % 5 = 2 UNION ALL SELECT mapping, concat('RTR_', k), 'router', '', 'DEFAULT1' FROM s WHERE k % 5 = 2
UNION ALL SELECT NULL, concat('lkp_', tname), 'sql', concat('SELECT a FROM ', tname), '' FROM cat_access WHERE role = 'lookup' AND ascii(right(tname, 1)) % 2 = 1"""

QUERIES = {
    "src_repository_meta": (lambda c: m.repository_meta(c.spark, _path(c)), _BATCH + "SELECT concat('REP_', f % 3) AS name, '1' AS version, 'UTF-8' AS codepage, 'Oracle' AS database_type, count(DISTINCT f) AS files FROM (SELECT CAST(floor(b / 25) AS BIGINT) AS f FROM b) GROUP BY f % 3"),
    "src_classify_platform": (_platforms, "SELECT 'mapping' AS platform, true AS \"any\""),
    "ingest_audit": (lambda c: m.ingest_audit(c.spark, _path(c)), _BATCH + "SELECT s AS status, count(DISTINCT b) AS folders, count(*) AS sessions FROM b, (VALUES ('ok'), ('all')) v(s) GROUP BY s"),
    "ext_worklet_sessions": (_on(m.worklet_sessions), _WORKLETS),
    "ext_mapplet_expand": (_on(m.mapplet_tables), _MAPPLETS),
    "ext_conditions": (_on(m.conditions), _CONDITIONS),
    "ext_lookup_tables": (_on(m.lookup_tables), _LOOKED + "SELECT concat('F', f) AS folder, transform, tname FROM looked"),
    "ext_mapping_tables": (_on(m.mapping_tables), "SELECT concat('m_', k) AS mapping, " + ", ".join(_LIST.format(role=r, name="upper(tname)" if r == "lookup" else "tname") for r in ("source", "target", "lookup")) + " FROM cat_session0 s WHERE sid IN (SELECT sid FROM cat_access) OR k % 3 = 0"),
    "ext_connectors": (_on(m.connectors), "SELECT concat('m_', k) AS mapping, concat('SQ_', s.tname) AS from_instance, 'id' AS from_field, concat('TGT_', t.tname) AS to_instance, 'id' AS to_field FROM cat_access s JOIN cat_access t ON s.sid = t.sid AND s.role = 'source' AND t.role = 'target' JOIN cat_session0 z ON z.sid = s.sid"),
    "ext_mapping_catalog": (_on(m.mapping_catalog), _BATCH + """SELECT concat('m_', k) AS mapping, concat('F', b % 7) AS folder, k % 13 <> 0 AS valid, (SELECT count(*) FROM cat_access a WHERE a.sid = b.sid) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS instances,
        (SELECT count(*) FILTER (role = 'source') * count(*) FILTER (role = 'target') FROM cat_access a WHERE a.sid = b.sid) AS connectors, session AS sessions FROM b"""),
    "ext_session_attributes": (_on(m.session_attributes), _BATCH + "SELECT session, 'Commit Interval' AS name, CAST(k % 5 * 1000 AS VARCHAR) AS value, concat('C', k % 11) AS connections FROM b UNION ALL SELECT session, 'Pre SQL', concat('DELETE FROM T', k), concat('C', k % 11) FROM b WHERE k % 4 = 0"),
    "ext_session_overrides": (_on(m.session_overrides), _BATCH + "SELECT session, 'target' AS role, concat('OVR_', k) AS tname FROM b WHERE k % 7 = 0 AND k % 11 <> 0"),
    "ext_pre_post_sql": (_on(m.pre_post_sql), _BATCH + "SELECT session, 'pre' AS kind, concat('DELETE FROM T', k) AS \"sql\" FROM b WHERE k % 4 = 0"),
    "ext_workflow_edges": (_on(m.workflow_edges), _BATCH + "SELECT concat('wf_b', b) AS workflow, CASE k % 20 WHEN 0 THEN 'Start' ELSE concat('s_m_', k - 1) END AS from_task, session AS to_task, CASE k % 3 WHEN 0 THEN 'Status = SUCCEEDED' ELSE '' END AS condition FROM b"),
    "ext_workflow_order": (lambda c: m.workflow_order(m.workflow_edges(m.read_folders(c.spark, _path(c))), graph.session_tiers), _BATCH + ", t AS (SELECT b, k, session FROM b UNION SELECT b, k - 1, concat('s_m_', k - 1) FROM b WHERE k % 20 <> 0) SELECT concat('wf_b', b) AS workflow, session AS task, row_number() OVER (PARTITION BY b ORDER BY k) AS step FROM t"),
    "ext_config_usage": (_on(m.config_usage), ", g AS (SELECT k % 3 AS i, count(*) AS n FROM cat_session0 GROUP BY k % 3) SELECT concat('cfg_', i) AS config, concat('Tracing=', i) AS attributes, coalesce(n, 0) AS sessions FROM range(3) r(i) LEFT JOIN g USING (i)"),
    "ext_schedules": (_on(m.schedules), _BATCH + "SELECT session, concat('sch_', b % 4) AS scheduler, CASE b % 4 WHEN 0 THEN 'Daily' ELSE 'Weekly' END AS frequency FROM b"),
    "ext_connection_profiles": (_on(m.connection_profiles), "SELECT concat('C', k % 11) AS connection, 'Oracle' AS subtype, count(*) AS sessions FROM cat_session0 GROUP BY k % 11"),
    "ext_definitions": (_on(m.definitions), "SELECT DISTINCT role AS kind, tname AS name, CASE role WHEN 'source' THEN 'Oracle' ELSE 'Teradata' END AS database, CASE role WHEN 'source' THEN 'id:integer:PRIMARY KEY' ELSE 'id:integer:NOT A KEY' END AS fields FROM cat_access WHERE role <> 'lookup'"),
}
