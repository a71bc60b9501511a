"""Queries over scores, snapshots, labels, users and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import compare, features, requests, score, usage, views
from weftline.plans import code
from weftline.plans.oracle import oracle

_DIMS = list(score.DIMENSIONS)
_PARTS = r""", f_access AS (SELECT sid, count(*) FILTER (role = 'source') AS s, count(*) FILTER (role = 'target') AS t, count(*) FILTER (role = 'lookup') AS l, count(DISTINCT tname) AS d, round(count(DISTINCT tname) / count(*), 6) AS u FROM cat_access GROUP BY sid),
f_typed AS (SELECT node AS sid, count(*) FILTER (conn_type = 'write_conflict') AS w, count(*) FILTER (conn_type = 'chain') AS c, count(*) FILTER (conn_type = 'lookup_stale') AS k FROM conn_ends GROUP BY node),
f_text AS (SELECT sid, count(*) AS n, round(sum(len(regexp_extract_all(expression_text, '\('))) / count(*), 6) AS p FROM cat_expression GROUP BY sid),
f_param AS (SELECT sid, count(DISTINCT p) AS n FROM (SELECT sid, unnest(regexp_extract_all(expression_text, '\$\$\w+')) AS p FROM cat_expression) GROUP BY sid),
f_sql AS (SELECT sid, count(*) FILTER (kind = 'sql_override') AS o, count(*) FILTER (kind <> 'sql_override') AS p, count(*) FILTER (starts_with(sql_text, 'BEGIN')) AS b FROM cat_sql GROUP BY sid),
f_inst AS (SELECT sid, count(*) FILTER (transformation_type = 'Joiner') AS j, count(*) FILTER (transformation_type = 'Filter') AS f, count(*) FILTER (transformation_type = 'Router') AS r FROM cat_instance GROUP BY sid),
f_conn AS (SELECT sid, count(*) AS n FROM cat_connector GROUP BY sid),
f_field AS (SELECT sid, count(DISTINCT x) AS n FROM (SELECT sid, concat(from_instance, '.', from_field) AS x FROM cat_connector UNION ALL SELECT sid, concat(to_instance, '.', to_field) FROM cat_connector) GROUP BY sid) """
_RAW = {
    "transform_volume": "z.transforms", "diversity": "a.d", "risk": "coalesce(ty.w, 0) + coalesce(ty.k, 0)", "io_volume": "a.s + a.t + a.l", "lookup_intensity": "z.lookup_count", "coupling": "cp.n", "structural_depth": "z.tier",
    "external_reads": "z.ext_reads", "expression_complexity": "x.p", "parameter_dependency": "pa.n", "sql_override_complexity": "q.o", "join_complexity": "i.j", "field_mapping_density": "round(ff.n / greatest(z.transforms, 1), 6)",
    "lookup_cache_potential": "0", "error_handling": "i.f + i.r", "schedule_dependency": "0",
}
_FLOORED = "(dimension NOT IN (" + ", ".join(f"'{d}'" for d in score.RANKED_ZEROS) + ") AND value <= 0)"
_COLUMNS = ", ".join(f"max(value) FILTER (dimension = '{d}') AS raw_{d}, round(max(norm) FILTER (dimension = '{d}'), 6) AS norm_{d}" for d in score.COMPLEXITY)
_SCORE = _PARTS + ", f_couple AS (SELECT sid, count(*) AS n FROM (SELECT a AS sid FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY sid), dims AS MATERIALIZED (SELECT z.sid, " + ", ".join(f"CAST(coalesce({_RAW[d]}, 0) AS DOUBLE) AS {d}" for d in score.COMPLEXITY) + """
  FROM cat_s z LEFT JOIN f_access a USING (sid) LEFT JOIN f_typed ty USING (sid) LEFT JOIN f_couple cp USING (sid) LEFT JOIN f_text x USING (sid) LEFT JOIN f_param pa USING (sid) LEFT JOIN f_sql q USING (sid) LEFT JOIN f_inst i USING (sid) LEFT JOIN f_field ff USING (sid)),
long AS (""" + " UNION ALL ".join(f"SELECT sid, {k} AS k, '{d}' AS dimension, CAST({w} AS DOUBLE) AS weight, {d} AS value FROM dims" for k, (d, w) in enumerate(score.COMPLEXITY.items())) + f"""),
placed AS (SELECT *, {_FLOORED} AS zero, count(*) OVER (PARTITION BY dimension, {_FLOORED}) AS n, 100.0 * (rank() OVER (PARTITION BY dimension, {_FLOORED} ORDER BY value) - 1 + (count(*) OVER (PARTITION BY dimension, value) - 1) / 2.0) AS up FROM long),
norms AS MATERIALIZED (SELECT *, round(norm * weight, 6) AS share FROM (SELECT sid, k, dimension, weight, value, CASE WHEN (SELECT count(*) FROM dims) = 1 THEN CAST(50 AS DOUBLE) WHEN zero THEN CAST(0 AS DOUBLE) WHEN n = 1 THEN CAST(50 AS DOUBLE)
  WHEN dimension IN ('diversity', 'structural_depth') THEN CAST(up AS DOUBLE) / (n - 1) ELSE greatest(CAST(1 AS DOUBLE), CAST(up AS DOUBLE) / (n - 1)) END AS norm FROM placed)),
scored AS (SELECT sid, CAST(round(sum(CAST(share AS DECIMAL(18,6))), 2) AS DOUBLE) AS score FROM norms GROUP BY sid),
scores AS (SELECT sid, score, CASE WHEN score < 30 THEN 'low' WHEN score < 55 THEN 'medium' WHEN score < 75 THEN 'high' ELSE 'very_high' END AS bucket,
  CAST(round(CASE WHEN score < 30 THEN 8 WHEN score < 55 THEN 16 WHEN score < 75 THEN 32 ELSE 64 END * 0.7, 2) AS DOUBLE) AS hours FROM scored) """
_LABELS = ", labels AS (SELECT sid, concat(workflow, '.', right(name, 1)) AS cluster FROM cat_names), by_tier AS (SELECT sid, CAST(tier AS VARCHAR) AS cluster FROM tiers) "
_HOURS = {k: " ".join(f"WHEN '{b}' THEN {h[k]}" for b, h in score.HOURS.items()) for k in range(3)}


def _complexity(c):
    rows = features.session_features(c.tiered, c.access, c.connections, None, c.expression, c.sql, c.instance, c.connector)
    return score.complexity_score(score.complexity_inputs(rows, usage.coupling_counts(c.access)))


def _scores(c):
    return _complexity(c).select("sid", "score", "bucket", "hours")


def _labels(c):
    return compare.cluster_by_workflow(c.session)


def _by_tier(c):
    return c.tiers.select("sid", F.col("tier").cast("string").alias("cluster"))


def _profiled(c):
    """Sessions with what their code holds: the fields that snapshots are compared in."""
    language = text.classify_language(F.col("sql_text"))
    held = lambda kind: F.bool_or(language == kind)
    blocks = c.sql.groupBy("sid").agg(F.sum(text.count_loc(F.col("sql_text"))).alias("total_loc"), held("sql").alias("has_embedded_sql"), held("java").alias("has_embedded_java"), held("plsql").alias("has_stored_procedure"))
    calls = c.expression.select("sid", F.explode(text.function_names(F.col("expression_text"))).alias("f")).groupBy("sid").agg(F.count("*").alias("total_functions_used"), F.countDistinct("f").alias("distinct_functions_used"))
    parts = [blocks, calls, code._intents(c).select("sid", F.col("intent").alias("core_intent")), c.expression.groupBy("sid").agg(F.count("*").alias("expression_count")), c.connector.groupBy("sid").agg(F.count("*").alias("field_mapping_count"))]
    rows = reduce(lambda left, right: left.join(right, "sid", "left"), parts, c.tiered)
    return rows.fillna(0, ["total_loc", "total_functions_used", "distinct_functions_used", "expression_count", "field_mapping_count"]).fillna(False, ["has_embedded_sql", "has_embedded_java", "has_stored_procedure"])


def _requests(c):
    """Events as requests: a status from 200 to 497 by the number in their properties."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    return c.table("events").select(F.col("event_type").alias("route"), "ts", F.col("value").alias("ms"), (F.lit(200) + 3 * k).alias("status"))


def _errors(c):
    """Error events by the last digit of their number, side and size."""
    v, k = F.col("value"), F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    side = F.when(F.col("user_id") % 2 == 0, "backend").otherwise("frontend")
    return c.table("events").where("event_type = 'error'").select(F.concat(F.lit("E"), k % 10).alias("type"), side.alias("source"), F.when(v < 20, "warning").when(v < 100, "error").otherwise("critical").alias("severity"))


_ERRORS = r"""WITH e AS (SELECT concat('E', CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) % 10) AS type, CASE WHEN user_id % 2 = 0 THEN 'backend' ELSE 'frontend' END AS source, CASE WHEN value < 20 THEN 'warning' WHEN value < 100 THEN 'error' ELSE 'critical' END AS severity FROM events WHERE event_type = 'error'),
x AS (SELECT type, severity, count(*) AS count FROM e WHERE {where} GROUP BY GROUPING SETS ((type), (severity), ())) SELECT CASE WHEN type IS NOT NULL THEN 'type' WHEN severity IS NOT NULL THEN 'severity' ELSE 'total' END AS dimension, coalesce(type, severity, 'all') AS value, count FROM x"""
_LATENCY = r"""WITH q AS (SELECT *, 200 + 3 * CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS status, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type AS route, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, max(value) FILTER (r = ceil(n * 50 / 100)) AS p50, max(value) FILTER (r = ceil(n * 95 / 100)) AS p95, max(value) FILTER (r = ceil(n * 99 / 100)) AS p99, round(avg(value), 7) AS mean,
round(count(*) / (SELECT greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) FROM events), 9) AS rate FROM q GROUP BY 1"""

_Z = ", ".join(f"round(abs(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1.0 END), 6) AS {c}" for c in _DIMS)
_RULES = [("no_targets", "n_targets = 0", 0.8), ("no_sources", "n_sources = 0", 0.6), ("many_lookups", "lookup_count >= 2", 0.5), ("many_sources", "n_sources >= 3", 0.4), ("all_external", "n_sources > 0 AND ext_reads = n_sources", 0.7), ("deep", "tier >= 10", 0.6), ("heavy", "transforms >= 8", 0.5)]
_FIRED = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {{'w': CAST({w} AS DOUBLE), 'n': '{n}'}} END" for n, c, w in _RULES) + "], lambda x: x IS NOT NULL)"
_STATES = (_PARTS + r""", f_loc AS (SELECT sid, CAST(sum(""" + code._LOC_SQL + """) AS BIGINT) AS n, bool_or(l = 'sql') AS q, bool_or(l = 'java') AS j, bool_or(l = 'plsql') AS p FROM (SELECT *, """ + code._LANGUAGE_SQL + """ AS l FROM (SELECT *, sql_text AS x FROM cat_sql)) GROUP BY sid),
f_calls AS (SELECT sid, count(*) AS n, count(DISTINCT f) AS d FROM (SELECT sid, unnest(regexp_extract_all(upper(expression_text), '([A-Z_][A-Z0-9_]*)\\s*\\(', 1)) AS f FROM cat_expression) GROUP BY sid), f_intent AS (SELECT * FROM (""" + code.INTENT_SQL + """)),
a AS MATERIALIZED (SELECT z.sid, full_name, k, tier, step, transforms, ext_reads, lookup_count, critical, coalesce(lo.n, 0) AS total_loc, coalesce(ca.n, 0) AS total_functions_used, coalesce(ca.d, 0) AS distinct_functions_used, coalesce(lo.q, false) AS has_embedded_sql,
  coalesce(lo.j, false) AS has_embedded_java, coalesce(lo.p, false) AS has_stored_procedure, intent AS core_intent, coalesce(x.n, 0) AS expression_count, coalesce(cc.n, 0) AS field_mapping_count, lookups
  FROM cat_s z LEFT JOIN f_loc lo USING (sid) LEFT JOIN f_calls ca USING (sid) LEFT JOIN f_intent USING (sid) LEFT JOIN f_text x USING (sid) LEFT JOIN f_conn cc USING (sid)),
b AS MATERIALIZED (SELECT * REPLACE (CASE WHEN k % 37 = 0 THEN transforms + 1 ELSE transforms END AS transforms, CASE WHEN k % 41 = 0 THEN 0 ELSE lookup_count END AS lookup_count, CASE WHEN k % 41 = 0 THEN 'added' ELSE lookups END AS lookups, critical <> (k % 43 = 0) AS critical)
  FROM a WHERE k % 29 <> 0 UNION ALL SELECT * REPLACE (concat(full_name, '_new') AS full_name) FROM a WHERE k % 31 = 0) """)

QUERIES = {
    "percentile_norm": (lambda c: score.percentile_norm(c.table("customer"), "c_nationkey").select("c_custkey", F.round("norm", 6).alias("norm")), "WITH c AS (SELECT c_custkey, 100.0 * (rank() OVER (ORDER BY c_nationkey) - 1 + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0) / greatest(count(*) OVER () - 1, 1) AS n FROM customer) SELECT c_custkey, CAST(round(CAST(n AS DOUBLE), 6) AS DOUBLE) AS norm FROM c"),
    "complexity_score": (_complexity, _SCORE + f", wide AS (SELECT sid, {_COLUMNS}, array_to_string(list_slice(list(dimension ORDER BY share DESC, k), 1, 3), ',') AS top_drivers FROM norms GROUP BY sid) SELECT * FROM scores JOIN wide USING (sid)"),
    "complexity_summary": (lambda c: score.complexity_summary(_scores(c)), _SCORE + "SELECT count(*) AS sessions, round(avg(score), 4) AS mean, (SELECT score FROM scores ORDER BY score, sid LIMIT 1 OFFSET (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM scores)) AS median, min(score) AS least, max(score) AS most, round(stddev_pop(score), 4) AS std, round(sum(hours), 2) AS hours FROM scores"),
    "effort_estimate": (lambda c: score.effort_estimate(_scores(c)), _SCORE + f"""SELECT coalesce(bucket, 'all') AS bucket, count(*) AS sessions, CAST(sum(CASE bucket_ {_HOURS[0]} END) AS BIGINT) AS p10, CAST(sum(CASE bucket_ {_HOURS[1]} END) AS BIGINT) AS p50, CAST(sum(CASE bucket_ {_HOURS[2]} END) AS BIGINT) AS p90,
        round(sum(CASE bucket_ {_HOURS[1]} END) / 160.0, 4) AS weeks FROM (SELECT bucket, bucket AS bucket_ FROM scores) GROUP BY ROLLUP (bucket)"""),
    "top_complex": (lambda c: score.top_complex(_scores(c)), _SCORE + "SELECT sid, score, bucket FROM scores ORDER BY score DESC, sid LIMIT 10"),
    "group_complexity": (lambda c: score.group_complexity(_labels(c), _scores(c)), _SCORE + _LABELS + "SELECT cluster, floor((CAST(sum(CAST(round(coalesce(score, 50.0) * 100) AS BIGINT)) AS BIGINT) * 200 + count(*)) / (2 * count(*))) / 10000 AS avg, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in score.HOURS) + " FROM labels LEFT JOIN scores USING (sid) GROUP BY cluster"),
    "composite_heat": (lambda c: score.composite_heat(c.session, usage.node_degree(c.connections), _scores(c)), _SCORE + """, d AS (SELECT sid, transforms, score, (SELECT count(*) FROM conn_ends WHERE node = sid) AS degree FROM cat_names JOIN scores USING (sid))
        SELECT sid, round(0.4 * score / 100 + 0.3 * degree / (SELECT max(degree) FROM d) + 0.3 * transforms / (SELECT max(transforms) FROM d), 6) AS heat FROM d"""),
    "zscore_outliers": (lambda c: score.zscore_outliers(score.features(c.tiered)), f", z AS (SELECT sid, {_Z} FROM cat_session) SELECT * FROM (SELECT sid, greatest({', '.join(_DIMS)}) AS worst, concat_ws(',', {', '.join(f'CASE WHEN {c} > 2.0 THEN {c!r} END' for c in _DIMS)}) AS columns FROM z) WHERE columns <> ''"),
    "rule_anomalies": (lambda c: score.rule_anomalies(score.features(c.tiered)), f", f AS (SELECT sid, {_FIRED} AS fired FROM cat_s) SELECT * FROM (SELECT sid, round(0.7 * list_max(list_transform(fired, lambda x: x.w)) + 0.3 * list_sum(list_transform(fired, lambda x: x.w)) / len(fired), 6) AS score, array_to_string(list_transform(fired, lambda x: x.n), ',') AS types FROM f WHERE len(fired) > 0) WHERE score >= 0.5"),
    "minmax_features": (lambda c: score.minmax_features(score.features(c.tiered)), "SELECT sid, " + ", ".join(f"round(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE CAST({c} AS DOUBLE) END, 6) AS {c}" for c in _DIMS) + " FROM cat_session"),
    "compare_pair": (lambda c: score.compare_pair(score.features(c.tiered), "S25", "S50"), ", p AS (" + " UNION ALL ".join(f"SELECT sid, '{c}' AS dimension, {c} AS value FROM cat_session WHERE sid IN ('S25', 'S50')" for c in _DIMS) + ") SELECT dimension, max(value) FILTER (sid = 'S25') AS a, max(value) FILTER (sid = 'S50') AS b, max(value) AS most FROM p GROUP BY dimension"),
    # differences and merges
    "compare_sessions": (lambda c: compare.compare_sessions(*compare.snapshots(_profiled(c))), _STATES + """SELECT full_name, CASE WHEN a.sid IS NULL THEN 'added' WHEN b.sid IS NULL THEN 'removed' ELSE 'matched' END AS status,
        concat_ws(',', """ + ", ".join(f"CASE WHEN a.sid IS NOT NULL AND b.sid IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f} THEN concat('{f}:', coalesce(CAST(a.{f} AS VARCHAR), 'null'), '>', coalesce(CAST(b.{f} AS VARCHAR), 'null')) END" for f in compare.FIELDS) + """,
        CASE WHEN a.sid IS NOT NULL AND b.sid IS NOT NULL AND a.lookups <> b.lookups THEN concat('lookups:+added', CASE WHEN a.lookups <> '' THEN concat('-', replace(a.lookups, ',', ';')) ELSE '' END) END) AS changes FROM a FULL JOIN b USING (full_name)"""),
    "compare_tables": (lambda c: compare.compare_sets(usage.table_usage(c.access), usage.table_usage(c.access.join(c.base.where("k % 29 <> 0").select("sid"), "sid", "left_semi")), ["tname", "writers", "readers"]), """, after AS (SELECT tname, count(*) FILTER (role = 'target') AS writers, count(*) FILTER (role = 'source') AS readers FROM cat_access JOIN cat_session0 USING (sid) WHERE k % 29 <> 0 GROUP BY tname)
        SELECT *, 'removed' AS status FROM (SELECT tname, writers, readers FROM usage EXCEPT SELECT * FROM after) UNION ALL SELECT *, 'added' FROM (SELECT * FROM after EXCEPT SELECT tname, writers, readers FROM usage)"""),
    "compare_connections": (lambda c: compare.compare_sets(c.connections, c.connections.where("conn_type <> 'lookup_stale'"), ["from_id", "to_id", "conn_type"]), "SELECT *, 'removed' AS status FROM cat_connection WHERE conn_type = 'lookup_stale'"),
    "merge_uploads": (lambda c: compare.merge_uploads(c.base.where("k % 2 = 0"), c.base.where("k % 2 = 1 or k % 3 = 0")), "SELECT sid, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS source FROM cat_session0"),
    "merge_duplicates": (lambda c: compare.merge_duplicates(c.session), "SELECT folder, workflow, targets, sid, members FROM (SELECT *, row_number() OVER (PARTITION BY folder, workflow, targets ORDER BY transforms DESC, sid) AS r, count(*) OVER (PARTITION BY folder, workflow, targets) AS members FROM cat_session) WHERE r = 1"),
    "schema_drift": (lambda c: compare.schema_drift(c.connector.select("sid", F.concat_ws(".", "from_instance", "from_field").alias("field")), c.connector.select("sid", F.concat_ws(".", "to_instance", "to_field").alias("field"))), """, x AS (SELECT DISTINCT sid, concat(from_instance, '.', from_field) AS field FROM cat_connector), y AS (SELECT DISTINCT sid, concat(to_instance, '.', to_field) AS field FROM cat_connector)
        SELECT sid, count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed, count(*) AS fields FROM (SELECT *, 1 AS a FROM x) FULL JOIN (SELECT *, 1 AS b FROM y) USING (sid, field) GROUP BY sid"""),
    # labels
    "cluster_by_tier": (_by_tier, _LABELS + "SELECT * FROM by_tier"),
    "cluster_by_name": (lambda c: compare.cluster_by_name(c.session.select("sid", F.concat("folder", F.lit("_"), "name").alias("name"))), """, p AS (SELECT sid, regexp_replace(concat(folder, '_', name), '_[^_]*$', '') AS c FROM cat_names) SELECT sid, CASE WHEN (SELECT count(DISTINCT c) FROM p) > 500 THEN split_part(c, '_', 1) ELSE c END AS cluster FROM p"""),
    "modularity": (lambda c: compare.modularity(usage.similarity_pairs(c.access), _labels(c)), _LABELS + """, m AS (SELECT sim, x.cluster AS ca, y.cluster AS cb FROM jaccard JOIN labels x ON x.sid = a JOIN labels y ON y.sid = b),
        d AS (SELECT c, sum(sim) AS d FROM (SELECT ca AS c, sim FROM m UNION ALL SELECT cb, sim FROM m) GROUP BY c) SELECT round(sum(sim) FILTER (ca = cb) / sum(sim) - (SELECT sum(d * d) FROM d) / (4 * sum(sim) * sum(sim)), 6) AS modularity FROM m"""),
    "supernode_graph": (lambda c: compare.supernode_graph(usage.similarity_pairs(c.access), _by_tier(c)), _LABELS + """, n AS (SELECT cluster, count(*) AS n FROM by_tier GROUP BY cluster), m AS (SELECT least(x.cluster, y.cluster) AS p, greatest(x.cluster, y.cluster) AS q, sum(sim) AS s, count(*) AS pairs FROM jaccard JOIN by_tier x ON x.sid = a JOIN by_tier y ON y.sid = b WHERE x.cluster <> y.cluster GROUP BY ALL)
        SELECT * FROM (SELECT p AS from_cluster, q AS to_cluster, round(s / (u.n * v.n), 6) AS weight, pairs FROM m JOIN n u ON u.cluster = p JOIN n v ON v.cluster = q) WHERE weight > 0.01"""),
    "pivot_tables": (lambda c: compare.pivot_tables(_by_tier(c), c.access), _LABELS + "SELECT cluster, tname, members FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY members DESC, tname) AS r FROM (SELECT cluster, tname, count(DISTINCT sid) AS members FROM cat_access JOIN by_tier USING (sid) GROUP BY ALL)) WHERE r <= 5"),
    "domain_tables": (lambda c: compare.domain_tables(_by_tier(c), c.access), _LABELS + ", u AS (SELECT cluster, tname, count(DISTINCT sid) AS members FROM cat_access JOIN by_tier USING (sid) GROUP BY ALL), n AS (SELECT cluster, count(*) AS n FROM by_tier GROUP BY cluster) SELECT cluster, tname, CASE WHEN 2 * members > n THEN 'core' ELSE 'peripheral' END AS role, count(*) OVER (PARTITION BY tname) > 1 AS cross FROM u JOIN n USING (cluster)"),
    "co_association": (lambda c: compare.co_association(usage.shared_table_pairs(c.access), [_labels(c), _by_tier(c)]), _LABELS + """, agree AS (SELECT a, b, CAST(x.cluster = y.cluster AS INTEGER) + CAST(u.cluster = v.cluster AS INTEGER) AS n FROM pairs JOIN labels x ON x.sid = a JOIN labels y ON y.sid = b JOIN by_tier u ON u.sid = a JOIN by_tier v ON v.sid = b)
        SELECT a, b, round(n / 2.0, 6) AS fraction FROM agree WHERE n > 0"""),
    # users, uploads, events
    "user_rollup": (lambda c: c.table("customer").join(c.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("uploads"), F.sum(F.col("o_orderkey") % 7).alias("sessions")), "c_custkey", "left").select("c_custkey", F.coalesce("uploads", F.lit(0)).cast("long").alias("uploads"), F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions")), "WITH o AS (SELECT o_custkey, count(*) AS u, CAST(sum(o_orderkey % 7) AS BIGINT) AS s FROM orders GROUP BY 1) SELECT c_custkey, coalesce(u, 0) AS uploads, coalesce(s, 0) AS sessions FROM customer LEFT JOIN o ON o_custkey = c_custkey"),
    "project_rollup": (lambda c: c.table("customer").join(c.table("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_mktsegment").alias("project")).agg(F.count("o_orderkey").alias("upload_count")), "WITH j AS (SELECT c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey) SELECT c_mktsegment AS project, count(o_orderkey) AS upload_count FROM j GROUP BY 1"),
    "uploads_list": (lambda c: c.table("orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(10).limit(25).select("o_orderkey", "o_custkey"), "WITH o AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 10) SELECT o_orderkey, o_custkey FROM o"),
    "route_latency": (lambda c: requests.route_latency(_requests(c)), _LATENCY),
    "error_summary": (lambda c: requests.error_summary(_errors(c)), _ERRORS.replace("{where}", "true")),
    "error_summary_filtered": (lambda c: requests.error_summary(_errors(c), "backend", "critical"), _ERRORS.replace("{where}", "source = 'backend' AND severity = 'critical'")),
    "activity_log": (lambda c: c.table("events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("events")), "WITH e AS (SELECT user_id, event_id FROM events) SELECT user_id, max(event_id) AS last_event, count(*) AS events FROM e GROUP BY 1"),
    # exports
    "export_tickets": (lambda c: c.tiered.join(_scores(c), "sid").select("sid", F.concat(F.lit("Migrate "), "name").alias("summary"), F.when(F.col("critical"), "High").otherwise("Medium").alias("priority"), F.when(F.col("bucket") == "low", 1).when(F.col("bucket") == "medium", 3).when(F.col("bucket") == "high", 5).otherwise(8).alias("points")), _SCORE + "SELECT sid, concat('Migrate ', name) AS summary, CASE WHEN critical THEN 'High' ELSE 'Medium' END AS priority, CASE bucket WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 5 ELSE 8 END AS points FROM cat_s JOIN scores USING (sid)"),
    "export_dot": (lambda c: c.connections.select(F.format_string('  "%s" -> "%s" [label="%s"];', "from_id", "to_id", "conn_type").alias("line")), """SELECT concat('  "', from_id, '" -> "', to_id, '" [label="', conn_type, '"];') AS line FROM cat_connection"""),
    "export_mermaid": (lambda c: c.edges.select(F.format_string("  %s --> %s", "src", "dst").alias("line")), "SELECT concat('  ', src, ' --> ', dst) AS line FROM edges"),
    "doc_table": (lambda c: usage.table_profiles(c.access).select("tname", F.format_string("Table %s: %d writers, %d readers, %d lookup users", "tname", "writer_count", "reader_count", "lookup_count").alias("doc")), "SELECT tname, concat('Table ', tname, ': ', writers, ' writers, ', readers, ' readers, ', lookup_users, ' lookup users') AS doc FROM usage"),
    "doc_session": (lambda c: c.tiered.join(views.explorer_detail(c.session, c.connections), "sid").select("sid", F.format_string("Session %s in tier %d of %s: reads %s; writes %s; %d edges", "name", "tier", "workflow", F.array_join("sources", ","), F.array_join("targets", ","), "total_connections").alias("doc")), "SELECT sid, concat('Session ', name, ' in tier ', tier, ' of ', workflow, ': reads ', sources, '; writes ', targets, '; ', (SELECT count(*) FROM conn_ends WHERE node = sid), ' edges') AS doc FROM cat_s"),
}
