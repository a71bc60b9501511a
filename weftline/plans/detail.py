"""Queries over session features, drill-down views, rankings, merges and operators on labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import drill, features, usage
from weftline.plans.code import HITS_SQL, document_hits
from weftline.plans.lineage import START, TABLE, start_of
from weftline.plans.scores import _LABELS, _PARTS, _SCORE, _by_tier, _labels, _scores

#: What the sample queries ask for.
WORKFLOW, PREFIX = "wf_3", "s_m_1"




def _features(c):
    return features.session_features(c.tiered, c.access, c.connections, c.edges, c.expression, c.sql, c.instance, c.connector)


_FEATURES = _PARTS + r""", f_up AS (SELECT dst AS sid, count(*) AS n FROM edges GROUP BY dst), f_down AS (SELECT src AS sid, count(*) AS n FROM edges GROUP BY src),
feat AS (SELECT z.sid, z.tier AS tier, z.transforms AS transform_count, z.ext_reads, z.lookup_count, a.s AS source_table_count, a.t AS target_table_count, a.l AS lookup_table_count, a.d AS total_table_footprint, a.u AS unique_table_ratio,
  CAST(z.critical AS INTEGER) AS is_critical, up.n AS upstream_count, dn.n AS downstream_count, z.tier AS dependency_depth, ty.w AS write_conflict_count, ty.c AS chain_involvement, ty.k AS staleness_risk, x.n AS expression_count, pa.n AS parameter_count,
  q.o AS sql_override_count, i.j AS join_count, i.f AS filter_count, i.r AS router_group_count, 0 AS lookup_cache_potential, ff.n AS field_count, cc.n AS connector_count, 0 AS mapplet_usage, 0 AS worklet_nesting_depth, 0 AS schedule_frequency_code,
  0 AS command_task_count, q.b AS stored_procedure_count, x.p AS expression_complexity_score, q.p AS pre_post_sql_count
  FROM cat_s z LEFT JOIN f_access a USING (sid) LEFT JOIN f_typed ty USING (sid) LEFT JOIN f_up up USING (sid) LEFT JOIN f_down dn USING (sid) LEFT JOIN f_text x USING (sid) LEFT JOIN f_param pa USING (sid) LEFT JOIN f_sql q USING (sid)
  LEFT JOIN f_inst i USING (sid) LEFT JOIN f_conn cc USING (sid) LEFT JOIN f_field ff USING (sid)),
features AS (SELECT sid, """ + ", ".join(f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" for n in features.NAMES) + " FROM feat) "


def _group_drill(c, part):
    return drill.group_drill(c.tiered, c.edges, c.session.select("sid", F.col("workflow").alias("cluster")), _by_tier(c), _scores(c), WORKFLOW)[part]


def _scope_drill(c, part):
    return drill.scope_drill(c.session, c.edges, c.cycles, F.col("name").startswith(PREFIX))[part]


def _tags(c):
    """Tags on sessions and tables, one an event."""
    e = c.table("events")
    kind = F.when(F.col("event_id") % 2 == 0, "session").otherwise("table")
    target = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("S"), F.col("user_id"))).otherwise(F.concat(F.lit("L1_"), F.col("user_id") % 100))
    return e.select(F.col("event_id").alias("tag_id"), F.col("event_type").alias("tag_type"), kind.alias("object_type"), target.alias("object_id"), F.col("ts").alias("created"))


def _tagged(c):
    objects = c.session.select(F.lit("session").alias("object_type"), F.col("sid").alias("object_id")).unionByName(c.usage.select(F.lit("table").alias("object_type"), F.col("tname").alias("object_id")))
    return drill.tag_objects(objects, _tags(c), "error")


def _cluster_page(c):
    from weftline.operators import compare

    summary = c.tiered.join(_labels(c), "sid").groupBy("cluster").agg(F.count("*").alias("sessions"), F.min("tier").alias("first_tier"))
    return drill.cluster_page(summary, compare.pivot_tables(_labels(c), c.access), "L2_1", [F.desc("sessions"), F.col("first_tier"), F.col("cluster")], 20)


def _ranked(c):
    degree = usage.node_degree(c.connections).where("conn_type = 'all'").select(F.col("node_id").alias("sid"), "degree")
    rows = c.tiered.join(degree, "sid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    out = None
    for mode in ("criticality", "reach", "name", "contested"):
        part = drill.rank_sessions(rows, mode, 10).select(F.lit(mode).alias("mode"), "sid")
        out = part if out is None else out.unionByName(part)
    return out


_RANKED = ", d AS (SELECT s.sid, name, tier, critical, (SELECT count(*) FROM conn_ends WHERE node = s.sid) AS degree FROM cat_s s) " + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, sid FROM (SELECT sid FROM d ORDER BY {order}, sid LIMIT 10)" for mode, order in (("criticality", "degree DESC"), ("reach", "tier DESC"), ("name", "name"), ("contested", "critical DESC, degree DESC")))


def _hits(c):
    """Documents by the cosine distance of their vectors to the first one; some hits come twice."""
    d = document_hits(c)
    return d.unionByName(d.where("id % 3 = 0"))


def _platform(c, remainder):
    """A catalog with numeric ids: every second nation's customers, part size and order is of one of two platforms."""
    sessions = c.table("customer").where(F.col("c_nationkey") % 2 == remainder).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    tables = c.table("part").where(F.col("p_size") % 2 == remainder).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("tname"))
    links = c.table("orders").join(c.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("o_orderkey") % 2 == remainder)
    return {"sessions": sessions, "tables": tables, "connections": links.select(F.col("o_custkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_linestatus").alias("conn_type"))}


def _merged(c, part):
    return drill.merge_platforms(_platform(c, 0), _platform(c, 1))[part]


_SHIFT = "WITH s AS (SELECT coalesce(max(c_custkey), -1) + 1 AS s FROM customer WHERE c_nationkey % 2 = 0), t AS (SELECT coalesce(max(p_partkey), -1) + 1 AS t FROM part WHERE p_size % 2 = 0) "


def _session_parts(c):
    """Session lists of three files: a table's rows lie in the file of its name's last digit."""
    rows = c.session.select("sid", "full_name", "workflow").join(c.access, "sid", "left")
    file = F.coalesce(F.ascii(F.substring("tname", -1, 1)) % 3, F.lit(0))
    return rows.select(file.alias("file"), "full_name", F.when(file > 0, F.col("workflow")).alias("workflow"), "tname")


def _profiles(c):
    s = c.table("supplier")
    profiles = s.select(F.concat(F.lit("c"), "s_suppkey").alias("connection"), F.concat(F.lit("sys"), F.col("s_nationkey") % 7).alias("system"), F.concat(F.lit("host"), "s_suppkey").alias("host"), F.concat(F.lit("db"), F.col("s_suppkey") % 5).alias("database"))
    return drill.connection_topology(profiles, c.lines.select("sid", F.concat(F.lit("c"), "l_suppkey").alias("connection")).distinct())


_SYSTEMS = ", cat_link AS (SELECT DISTINCT sid, l_suppkey FROM cat_line), on_system AS (SELECT DISTINCT sid, concat('sys', s_nationkey % 7) AS system FROM cat_link JOIN supplier ON l_suppkey = s_suppkey) "


def _orphans(c):
    return drill.assign_orphans(c.access, _labels(c).where(F.substring("sid", -1, 1) != "7"), c.base)


_ORPHANS = _LABELS + """, known AS (SELECT * FROM labels WHERE right(sid, 1) <> '7'), lost AS (SELECT sid FROM cat_session0 WHERE right(sid, 1) = '7' OR sid NOT IN (SELECT sid FROM labels)), held AS (SELECT DISTINCT sid, tname FROM cat_access),
places AS (SELECT DISTINCT tname, cluster FROM held JOIN known USING (sid)), n AS (SELECT sid, cluster, count(*) AS n FROM held JOIN lost USING (sid) JOIN places USING (tname) GROUP BY ALL),
best AS (SELECT sid, cluster FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, cluster) AS r FROM n) WHERE r = 1) SELECT * FROM known UNION ALL SELECT sid, coalesce(cluster, concat('own:', sid)) FROM lost LEFT JOIN best USING (sid)"""


def _points(c):
    """Sessions as points: order date within the year and price."""
    o = c.table("orders")
    return o.select(F.concat(F.lit("S"), "o_orderkey").alias("sid"), (F.dayofyear("o_orderdate") / 366).alias("x"), (F.col("o_totalprice") % 1000 / 1000).alias("y"))


_POINTS = ", points AS (SELECT concat('S', o_orderkey) AS sid, dayofyear(o_orderdate) / 366 AS x, o_totalprice % 1000 / 1000 AS y FROM orders) "


def _majority(c):
    return drill.majority_consensus([_labels(c), _by_tier(c), c.session.select("sid", F.col("folder").alias("cluster"))])


def _vote_sql(k, table):
    return f"m{k} AS (SELECT l.cluster AS base, t.cluster AS c, count(*) AS m FROM labels l JOIN {table} t USING (sid) GROUP BY ALL), b{k} AS (SELECT base, c FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY m DESC, c) AS r FROM m{k}) WHERE r = 1), h{k} AS (SELECT sid FROM labels l JOIN {table} t USING (sid) JOIN b{k} ON base = l.cluster AND c = t.cluster)"


_MAJORITY = _LABELS + ", folders AS (SELECT sid, folder AS cluster FROM cat_names), " + _vote_sql(1, "by_tier") + ", " + _vote_sql(2, "folders") + """ SELECT sid, cluster, agreement, agreement < 0.5 AS contested FROM (SELECT sid, cluster,
    round((1 + CAST(sid IN (SELECT sid FROM h1) AS INTEGER) + CAST(sid IN (SELECT sid FROM h2) AS INTEGER)) / 3, 6) AS agreement FROM labels)"""


def _closest(c):
    """sid, sim: the similarity of each session's most similar other one."""
    return usage.similarity_pairs(c.access).select(F.explode(F.array("a", "b")).alias("sid"), "sim").groupBy("sid").agg(F.max("sim").alias("sim"))


_RULES = [("no_upstream", "upstream_count = 0"), ("no_downstream", "downstream_count = 0"), ("no_conflict", "write_conflict_count = 0"), ("no_chain", "chain_involvement = 0"), ("no_staleness", "staleness_risk = 0"), ("not_similar", "coalesce(sim, 0) < 0.2")]
_INDEPENDENT = _FEATURES + """, closest AS (SELECT sid, max(sim) AS sim FROM (SELECT a AS sid, sim FROM jaccard UNION ALL SELECT b, sim FROM jaccard) GROUP BY sid),
r AS (SELECT sid, coalesce(sim, 0) AS sim, list_filter([""" + ", ".join(f"CASE WHEN {rule} THEN '{n}' END" for n, rule in _RULES) + """], lambda x: x IS NOT NULL) AS r FROM features LEFT JOIN closest USING (sid))
SELECT sid, CASE WHEN len(r) = 6 THEN 'full' ELSE 'near' END AS type, round(len(r) / 6.0, 6) AS confidence, array_to_string(r, ',') AS reasons FROM r WHERE len(r) >= 4 AND sim < 0.2"""


def _exemplars(c):
    """Every session whose number ends in 3 is an exemplar."""
    return c.base.where(F.substring("sid", -1, 1) == "3").select("sid")


QUERIES = {
    "session_features": (_features, _FEATURES + "SELECT * FROM features"),
    "group_drill": (lambda c: _group_drill(c, "sessions"), _SCORE + _LABELS + f"SELECT s.sid, s.name, b.cluster AS meso, score FROM cat_names s LEFT JOIN by_tier b USING (sid) LEFT JOIN scores USING (sid) WHERE workflow = '{WORKFLOW}'"),
    "group_drill_edges": (lambda c: _group_drill(c, "edges"), f"SELECT src, dst FROM edges WHERE src IN (SELECT sid FROM cat_names WHERE workflow = '{WORKFLOW}') OR dst IN (SELECT sid FROM cat_names WHERE workflow = '{WORKFLOW}')"),
    "group_drill_clusters": (lambda c: _group_drill(c, "clusters"), _SCORE + _LABELS + f"SELECT b.cluster AS meso, count(*) AS sessions, CAST(round(avg(CAST(coalesce(score, 50) AS DECIMAL(12,2))), 2) AS DOUBLE) AS score FROM cat_names s LEFT JOIN by_tier b USING (sid) LEFT JOIN scores USING (sid) WHERE workflow = '{WORKFLOW}' GROUP BY b.cluster"),
    "scope_drill": (lambda c: _scope_drill(c, "edges"), f"SELECT src, dst FROM edges WHERE src IN (SELECT sid FROM cat_names WHERE starts_with(name, '{PREFIX}')) AND dst IN (SELECT sid FROM cat_names WHERE starts_with(name, '{PREFIX}'))"),
    "scope_drill_cycles": (lambda c: _scope_drill(c, "cycles"), f", g AS (SELECT grp FROM scc GROUP BY grp HAVING count(*) > 1 UNION SELECT s.grp FROM edges JOIN scc s ON s.node = src WHERE src = dst) SELECT grp AS \"group\", node FROM scc WHERE grp IN (SELECT * FROM g) AND grp IN (SELECT x.grp FROM scc x JOIN cat_names ON sid = x.node WHERE starts_with(name, '{PREFIX}'))"),
    "session_blueprint": (lambda c: drill.session_blueprint(c.tiered, c.edges, _scores(c), start_of(c).select(F.col("node").alias("sid"))), _SCORE + f"""SELECT sid, name, tier, score, direction, other FROM cat_names JOIN tiers USING (sid) JOIN scores USING (sid) LEFT JOIN (SELECT dst AS sid, 'upstream' AS direction, src AS other FROM edges UNION ALL SELECT src, 'downstream', dst FROM edges) USING (sid) WHERE sid = {START}"""),
    "object_detail": (lambda c: drill.object_detail(c.tables, c.connections, TABLE), f"""SELECT t.tname, type, tier, relation, sid FROM cat_table t LEFT JOIN (SELECT from_id AS tname, 'reads' AS relation, to_id AS sid FROM cat_connection WHERE conn_type = 'source_read' UNION ALL SELECT to_id, 'writes', from_id FROM cat_connection) USING (tname) WHERE t.tname = '{TABLE}'"""),
    "tag_objects": (_tagged, """, tag AS (SELECT event_id AS tag_id, CASE WHEN event_id % 2 = 0 THEN 'session' ELSE 'table' END AS object_type, CASE WHEN event_id % 2 = 0 THEN concat('S', user_id) ELSE concat('L1_', user_id % 100) END AS object_id, ts FROM events WHERE event_type = 'error'),
        o AS (SELECT 'session' AS object_type, sid AS object_id FROM cat_names UNION ALL SELECT 'table', tname FROM usage) SELECT object_type, object_id, count(tag_id) AS n_tags, max_by(tag_id, (ts, tag_id)) AS latest FROM o LEFT JOIN tag USING (object_type, object_id) GROUP BY ALL"""),
    "cluster_page": (_cluster_page, _LABELS + """, p AS (SELECT cluster, tname, row_number() OVER (PARTITION BY cluster ORDER BY count(DISTINCT sid) DESC, tname) AS r FROM cat_access JOIN labels USING (sid) GROUP BY cluster, tname), s AS (SELECT cluster, count(*) AS sessions, min(tier) AS first_tier FROM labels JOIN tiers USING (sid) GROUP BY cluster)
        SELECT * FROM s WHERE contains(lower(cluster), 'l2_1') OR cluster IN (SELECT cluster FROM p WHERE r <= 5 AND contains(lower(tname), 'l2_1')) ORDER BY sessions DESC, first_tier, cluster LIMIT 20"""),
    "rank_sessions": (_ranked, _RANKED),
    "per_type_topk": (lambda c: drill.per_type_topk(_hits(c)), "WITH " + HITS_SQL + ", h AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY distance, id) AS r FROM hits) SELECT type, id, distance FROM h WHERE r <= 5 ORDER BY distance, type, id LIMIT 15"),
    "merge_platforms": (lambda c: _merged(c, "connections"), _SHIFT + ", l AS (SELECT o_orderkey % 2 AS r, o_custkey, l_partkey, l_linestatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_custkey + CASE r WHEN 1 THEN s ELSE 0 END AS from_id, l_partkey + CASE r WHEN 1 THEN t ELSE 0 END AS to_id, l_linestatus AS conn_type FROM l, s, t WHERE r < 2"),
    "merge_platforms_stats": (lambda c: _merged(c, "stats"), _SHIFT + "SELECT CAST(r + 1 AS INTEGER) AS platform, count(*) AS sessions, max(id) AS last_id FROM (SELECT c_nationkey % 2 AS r, c_custkey + CASE c_nationkey % 2 WHEN 1 THEN s ELSE 0 END AS id FROM customer, s) WHERE r < 2 GROUP BY r"),
    "merge_session_lists": (lambda c: drill.merge_session_lists(_session_parts(c)), """, p AS (SELECT n.sid, full_name, workflow, tname, coalesce(ascii(right(tname, 1)) % 3, 0) AS file FROM cat_names n LEFT JOIN cat_access a USING (sid)) SELECT full_name, any_value(workflow) FILTER (file > 0) AS workflow, coalesce(array_to_string(list_sort(list_distinct(list(tname) FILTER (tname IS NOT NULL))), ','), '') AS tables FROM p GROUP BY full_name"""),
    "connection_topology": (lambda c: _profiles(c)["nodes"], _SYSTEMS + "SELECT concat('sys', s_nationkey % 7) AS system, concat('c', s_suppkey) AS connection, concat('host', s_suppkey) AS host, concat('db', s_suppkey % 5) AS database, (SELECT count(*) FROM cat_link WHERE l_suppkey = s_suppkey) AS sessions FROM supplier"),
    "connection_topology_edges": (lambda c: _profiles(c)["edges"], _SYSTEMS + "SELECT a.system AS from_system, b.system AS to_system, count(*) AS sessions FROM on_system a JOIN on_system b ON a.sid = b.sid AND a.system < b.system GROUP BY ALL"),
    "assign_orphans": (_orphans, _ORPHANS),
    "cluster_centroids": (lambda c: drill.cluster_centroids(_points(c), _by_tier(c)), _LABELS + _POINTS + "SELECT cluster, CAST(round(avg(CAST(x AS DECIMAL(18,6))), 6) AS DOUBLE) AS x, CAST(round(avg(CAST(y AS DECIMAL(18,6))), 6) AS DOUBLE) AS y, count(*) AS size FROM points JOIN by_tier USING (sid) GROUP BY cluster"),
    "majority_consensus": (_majority, _MAJORITY),
    "nearest_exemplar": (lambda c: drill.nearest_exemplar(usage.similarity_pairs(c.access), _exemplars(c)), """, n AS (SELECT a AS sid, b AS exemplar, sim FROM jaccard UNION ALL SELECT b, a, sim FROM jaccard) SELECT sid, exemplar FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(sim, 9) DESC, exemplar) AS r FROM n WHERE right(exemplar, 1) = '3' AND right(sid, 1) <> '3') WHERE r = 1"""),
    "group_cohesion": (lambda c: drill.group_cohesion(usage.similarity_pairs(c.access), _labels(c)), _LABELS + """, z AS (SELECT cluster, count(*) AS size FROM labels GROUP BY cluster), m AS (SELECT CAST(round(sim, 9) AS DECIMAL(18,9)) AS sim, x.cluster AS ca, y.cluster AS cb FROM jaccard JOIN labels x ON x.sid = a JOIN labels y ON y.sid = b),
        i AS (SELECT ca AS cluster, CAST(sum(sim) AS DOUBLE) AS s FROM m WHERE ca = cb GROUP BY ca), o AS (SELECT cluster, CAST(sum(sim) AS DOUBLE) AS s FROM (SELECT ca AS cluster, sim FROM m WHERE ca <> cb UNION ALL SELECT cb, sim FROM m WHERE ca <> cb) GROUP BY cluster)
        SELECT cluster, size, round(CASE WHEN size > 1 THEN coalesce(i.s, 0) / (size * (size - 1) / 2) ELSE 0.0 END, 6) AS cohesion, round(CASE WHEN (SELECT count(*) FROM labels) > size THEN coalesce(o.s, 0) / (size * ((SELECT count(*) FROM labels) - size)) ELSE 0.0 END, 6) AS coupling FROM z LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster)"""),
    "independent_sessions": (lambda c: drill.independent_sessions(_features(c), _closest(c)), _INDEPENDENT),
    "cluster_quality": (lambda c: drill.cluster_entropy(_labels(c)), _LABELS + ", z AS (SELECT count(*) / (SELECT count(*) FROM labels) AS p FROM labels GROUP BY cluster) SELECT count(*) AS clusters, round(-CAST(sum(CAST(round(p * log2(p), 12) AS DECIMAL(18,12))) AS DOUBLE), 6) AS entropy FROM z"),
}
