"""Queries over usage, views and graph operators, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import Catalog
from weftline.operators import graph, usage, views
from weftline.plans.oracle import oracle

#: Parameters that the sample queries take.
TABLE, SEARCH = "L1_3", "1"


def start_of(c: Catalog):
    """The session with the most dependents, the least by name among equals: where traces start."""
    return c.edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))


START = "(SELECT src FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_HOPS = """, hops AS (SELECT {start} AS node, CAST(0 AS BIGINT) AS depth UNION SELECT {to}, depth + 1 FROM hops JOIN {edges} ON {at} = node WHERE depth < {n}),
found AS (SELECT node, min(depth) AS depth FROM hops WHERE node IS NOT NULL GROUP BY node)"""


def _trace_sql(select: str, n: int, at: str = "src", to: str = "dst", edges: str = "edges") -> str:
    return oracle(_HOPS.format(start=START, at=at, to=to, edges=edges, n=n) + select)


def _all_edges(c: Catalog):
    """Typed edges between sessions and tables, and the lineage edges between sessions."""
    return c.connections.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).unionByName(graph.session_lineage_edges(c.access).select("src", "dst")).distinct()


def _reversed(edges):
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _impact(c: Catalog):
    """What a failure reaches: sessions and tables."""
    found = graph.trace(_all_edges(c), start_of(c), 10)
    sessions = found.join(c.tiered.select(F.col("sid").alias("node"), "name", F.col("tier").cast("double").alias("tier")), "node").select(F.col("node").alias("id"), F.lit("session").alias("kind"), "name", "tier", "depth")
    return sessions.unionByName(found.join(c.tables.select(F.col("tname").alias("node"), "tier"), "node").select(F.col("node").alias("id"), F.lit("table").alias("kind"), F.col("node").alias("name"), "tier", "depth"))


_ALL = """, all_edges AS MATERIALIZED (SELECT from_id AS src, to_id AS dst FROM cat_connection UNION SELECT w.sid, u.sid FROM cat_access w JOIN cat_access u ON w.tname = u.tname AND w.role = 'target' AND u.role <> 'target' AND w.sid <> u.sid)"""


def _all_sql(select: str, n: int, at: str = "src", to: str = "dst") -> str:
    return oracle(_ALL + _HOPS.format(start=START, at=at, to=to, edges="all_edges", n=n) + select)


def _farthest(c: Catalog):
    """The session farthest from the start, whatever the direction; the least by name among equals."""
    found = graph.trace(graph.both_ways(c.graph), start_of(c), None)
    return found.orderBy(F.desc("depth"), "node").limit(1).select("node")


def _columns(c: Catalog):
    """Column to column edges of all sessions; a column is session:instance.field."""
    end = lambda side: F.concat(F.col("sid"), F.lit(":"), F.col(f"{side}_instance"), F.lit("."), F.col(f"{side}_field"))
    return c.connector.select(end("from").alias("src"), end("to").alias("dst")).distinct()


def _column_trace(c: Catalog):
    columns = _columns(c)
    start = columns.join(start_of(c), F.substring_index("src", ":", 1) == F.col("node"), "left_semi").agg(F.min("src").alias("node"))
    return graph.trace(columns, start, None).withColumnRenamed("node", "column")


_PATH = oracle(""", both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)""" + _HOPS.format(start=START, at="src", to="dst", edges="both_ways", n=40) + """,
    far AS MATERIALIZED (SELECT * FROM found), parent AS MATERIALIZED (SELECT x.node, min(src) AS parent FROM far x JOIN both_ways ON dst = x.node JOIN far y ON y.node = src AND y.depth = x.depth - 1 GROUP BY x.node),
    walk AS (SELECT depth AS step, node FROM (SELECT * FROM far ORDER BY depth DESC, node LIMIT 1) UNION ALL SELECT step - 1, p.parent FROM walk JOIN parent p ON p.node = walk.node WHERE step > 0) SELECT step, node FROM walk""")
_COLUMNS = oracle(""", col_edges AS MATERIALIZED (SELECT DISTINCT concat(sid, ':', from_instance, '.', from_field) AS src, concat(sid, ':', to_instance, '.', to_field) AS dst FROM cat_connector),
    walk AS (SELECT min(src) AS node, CAST(0 AS BIGINT) AS depth FROM col_edges WHERE split_part(src, ':', 1) = """ + START + """ UNION SELECT dst, depth + 1 FROM walk JOIN col_edges ON src = node WHERE depth < 12) SELECT node AS "column", min(depth) AS depth FROM walk GROUP BY node""")
_BOTH = ", both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"

_RANKS = """, n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM cat_session0), o AS MATERIALIZED (SELECT src, count(*) AS o FROM edges GROUP BY src), r0 AS MATERIALIZED (SELECT sid AS node, 1 / n AS rank FROM cat_session0, n)""" + "".join(f""",
    r{k + 1} AS MATERIALIZED (SELECT r.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + l.lost / n) AS rank FROM n, (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT src FROM o)) l, r{k} r LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM r{k} JOIN o ON o.src = node JOIN edges e ON e.src = node GROUP BY dst) g ON g.dst = r.node)""" for k in range(20)) + " SELECT node, round(rank, 9) AS rank FROM r20"

QUERIES = {
    # usage
    "table_usage": (lambda c: c.usage, "SELECT * FROM usage"),
    "write_conflicts": (lambda c: usage.write_conflicts(c.access, c.tiers), "SELECT tname, count(*) AS writer_count, string_agg(sid, ',' ORDER BY sid) AS writers, CAST(max(tier) + 0.5 AS DOUBLE) AS tier FROM cat_access JOIN tiers USING (sid) WHERE role = 'target' GROUP BY tname HAVING count(*) > 1"),
    "source_only_tables": (lambda c: usage.source_only_tables(c.access), "SELECT tname FROM usage WHERE writers = 0"),
    "read_chains": (lambda c: usage.read_chains(c.access), """SELECT w.tname, w.writers, r.readers, w.writers + r.readers AS chain_length FROM usage w JOIN (SELECT tname, count(*) AS readers FROM cat_access a WHERE role = 'source'
        AND NOT EXISTS (SELECT 1 FROM cat_access x WHERE x.tname = a.tname AND x.sid = a.sid AND x.role = 'target') GROUP BY tname) r USING (tname) WHERE w.writers > 0"""),
    "table_nodes": (lambda c: c.tables, "SELECT * FROM cat_table"),
    "typed_connections": (lambda c: c.connections, "SELECT * FROM cat_connection"),
    "table_profiles": (lambda c: usage.table_profiles(c.access), """SELECT tname, writers AS writer_count, readers AS reader_count, lookup_users AS lookup_count, writers + readers + lookup_users AS total_refs,
        (SELECT coalesce(string_agg(sid, ',' ORDER BY sid), '') FROM cat_access a WHERE a.tname = u.tname AND role = 'target') AS writers,
        (SELECT coalesce(string_agg(sid, ',' ORDER BY sid), '') FROM cat_access a WHERE a.tname = u.tname AND role = 'source') AS readers,
        (SELECT coalesce(string_agg(sid, ',' ORDER BY sid), '') FROM cat_access a WHERE a.tname = u.tname AND role = 'lookup') AS lookups FROM usage u"""),
    "node_degree": (lambda c: usage.node_degree(c.connections), """, ends AS (SELECT from_id AS node_id, conn_type FROM cat_connection UNION ALL SELECT to_id, conn_type FROM cat_connection)
        SELECT node_id, conn_type, count(*) AS degree FROM ends GROUP BY ALL UNION ALL SELECT node_id, 'all', count(*) FROM ends GROUP BY node_id"""),
    "shared_table_pairs": (lambda c: usage.shared_table_pairs(c.access), "SELECT * FROM pairs"),
    "coupling_counts": (lambda c: usage.coupling_counts(c.access), "SELECT s.sid, count(p.sid) AS coupled FROM sizes s LEFT JOIN (SELECT a AS sid FROM pairs UNION ALL SELECT b FROM pairs) p USING (sid) GROUP BY s.sid"),
    "table_gravity": (lambda c: usage.table_gravity(c.access), """SELECT tname, readers AS r, writers AS w, lookup_users AS l, readers * writers * (1 + lookup_users) AS gravity,
        row_number() OVER (ORDER BY readers * writers * (1 + lookup_users) DESC, tname) <= greatest(1, floor((SELECT count(*) FROM usage) / 20)) AS is_hub FROM usage"""),
    "reference_ranking": (lambda c: usage.reference_ranking(c.access), "SELECT tname, count(DISTINCT sid) AS refs, round(100.0 * count(DISTINCT sid) / (SELECT count(*) FROM sizes), 6) AS pct FROM cat_access GROUP BY tname ORDER BY refs DESC, tname LIMIT 50"),
    "infra_systems": (lambda c: usage.infra_systems(c.access), """SELECT system, CASE WHEN system IN ('L0', 'L1') THEN 'landing' WHEN system IN ('L2', 'L3') THEN 'staging' ELSE 'serving' END AS environment, count(DISTINCT sid) AS sessions, count(DISTINCT tname) AS tables,
        array_to_string(list_sort(list_distinct(list(tname)))[1:50], ',') AS sample FROM (SELECT *, split_part(tname, '_', 1) AS system FROM cat_access) GROUP BY system"""),
    "infra_edges": (lambda c: usage.infra_edges(c.access), """, io AS (SELECT sid, role, split_part(tname, '_', 1) AS system FROM cat_access),
        e AS (SELECT r.system AS from_system, w.system AS to_system, count(DISTINCT r.sid) AS sessions FROM io r JOIN io w ON r.sid = w.sid AND r.role <> 'target' AND w.role = 'target' AND r.system <> w.system GROUP BY ALL)
        SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM e x WHERE x.from_system = e.to_system AND x.to_system = e.from_system) THEN 'both' ELSE 'one' END AS direction FROM e"""),
    "similarity_pairs": (lambda c: usage.similarity_pairs(c.access).select("a", "b", F.round("sim", 6).alias("sim")), "SELECT a, b, round(sim, 6) AS sim FROM jaccard"),
    "similarity_graph": (lambda c: usage.similarity_pairs(c.access, max_share=usage.max_share(c.base)).where("sim >= 0.1").select("a", "b", F.round("sim", 6).alias("sim")), """, cold AS (SELECT * FROM (SELECT DISTINCT sid, tname FROM cat_access) WHERE tname IN (SELECT tname FROM cat_access GROUP BY tname HAVING count(DISTINCT sid) <= 500)),
        p AS (SELECT x.sid AS a, y.sid AS b, count(*) AS shared FROM cold x JOIN cold y ON x.tname = y.tname AND x.sid < y.sid GROUP BY ALL)
        SELECT a, b, round(shared / (s.n + t.n - shared), 6) AS sim FROM p JOIN sizes s ON s.sid = a JOIN sizes t ON t.sid = b WHERE shared / (s.n + t.n - shared) >= 0.1"""),
    # joins and edges
    "session_lineage_edges": (lambda c: graph.session_lineage_edges(c.access), """SELECT w.sid AS src, u.sid AS dst, CASE u.role WHEN 'source' THEN 'data_flow' ELSE 'lookup_dependency' END AS edge_type, u.tname AS via_table
        FROM cat_access w JOIN cat_access u ON w.tname = u.tname AND w.role = 'target' AND u.role <> 'target' AND w.sid <> u.sid"""),
    "dependency_edges": (lambda c: c.edges, "SELECT * FROM edges"),
    "tables_touched": (lambda c: c.access.join(start_of(c).select(F.col("node").alias("sid")), "sid", "left_semi").select("tname", F.when(F.col("role") == "target", "writes").when(F.col("role") == "source", "reads").otherwise("looks_up").alias("relation")), f"SELECT tname, CASE role WHEN 'target' THEN 'writes' WHEN 'source' THEN 'reads' ELSE 'looks_up' END AS relation FROM cat_access WHERE sid = {START}"),
    "table_lineage": (lambda c: views.table_lineage(c.access, TABLE), f"SELECT role, sid FROM cat_access WHERE tname = '{TABLE}'"),
    "matrix_cells": (lambda c: views.matrix_cells(c.session, c.tables, c.connections), """SELECT DISTINCT sid, name, tname, conn_type FROM conn_ends JOIN cat_names ON sid = node JOIN usage ON tname = other"""),
    "apply_glossary": (lambda c: views.apply_glossary(c.access, c.table("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("L1_"), "p_partkey").alias("term"), F.col("p_name").alias("label"))), "SELECT tname, coalesce(p_name, tname) AS business_name FROM usage LEFT JOIN part ON p_partkey % 3 = 0 AND upper(tname) = concat('L1_', p_partkey)"),
    # views
    "explorer_detail": (lambda c: views.explorer_detail(c.session, c.connections), """SELECT sid, (SELECT count(*) FROM conn_ends WHERE node = sid AND conn_type IN ('write_conflict', 'read_after_write')) AS conflict_count,
        (SELECT count(*) FROM conn_ends WHERE node = sid AND conn_type = 'chain') AS chain_count, (SELECT count(*) FROM conn_ends WHERE node = sid) AS total_connections FROM cat_names"""),
    "exec_order": (lambda c: views.exec_order(c.tiered, c.connections), """SELECT row_number() OVER (ORDER BY step, tier, sid) - 1 AS position, sid, EXISTS (SELECT 1 FROM conn_ends WHERE node = sid AND conn_type IN ('write_conflict', 'read_after_write')) AS has_conflict,
        EXISTS (SELECT 1 FROM conn_ends WHERE node = sid AND conn_type = 'chain') AS has_chain FROM cat_names JOIN tiers USING (sid)"""),
    "session_ids": (lambda c: views.session_ids(c.tiered), "SELECT sid, concat('S', row_number() OVER (ORDER BY tier, step, name)) AS display_id FROM cat_names JOIN tiers USING (sid)"),
    "tier_groups": (lambda c: views.tier_groups(c.tiers, c.tables), "SELECT tier, CAST(sum(s) AS BIGINT) AS sessions, CAST(sum(t) AS BIGINT) AS tables FROM (SELECT CAST(tier AS DOUBLE) AS tier, 1 AS s, 0 AS t FROM tiers UNION ALL SELECT tier, 0, 1 FROM cat_table) GROUP BY tier"),
    "folder_metrics": (lambda c: views.folder_metrics(c.tiered), "SELECT folder, count(*) AS sessions, count(DISTINCT workflow) AS workflows, round(avg(tier), 6) AS avg_tier, count(*) FILTER (critical) AS critical FROM cat_s GROUP BY folder"),
    "workflow_rollup": (lambda c: views.workflow_rollup(c.session, c.edges), "SELECT workflow, count(*) AS sessions, (SELECT count(*) FROM edges JOIN cat_names a ON a.sid = src JOIN cat_names b ON b.sid = dst WHERE a.workflow = n.workflow AND b.workflow = n.workflow) AS links FROM cat_names n GROUP BY workflow"),
    "catalog_stats": (lambda c: views.catalog_stats(c.tiers, c.tables, c.connections), """SELECT (SELECT count(*) FROM tiers) AS sessions, (SELECT max(tier) FROM tiers) AS max_tier, count(*) FILTER (type = 'conflict') AS conflicts, count(*) FILTER (type = 'chain') AS chains,
        count(*) FILTER (type = 'source') AS source_tables, (SELECT count(*) FROM cat_connection WHERE conn_type = 'lookup_stale') AS stale FROM cat_table"""),
    "galaxy_layout": (lambda c: views.galaxy_layout(c.tiered), """SELECT sid AS node_id, round(100 * tier * cos(2 * 3.141592653589793 * r / n), 4) + 0.0 AS x, round(100 * tier * sin(2 * 3.141592653589793 * r / n), 4) + 0.0 AS y, least(greatest(transforms, 1), 10) AS size
        FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sid) - 1 AS r, count(*) OVER (PARTITION BY tier) AS n FROM cat_names JOIN tiers USING (sid))"""),
    "tier_layout": (lambda c: views.tier_layout(c.tiered, c.tables), "SELECT sid AS node_id, 'session' AS kind, CAST(tier AS DOUBLE) AS band, critical AS flag FROM cat_s UNION ALL SELECT tname, type, tier, type = 'conflict' FROM cat_table"),
    "filter_tiers": (lambda c: views.filter_tiers(c.tiered, c.connections, [1, 3], ["lookup_stale"], SEARCH), f"""SELECT from_id, to_id, c.conn_type FROM cat_connection c JOIN cat_s ON sid = CASE WHEN starts_with(from_id, 'S') THEN from_id ELSE to_id END WHERE tier NOT IN (1, 3) AND conn_type <> 'lookup_stale' AND contains(lower(name), '{SEARCH}')"""),
    "filter_graph": (lambda c: views.filter_graph(c.session, c.connections, 2, 6, 3, True), """SELECT * FROM (SELECT sid, transforms, (SELECT count(*) FROM conn_ends WHERE node = sid) AS degree FROM cat_names WHERE transforms BETWEEN 2 AND 6
        AND EXISTS (SELECT 1 FROM conn_ends WHERE node = sid AND conn_type IN ('write_conflict', 'read_after_write'))) WHERE degree >= 3"""),
    "isolate_neighbours": (lambda c: views.isolate_neighbours(c.connections, TABLE), f"SELECT DISTINCT node_id FROM (SELECT to_id AS node_id FROM cat_connection WHERE from_id = '{TABLE}' UNION ALL SELECT from_id FROM cat_connection WHERE to_id = '{TABLE}' UNION ALL SELECT '{TABLE}')"),
    "scope_subgraph": (lambda c: views.scope_subgraph(c.tables, c.connections, c.session.where("folder = 'BUILDING'").select("sid")), "SELECT * FROM cat_table WHERE tname IN (SELECT other FROM conn_ends JOIN cat_names ON sid = node WHERE folder = 'BUILDING')"),
    "tables_of_sessions": (lambda c: views.scope_subgraph(c.tables, c.connections, c.tiers.where("tier = 2").select("sid")).select("tname", "type"), "SELECT tname, type FROM cat_table WHERE tname IN (SELECT other FROM conn_ends JOIN tiers ON sid = node WHERE tiers.tier = 2)"),
    "explorer_page": (lambda c: views.search_page(c.tiered.select("sid", "name", "tier", "transforms"), SEARCH, [F.desc("transforms"), F.col("sid")], 5, 20), f"SELECT sid, name, tier, transforms FROM cat_names JOIN tiers USING (sid) WHERE contains(lower(name), '{SEARCH}') ORDER BY transforms DESC, sid LIMIT 20 OFFSET 5"),
    "sessions_page": (lambda c: views.search_page(c.tiered.where("tier = 1").select("sid", "name", "tier", "step"), "", [F.col("tier"), F.col("step"), F.col("sid")], 10, 25), "SELECT sid, name, tier, step FROM cat_names JOIN tiers USING (sid) WHERE tier = 1 ORDER BY tier, step, sid LIMIT 25 OFFSET 10"),
    "global_search": (lambda c: views.global_search(c.session, c.tables, "_1"), """SELECT kind, name FROM (SELECT 1 AS p, 'session' AS kind, name FROM cat_names WHERE contains(lower(name), '_1') UNION ALL SELECT 2, 'table', tname FROM usage WHERE contains(lower(tname), '_1')
        UNION ALL SELECT DISTINCT 3, 'workflow', workflow FROM cat_names WHERE contains(lower(workflow), '_1')) ORDER BY p, name LIMIT 50"""),
    # graph
    "scc_groups": (lambda c: c.cycles, """, g AS (SELECT node, grp, count(*) OVER (PARTITION BY grp) AS size FROM scc), i AS (SELECT s.grp, count(*) AS n FROM edges JOIN scc s ON s.node = src JOIN scc d ON d.node = dst WHERE s.grp = d.grp GROUP BY s.grp)
        SELECT node, g.grp AS "group", size, size > 1 OR coalesce(n, 0) > 0 AS is_cycle, coalesce(n, 0) AS internal_edges FROM g LEFT JOIN i ON i.grp = g.grp"""),
    "break_cycles": (lambda c: c.acyclic, "SELECT src, dst FROM dag"),
    "session_tiers": (lambda c: c.tiers, "SELECT * FROM tiers"),
    "connected_components": (lambda c: graph.connected_components(c.base.select(F.col("sid").alias("node")), usage.shared_table_stars(c.access)), """, hubs AS MATERIALIZED (SELECT DISTINCT sid, min(sid) OVER (PARTITION BY tname) AS hub FROM cat_access), star AS MATERIALIZED (SELECT sid AS x, hub AS y FROM hubs UNION SELECT hub, sid FROM hubs),
        near(node, component) USING KEY (node) AS (SELECT sid, sid FROM cat_session0 UNION (SELECT DISTINCT ON (u.node) u.node, v.component FROM recurring.near u JOIN star ON x = u.node JOIN near v ON v.node = y WHERE v.component < u.component ORDER BY u.node, v.component))
        SELECT node, component FROM near"""),
    "trace_forward": (lambda c: graph.trace(_all_edges(c), start_of(c), 20), _all_sql("SELECT node, depth FROM found", 20)),
    "trace_backward": (lambda c: graph.trace(_reversed(_all_edges(c)), start_of(c), 20), _all_sql("SELECT node, depth FROM found", 20, "dst", "src")),
    "impact_analysis": (_impact, _all_sql("SELECT sid AS id, 'session' AS kind, name, CAST(tier AS DOUBLE) AS tier, depth FROM found JOIN cat_names ON sid = node JOIN tiers USING (sid) UNION ALL SELECT tname, 'table', tname, tier, depth FROM found JOIN cat_table ON tname = node", 10)),
    "shortest_path": (lambda c: graph.shortest_path(c.graph, start_of(c), _farthest(c)), _PATH),
    "column_trace": (_column_trace, _COLUMNS),
    "hop_neighbourhood": (lambda c: graph.trace(graph.both_ways(c.edges), start_of(c), 2).withColumnsRenamed({"node": "sid", "depth": "hop"}), oracle(_BOTH + _HOPS.format(start=START, at="src", to="dst", edges="both_ways", n=2) + "SELECT node AS sid, depth AS hop FROM found")),
    "cascade_by_hop": (lambda c: graph.trace(c.edges, start_of(c), None).where("depth > 0").groupBy(F.col("depth").alias("hop")).agg(F.count("*").alias("sessions")), _trace_sql("SELECT depth AS hop, count(*) AS sessions FROM found WHERE depth > 0 GROUP BY depth", 50)),
    "cascade_tables": (lambda c: c.access.where("role = 'target'").join(graph.trace(c.edges, start_of(c), None).select(F.col("node").alias("sid")), "sid", "left_semi").select("tname").distinct(), _trace_sql("SELECT DISTINCT tname FROM cat_access JOIN found ON node = sid WHERE role = 'target'", 50)),
    "shortest_path_lengths": (lambda c: graph.trace(graph.both_ways(c.edges), start_of(c), None).withColumnsRenamed({"node": "sid", "depth": "length"}), oracle(_BOTH + _HOPS.format(start=START, at="src", to="dst", edges="both_ways", n=50) + "SELECT node AS sid, depth AS length FROM found")),
    "flow_walk": (lambda c: graph.trace(c.edges, start_of(c), 20).select(F.lit("down").alias("direction"), "node", "depth").unionByName(graph.trace(c.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start_of(c), 20).select(F.lit("up").alias("direction"), "node", "depth")).where("depth > 0").join(c.tiers, F.col("node") == F.col("sid")).select("direction", "sid", "tier", "depth"),
        oracle(_HOPS.format(start=START, at="src", to="dst", edges="edges", n=20) + _HOPS.format(start=START, at="dst", to="src", edges="edges", n=20).replace("hops", "ups").replace("found", "above") + """
        SELECT direction, sid, tier, depth FROM (SELECT 'down' AS direction, * FROM found UNION ALL SELECT 'up', * FROM above) JOIN tiers ON sid = node WHERE depth > 0""")),
    "degree_centrality": (lambda c: c.edges.select(F.explode(F.array("src", "dst")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n")).crossJoin(F.broadcast(c.base.agg(F.count("*").alias("total")))).select("sid", F.round(F.col("n") / (F.col("total") - 1), 6).alias("degree")), "SELECT sid, round(count(*) / ((SELECT count(*) FROM cat_session0) - 1), 6) AS degree FROM (SELECT src AS sid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY sid"),
    "adjacency_weights": (lambda c: c.connections.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.round(F.sum(F.when(F.col("conn_type") == "chain", 1.0).when(F.col("conn_type") == "read_after_write", 0.8).when(F.col("conn_type") == "write_conflict", 0.6).when(F.col("conn_type") == "source_read", 0.5).when(F.col("conn_type") == "write_clean", 0.4).otherwise(0.3)), 6).alias("weight")),
        "SELECT from_id AS src, to_id AS dst, CAST(round(sum(CASE conn_type WHEN 'chain' THEN 1.0 WHEN 'read_after_write' THEN 0.8 WHEN 'write_conflict' THEN 0.6 WHEN 'source_read' THEN 0.5 WHEN 'write_clean' THEN 0.4 ELSE 0.3 END), 6) AS DOUBLE) AS weight FROM cat_connection GROUP BY ALL"),
    "page_rank": (lambda c: graph.page_rank(c.edges, c.base.select(F.col("sid").alias("node"))).select("node", F.round("rank", 9).alias("rank")), oracle(_RANKS)),
    "k_core": (lambda c: graph.k_core(c.edges), None),
}
