"""SQL of the catalog for the DuckDB oracle: common table expressions that oracle queries build on.

An edge never leads to a session of a lower layer, so cycles are looked for inside layers (``level_edges``).
"""

CTES = """
WITH RECURSIVE cat_session0 AS (SELECT concat('S', o_orderkey) AS sid, o_orderkey AS k, o_custkey, CAST(floor(o_orderkey / 25) AS BIGINT) % 6 AS layer FROM orders),
cat_b AS (SELECT CAST(floor(count(*) / 2) AS BIGINT) AS b FROM part),
cat_line AS (SELECT * FROM cat_session0 JOIN lineitem ON l_orderkey = k),
cat_access AS MATERIALIZED (SELECT DISTINCT sid, role, tname FROM (
  SELECT sid, CASE WHEN l_linenumber IN (1, 2, 3) THEN 'source' WHEN l_linenumber IN (4, 5) THEN 'target' ELSE 'lookup' END AS role,
    CASE WHEN l_linenumber IN (1, 2, 3) THEN concat('L', layer, '_', l_partkey % b)
         WHEN l_linenumber IN (4, 5) THEN concat('L', CASE WHEN l_returnflag = 'R' AND k % 4 = 0 THEN layer ELSE layer + 1 END, '_', l_partkey % b)
         ELSE concat('L', l_suppkey % (layer + 1), '_', l_partkey % b) END AS tname
  FROM cat_line, cat_b) t),
usage AS MATERIALIZED (SELECT tname, count(*) FILTER (role = 'target') AS writers, count(*) FILTER (role = 'source') AS readers, count(*) FILTER (role = 'lookup') AS lookup_users FROM cat_access GROUP BY tname),
edges AS MATERIALIZED (SELECT DISTINCT w.sid AS src, u.sid AS dst FROM cat_access w JOIN cat_access u ON w.tname = u.tname AND w.role = 'target' AND u.role <> 'target'
  WHERE NOT EXISTS (SELECT 1 FROM cat_access x WHERE x.tname = u.tname AND x.sid = u.sid AND x.role = 'target')),
level_edges AS MATERIALIZED (SELECT src, dst FROM edges JOIN cat_session0 s ON s.sid = src JOIN cat_session0 d ON d.sid = dst WHERE s.layer = d.layer),
closure AS (SELECT src AS a, dst AS b FROM level_edges UNION SELECT c.a, e.dst FROM closure c JOIN level_edges e ON c.b = e.src),
scc AS MATERIALIZED (SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS grp FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n
  LEFT JOIN closure x ON x.a = n.node AND EXISTS (SELECT 1 FROM closure y WHERE y.a = x.b AND y.b = x.a) GROUP BY n.node),
dag AS MATERIALIZED (SELECT src, dst FROM edges JOIN scc s ON s.node = src JOIN scc d ON d.node = dst WHERE s.grp <> d.grp OR src < dst),
depths AS (SELECT sid, CAST(1 AS BIGINT) AS tier FROM cat_session0 UNION SELECT dst, tier + 1 FROM depths JOIN dag ON sid = src),
tiers AS (SELECT sid, max(tier) AS tier FROM depths GROUP BY sid),
cat_names AS (SELECT sid, k, concat('s_m_', k) AS name, concat('wf_', c_nationkey, '.s_m_', k) AS full_name, c_mktsegment AS folder, concat('wf_', c_nationkey) AS workflow,
    row_number() OVER (PARTITION BY concat('wf_', c_nationkey) ORDER BY k) AS step, CAST(floor(k / 25) AS BIGINT) % 9 AS transforms, CAST(floor(k / 25) AS BIGINT) % 3 AS join_count,
    CAST(floor(k / 25) AS BIGINT) % 4 AS filter_count, CAST(floor(k / 25) AS BIGINT) % 2 AS router_count FROM cat_session0 JOIN customer ON o_custkey = c_custkey),
cat_session AS (SELECT n.*,
    (SELECT count(*) FROM cat_access a JOIN usage u USING (tname) WHERE a.sid = n.sid AND a.role = 'source' AND u.writers = 0) AS ext_reads,
    (SELECT count(*) FROM cat_access a WHERE a.sid = n.sid AND a.role = 'lookup') AS lookup_count,
    (SELECT count(*) FROM cat_access a WHERE a.sid = n.sid AND a.role = 'source') AS n_sources,
    (SELECT count(*) FROM cat_access a WHERE a.sid = n.sid AND a.role = 'target') AS n_targets,
    (SELECT coalesce(string_agg(tname, ',' ORDER BY tname), '') FROM cat_access a WHERE a.sid = n.sid AND a.role = 'source') AS sources,
    (SELECT coalesce(string_agg(tname, ',' ORDER BY tname), '') FROM cat_access a WHERE a.sid = n.sid AND a.role = 'target') AS targets,
    (SELECT coalesce(string_agg(tname, ',' ORDER BY tname), '') FROM cat_access a WHERE a.sid = n.sid AND a.role = 'lookup') AS lookups,
    EXISTS (SELECT 1 FROM cat_access a JOIN usage u USING (tname) WHERE a.sid = n.sid AND a.role = 'target' AND u.writers > 1) AS critical
  FROM cat_names n),
cat_s AS (SELECT c.*, t.tier FROM cat_session c JOIN tiers t USING (sid)),
cat_table AS (SELECT u.tname, CASE WHEN writers = 0 THEN 'source' WHEN writers > 1 THEN 'conflict' WHEN readers + lookup_users > 0 THEN 'chain' ELSE 'independent' END AS type,
    CAST(coalesce((SELECT max(tier) FROM cat_access a JOIN tiers t USING (sid) WHERE a.tname = u.tname AND a.role = 'target') + 0.5, 0.5) AS DOUBLE) AS tier,
    CAST(CASE WHEN writers > 1 THEN writers ELSE 0 END AS BIGINT) AS conflict_writers, readers, lookup_users FROM usage u),
cat_connection AS (SELECT DISTINCT * FROM (
  SELECT sid AS from_id, tname AS to_id, CASE WHEN writers > 1 THEN 'write_conflict' WHEN readers + lookup_users > 0 THEN 'chain' ELSE 'write_clean' END AS conn_type FROM cat_access JOIN usage USING (tname) WHERE role = 'target'
  UNION ALL SELECT tname, sid, CASE WHEN writers > 1 THEN 'read_after_write' WHEN writers = 1 THEN 'chain' ELSE 'source_read' END FROM cat_access JOIN usage USING (tname) WHERE role = 'source'
  UNION ALL SELECT tname, sid, 'lookup_stale' FROM cat_access WHERE role = 'lookup')),
conn_ends AS (SELECT from_id AS node, to_id AS other, conn_type FROM cat_connection UNION ALL SELECT to_id, from_id, conn_type FROM cat_connection),
pairs AS (SELECT a.sid AS a, b.sid AS b, count(*) AS shared FROM (SELECT DISTINCT sid, tname FROM cat_access) a JOIN (SELECT DISTINCT sid, tname FROM cat_access) b ON a.tname = b.tname AND a.sid < b.sid GROUP BY ALL),
sizes AS (SELECT sid, count(DISTINCT tname) AS n FROM cat_access GROUP BY sid),
jaccard AS (SELECT a, b, shared / (x.n + y.n - shared) AS sim FROM pairs JOIN sizes x ON x.sid = a JOIN sizes y ON y.sid = b),
cat_instance AS (SELECT sid, concat('i_', l_linenumber) AS inst_name, ['Source Definition', 'Filter', 'Joiner', 'Expression', 'Aggregator', 'Router', 'Target Definition'][l_linenumber] AS transformation_type, CAST(l_linenumber AS BIGINT) AS pos FROM cat_line),
cat_connector AS (SELECT * FROM (SELECT sid, concat('i_', l_linenumber) AS from_instance, concat('f', l_partkey % 5) AS from_field, lead(concat('i_', l_linenumber)) OVER w AS to_instance, lead(concat('f', l_partkey % 5)) OVER w AS to_field FROM cat_line WINDOW w AS (PARTITION BY sid ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE to_instance IS NOT NULL),
cat_expression AS (SELECT sid, concat('i_', l_linenumber) AS transform, concat('f', l_partkey % 5) AS field, CASE l_partkey % 8
    WHEN 0 THEN concat('IIF(ISNULL(', x, '), 0, ', x, ')') WHEN 1 THEN concat('NVL(', x, ', ''x'')') WHEN 2 THEN concat('DECODE(', x, ', 1, ''A'', ''B'')') WHEN 3 THEN concat('SUBSTR(', x, ', INSTR(', x, ', ''-''), 3)')
    WHEN 4 THEN concat('TO_CHAR(', x, ', ''YYYY-MM-DD'')') WHEN 5 THEN concat('SUM(', x, ') / COUNT(', x, ')') WHEN 6 THEN concat('$$P_', x, ' || ', x) ELSE x END AS expression_text
  FROM (SELECT *, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS x FROM cat_line JOIN part ON l_partkey = p_partkey)),
cat_sql AS (SELECT sid, concat('i_', l_linenumber) AS transform, CASE l_partkey % 4
    WHEN 0 THEN concat('SELECT x.id, y.v FROM ', a, ' x JOIN ', b, ' y ON x.id = y.id', chr(10), 'WHERE x.v > 1') WHEN 1 THEN concat('DELETE FROM ', a, ' WHERE v IS NULL')
    WHEN 2 THEN concat('MERGE INTO ', a, ' USING ', b, ' ON (1 = 1)', chr(10), 'WHEN MATCHED THEN UPDATE SET v = 1') ELSE concat('BEGIN', chr(10), '  UPDATE ', a, ' SET v = NVL(v, 0);', chr(10), chr(10), 'END;') END AS sql_text,
    CASE l_partkey % 4 WHEN 0 THEN 'sql_override' WHEN 2 THEN 'post_sql' ELSE 'pre_sql' END AS kind
  FROM (SELECT *, concat('DW.T', l_partkey % 50) AS a, concat('DW.U', l_suppkey % 20) AS b FROM cat_line))
"""


def oracle(select: str) -> str:
    return CTES + select
