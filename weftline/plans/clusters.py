"""Queries over communities, densities and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import clusters, communities, usage

GRID, BANDWIDTH, EPS, SAMPLES = 60, 0.05, 0.02, 4


def _points(c):
    """Orders as points: day of the year and price within its thousand, weighted by a tenth of the price's hundreds."""
    o = c.table("orders")
    return o.select(F.concat(F.lit("S"), "o_orderkey").alias("id"), (F.dayofyear("o_orderdate") / 366).alias("x"), (F.floor(F.col("o_totalprice")) % 1000 / 1000).alias("y"), (F.floor(F.col("o_totalprice") / 100) % 10 / 10).alias("weight"))


def _graph(c):
    return usage.similarity_pairs(c.access, max_share=usage.max_share(c.base)).where("sim >= 0.1")


def _nodes(c):
    return c.base.select(F.col("sid").alias("node"))


_P = "WITH p AS (SELECT concat('S', o_orderkey) AS id, dayofyear(o_orderdate) / 366 AS x, CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000 AS y, CAST(floor(o_totalprice / 100) AS BIGINT) % 10 / 10 AS weight FROM orders), "
_SURFACE = _P + f"""f AS (SELECT (floor(x / {BANDWIDTH / 10}) + 0.5) * {BANDWIDTH / 10} AS x, (floor(y / {BANDWIDTH / 10}) + 0.5) * {BANDWIDTH / 10} AS y, sum(CAST(round(weight * 1000) AS BIGINT)) AS w FROM p GROUP BY 1, 2),
m AS (SELECT CAST(i.i AS INTEGER) AS ix, CAST(j.j AS INTEGER) AS iy, w, pow((i.i + 0.5) / {GRID} - x, 2) + pow((j.j + 0.5) / {GRID} - y, 2) AS q FROM f JOIN range({GRID}) i(i) ON abs((i.i + 0.5) / {GRID} - x) <= {3 * BANDWIDTH + 1e-9} JOIN range({GRID}) j(j) ON abs((j.j + 0.5) / {GRID} - y) <= {3 * BANDWIDTH + 1e-9}),
s AS (SELECT ix, iy, round(CAST(sum(CAST(round(w / 1000 * exp(-q / {2 * BANDWIDTH**2}), 9) AS DECIMAL(28,9))) AS DOUBLE), 4) AS density FROM m WHERE q <= {(3 * BANDWIDTH)**2} GROUP BY ix, iy) """
_NEAR = f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS} * {EPS}"
_DENSITY = _P.replace("WITH p", "WITH RECURSIVE p") + f"""c AS (SELECT *, CAST(floor(x / {EPS}) AS BIGINT) AS gx, CAST(floor(y / {EPS}) AS BIGINT) AS gy FROM p), g AS (SELECT c.*, gx + i.i AS hx, gy + j.j AS hy FROM c, range(-1, 2) i(i), range(-1, 2) j(j)),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN c b ON a.hx = b.gx AND a.hy = b.gy WHERE {_NEAR}), core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {SAMPLES}),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
comp(id, c) USING KEY (id) AS (SELECT id, id FROM core UNION (SELECT DISTINCT ON (u.id) u.id, v.c FROM recurring.comp u JOIN links ON a = u.id JOIN comp v ON v.id = b WHERE v.c < u.c ORDER BY u.id, v.c)),
least AS (SELECT id, c FROM comp), edge AS (SELECT a AS id, min(c) AS c FROM near JOIN least ON least.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
SELECT p.id, coalesce(l.c, e.c) AS cluster, l.id IS NOT NULL AS is_core FROM p LEFT JOIN least l ON l.id = p.id LEFT JOIN edge e ON e.id = p.id"""

QUERIES = {
    "density_surface": (lambda c: clusters.density_surface(_points(c), GRID, BANDWIDTH), _SURFACE + "SELECT * FROM s"),
    "density_peaks": (lambda c: clusters.density_peaks(clusters.density_surface(_points(c), GRID, BANDWIDTH), grid=GRID), _SURFACE + f"SELECT ix, iy, density FROM s WHERE ix BETWEEN 1 AND {GRID - 2} AND iy BETWEEN 1 AND {GRID - 2} AND density >= 0.15 * (SELECT max(density) FROM s) AND NOT EXISTS (SELECT 1 FROM s n WHERE abs(n.ix - s.ix) <= 1 AND abs(n.iy - s.iy) <= 1 AND n.density > s.density) ORDER BY density DESC, ix, iy LIMIT 10"),
    "density_clusters": (lambda c: clusters.density_clusters(_points(c), EPS, SAMPLES), _DENSITY),
    "louvain_communities": (lambda c: communities.communities(_nodes(c), _graph(c)).withColumnRenamed("node", "sid"), None),
    "louvain_auto": (lambda c: communities.louvain_auto(_nodes(c), _graph(c)).withColumnRenamed("node", "sid"), None),
    "resolution_sweep": (lambda c: communities.resolution_sweep(_nodes(c), _graph(c)), None),
}
