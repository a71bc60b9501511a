"""Queries over clusters of the similarity graph and of table sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import drill, partitions, seeded, usage
from weftline.plans import detail
from weftline.shared import stored


def _nodes(c):
    return c.base.select(F.col("sid").alias("node"))


def _graph(c):
    """The similarity graph: pairs of sessions with a Jaccard similarity of 0.1, hotter tables than its bound left out."""
    return stored(usage.similarity_pairs(c.access, max_share=usage.max_share(c.base)).where("sim >= 0.1"), "graph")


def _of(build):
    return lambda c: build(_nodes(c), _graph(c)).withColumnRenamed("node", "sid")


def _consensus(c):
    by_folder = c.session.select("sid", F.col("folder").alias("cluster"))
    by_tier = c.tiered.select("sid", F.col("tier").cast("string").alias("cluster"))
    by_table = partitions.cluster_table_gravity(c.access, c.base.select("sid")).select("sid", "cluster")
    return partitions.consensus_clusters([by_folder, by_tier, by_table])


_GRAVITY = """, held AS MATERIALIZED (SELECT DISTINCT sid, tname FROM cat_access), refs AS (SELECT tname, count(*) AS refs FROM held GROUP BY tname),
anchors AS MATERIALIZED (SELECT tname, row_number() OVER (ORDER BY refs DESC, tname) - 1 AS place FROM refs WHERE refs >= greatest(2, CAST(floor((SELECT count(*) FROM cat_session0) * 0.005) AS BIGINT)) QUALIFY place < 100),
placed AS MATERIALIZED (SELECT s.sid, min(place) AS place FROM cat_session0 s LEFT JOIN (held JOIN anchors USING (tname)) USING (sid) GROUP BY s.sid),
near AS MATERIALIZED (SELECT DISTINCT place, tname FROM held JOIN placed USING (sid) WHERE place IS NOT NULL),
rest AS (SELECT sid, place FROM (SELECT sid, n.place, count(*) AS shared FROM held JOIN placed p USING (sid) JOIN near n USING (tname) WHERE p.place IS NULL GROUP BY sid, n.place) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY shared DESC, place) = 1),
lab AS MATERIALIZED (SELECT p.sid, coalesce(p.place, r.place, -1) AS place FROM placed p LEFT JOIN rest r USING (sid)),
tab AS MATERIALIZED (SELECT DISTINCT place, tname FROM held JOIN lab USING (sid)), sized AS (SELECT place, count(*) AS size FROM lab GROUP BY place),
moves AS (SELECT place, to_ FROM (SELECT a.place, b.place AS to_, count(*) AS shared FROM tab a JOIN tab b USING (tname) WHERE a.place >= 0 AND a.place IN (SELECT place FROM sized WHERE size < 3) AND b.place IN (SELECT place FROM sized WHERE size >= 3) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY shared DESC, CASE WHEN to_ < 0 THEN 1073741824 ELSE to_ END) = 1)
SELECT sid, coalesce(tname, '__other__') AS cluster, tname AS anchor FROM lab LEFT JOIN moves USING (place) LEFT JOIN anchors ON anchors.place = coalesce(to_, lab.place)"""


def _vectors(c):
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _gravity_groups(c):
    return seeded.gravity_groups(c.access, drill.independent_sessions(detail._features(c), detail._closest(c)))


QUERIES = {
    "seeded_label_vote": (_of(seeded.seeded_label_vote), None),
    "seeded_k_communities": (_of(seeded.seeded_k_communities), None),
    "kmeans_elbow": (lambda c: seeded.kmeans_elbow(_vectors(c)).withColumnRenamed("id", "vec_id"), None),
    "gravity_groups": (_gravity_groups, None),
    "exemplar_clusters": (_of(partitions.exemplar_clusters), None),
    "spectral_clusters": (_of(partitions.spectral_clusters), None),
    "ppr_clusters": (_of(lambda n, p: partitions.ppr_clusters(n, p, landmarks=64)), None),
    "walk_embeddings": (lambda c: partitions.walk_embeddings(_nodes(c), _graph(c)).select(F.col("node").alias("sid"), F.transform("vector", lambda v: F.round(v, 4)).alias("vector"), "cluster"), None),
    "walk_clusters": (_of(lambda n, p: partitions.walk_clusters(n, p, least=1e-3)), None),
    "consensus_clusters": (_consensus, None),
    "hierarchical_domains": (lambda c: partitions.hierarchical_domains(c.access), None),
    "cluster_table_gravity": (lambda c: partitions.cluster_table_gravity(c.access, c.base.select("sid")), _GRAVITY),
}
