"""Queries over exports, drill-down, waves, duplicates and cluster summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.operators import graph, usage
from weftline.plans.scores import _LABELS, _SCORE, _by_tier, _labels, _scores
from weftline.shared import shared_dir
from weftline.sources import exports


def _exported(c):
    path = shared_dir(c.spark, "exports")
    exports.write_exports(c.session, c.instance.distinct(), path)
    return path


def _index(c):
    """One row a session: tier, cluster, score, bucket, degree."""
    degree = usage.node_degree(c.connections).where("conn_type = 'all'").select(F.col("node_id").alias("sid"), "degree")
    return c.tiered.select("sid", "tier", "folder").join(_labels(c), "sid", "left").join(_scores(c).select("sid", "score", "bucket"), "sid", "left").join(degree, "sid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


_INDEX = _SCORE + _LABELS + ", idx AS (SELECT s.sid, tier, folder, cluster, score, bucket, (SELECT count(*) FROM conn_ends WHERE node = s.sid) AS degree FROM cat_names s JOIN tiers USING (sid) LEFT JOIN labels USING (sid) LEFT JOIN scores USING (sid)) "


def _waves(c):
    """Topological generations of the contracted graph: a cycle moves as one."""
    of = c.cycles.select("node", "group")
    group = c.base.select("sid").join(of, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("group", "sid").alias("group"))
    a, b = group.select(F.col("sid").alias("src"), F.col("group").alias("ga")), group.select(F.col("sid").alias("dst"), F.col("group").alias("gb"))
    edges = c.edges.join(a, "src").join(b, "dst").where("ga <> gb").select(F.col("ga").alias("src"), F.col("gb").alias("dst")).distinct()
    tiers = graph.session_tiers(group.select(F.col("group").alias("sid")).distinct(), edges).select(F.col("sid").alias("group"), F.col("tier").alias("wave"))
    return group.join(tiers, "group").select("wave", "sid", "group")


_WAVES = """, grp AS MATERIALIZED (SELECT sid, coalesce(g.grp, sid) AS g FROM cat_session0 LEFT JOIN scc g ON g.node = sid), ga AS MATERIALIZED (SELECT g AS src, dst FROM edges JOIN grp ON sid = src), ge AS MATERIALIZED (SELECT DISTINCT src, g AS dst FROM ga JOIN grp ON sid = dst WHERE src <> g),
gd AS (SELECT DISTINCT g AS node, CAST(1 AS BIGINT) AS wave FROM grp UNION SELECT dst, wave + 1 FROM gd JOIN ge ON node = src) SELECT max(wave) AS wave, sid, g AS "group" FROM grp JOIN gd ON node = g GROUP BY sid, g"""


def _label_propagation(c):
    """sid, cluster: the heaviest label among neighbours, until stable."""
    pairs = usage.similarity_pairs(c.access, max_share=usage.max_share(c.base)).where("sim >= 0.1")
    return graph.label_propagation(c.base.select(F.col("sid").alias("node")), pairs).withColumnRenamed("node", "sid")


def _cross(c):
    """from_cluster, to_cluster, n: dependency edges between clusters, whatever their direction."""
    x, y = _by_tier(c).select(F.col("sid").alias("src"), F.col("cluster").alias("x")), _by_tier(c).select(F.col("sid").alias("dst"), F.col("cluster").alias("y"))
    return c.edges.join(x, "src").join(y, "dst").where("x <> y").groupBy(F.least("x", "y").alias("from_cluster"), F.greatest("x", "y").alias("to_cluster")).agg(F.count("*").alias("n"))


def _kmeans(c):
    """vec_id, cluster: k-means on embeddings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = c.table("embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=8, seed=42, maxIter=10).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


def _pca(c):
    """vec_id, x, y: two principal components of the standardised embeddings."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = c.table("embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(rows).transform(rows)
    p = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="s", outputCol="p").fit(scaled).transform(scaled).select("vec_id", F.round(p[0], 4).alias("x"), F.round(p[1], 4).alias("y"))


def _profiles(c):
    """Connection strings of four forms, one a supplier."""
    k, db = F.col("s_suppkey"), F.concat(F.lit("db"), F.col("s_suppkey") % 7)
    text = F.when(k % 4 == 0, F.concat(F.lit("jdbc:pg://host"), k, F.lit(":5432/"), db)).when(k % 4 == 1, F.concat(F.lit("host"), k, F.lit(":1521:"), db)).when(k % 4 == 2, F.concat(F.lit("Server=host"), k, F.lit(";Database="), db)).otherwise(F.concat(F.lit("host"), k, F.lit("/"), db))
    host, port, database = t.connection_parts(F.col("text"))
    return c.table("supplier").select("s_suppkey", text.alias("text")).select("s_suppkey", host.alias("host"), port.alias("port"), database.alias("database"))


QUERIES = {
    # exports written from the catalog and read back
    "src_export_xml": (lambda c: exports.sessions(exports.read_folders(c.spark, _exported(c))), ", i AS (SELECT sid, count(*) AS n FROM (SELECT DISTINCT sid, inst_name, transformation_type FROM cat_instance) GROUP BY sid) SELECT folder, workflow, name, coalesce(n, 0) AS instances FROM cat_names LEFT JOIN i USING (sid)"),
    "ext_instances": (lambda c: exports.instances(exports.read_folders(c.spark, _exported(c))), "SELECT DISTINCT name AS session, inst_name, transformation_type AS type FROM cat_instance JOIN cat_names USING (sid)"),
    "src_structure_check": (lambda c: exports.structure(c.spark, _exported(c)), "SELECT 'SESSION' AS tag, count(*) AS n FROM cat_names UNION ALL SELECT 'INSTANCE', count(*) FROM (SELECT DISTINCT sid, inst_name, transformation_type FROM cat_instance) UNION ALL SELECT 'FOLDER', count(*) FROM (SELECT DISTINCT folder, substr(name, 5, 2) FROM cat_names) UNION ALL SELECT 'REPOSITORY', count(DISTINCT folder) FROM cat_names"),
    "ext_folder_metadata": (lambda c: exports.sessions(exports.read_folders(c.spark, _exported(c))).groupBy("folder").agg(F.count("*").alias("sessions"), F.countDistinct("workflow").alias("workflows")), "SELECT folder, count(*) AS sessions, count(DISTINCT workflow) AS workflows FROM cat_names GROUP BY folder"),
    "parse_connection_string": (_profiles, "WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS s_suppkey, concat('host', k) AS host, CASE k % 4 WHEN 0 THEN '5432' WHEN 1 THEN '1521' ELSE '' END AS port, concat('db', k % 7) AS database FROM s"),
    "ext_alias_dedup": (lambda c: c.table("part").select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 5).cast("string")).otherwise("")).alias("name")).distinct().alias("n").join(c.table("part").where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("base")).distinct(), F.expr("base <> name and regexp_replace(name, '[0-9]$', '') = base"), "left").select("name", F.coalesce("base", "name").alias("resolved")),
        "WITH n AS (SELECT DISTINCT concat(p_brand, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) ELSE '' END) AS name FROM part), b AS (SELECT DISTINCT p_brand AS base FROM part WHERE p_partkey % 3 <> 0) SELECT name, coalesce(base, name) AS resolved FROM n LEFT JOIN b ON base <> name AND regexp_replace(name, '[0-9]$', '') = base"),
    # drill-down
    "session_index": (_index, _INDEX + "SELECT * FROM idx"),
    "drill_filter": (lambda c: _index(c).where("tier >= 2 and bucket in ('low', 'medium') and degree >= 3").select("sid"), _INDEX + "SELECT sid FROM idx WHERE tier >= 2 AND bucket IN ('low', 'medium') AND degree >= 3"),
    "preset_filters": (lambda c: _index(c).where(F.coalesce("score", F.lit(0.0)) >= 55).select("sid"), _INDEX + "SELECT sid FROM idx WHERE coalesce(score, 0) >= 55"),
    "drill_aggregates": (lambda c: _index(c).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"), F.max("degree").alias("degree")), _INDEX + "SELECT count(*) AS n, round(avg(score), 4) AS score, max(degree) AS degree FROM idx"),
    "drill_distributions": (lambda c: _index(c).select(F.explode(F.create_map(F.lit("tier"), F.col("tier").cast("string"), F.lit("folder"), F.col("folder"), F.lit("bucket"), F.col("bucket"))).alias("dimension", "value")).groupBy("dimension", "value").agg(F.count("*").alias("count")), _INDEX + "SELECT dimension, value, count(*) AS count FROM (SELECT 'tier' AS dimension, CAST(tier AS VARCHAR) AS value FROM idx UNION ALL SELECT 'folder', folder FROM idx UNION ALL SELECT 'bucket', bucket FROM idx) GROUP BY ALL"),
    # waves, duplicates, clusters
    "migration_waves": (_waves, _WAVES),
    "near_duplicates": (lambda c: usage.similarity_pairs(c.access).where("sim >= 0.4").select("a", "b", F.when(F.col("sim") >= 0.7, "near").otherwise("partial").alias("match_type"), F.round("sim", 6).alias("similarity")), "SELECT a, b, CASE WHEN sim >= 0.7 THEN 'near' ELSE 'partial' END AS match_type, round(sim, 6) AS similarity FROM jaccard WHERE sim >= 0.4"),
    "cluster_tier_mix": (lambda c: _labels(c).join(c.tiers, "sid").groupBy("cluster", "tier").agg(F.count("*").alias("n")), _LABELS + "SELECT cluster, tier, count(*) AS n FROM labels JOIN tiers USING (sid) GROUP BY ALL"),
    "cross_cluster_edges": (_cross, _LABELS + "SELECT least(x.cluster, y.cluster) AS from_cluster, greatest(x.cluster, y.cluster) AS to_cluster, count(*) AS n FROM edges JOIN by_tier x ON x.sid = src JOIN by_tier y ON y.sid = dst WHERE x.cluster <> y.cluster GROUP BY ALL"),
    "cluster_summary": (lambda c: c.tiered.join(_labels(c), "sid").groupBy("cluster").agg(F.count("*").alias("sessions"), F.min("tier").alias("first_tier"), F.max("tier").alias("last_tier"), F.count_if("critical").alias("critical")), _LABELS + "SELECT cluster, count(*) AS sessions, min(tier) AS first_tier, max(tier) AS last_tier, count(*) FILTER (critical) AS critical FROM cat_s JOIN labels USING (sid) GROUP BY cluster"),
    "label_propagation": (_label_propagation, None),
    "kmeans_embeddings": (_kmeans, None),
    "project_2d": (_pca, None),
}
