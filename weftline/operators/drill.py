"""Drill-down views: one group, scope, session or table with what surrounds it; pages and rankings of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_drill(sessions: DataFrame, edges: DataFrame, macro: DataFrame, meso: DataFrame, scores: DataFrame, group: str) -> dict[str, DataFrame]:
    """Of one macro group: its sessions with meso cluster and score, its sub-clusters, and edges with an end inside."""
    inside = macro.where(F.col("cluster") == group).select("sid")
    members = sessions.join(inside, "sid", "left_semi").join(meso.withColumnRenamed("cluster", "meso"), "sid", "left").join(scores.select("sid", "score"), "sid", "left").select("sid", "name", "meso", "score")
    sub = members.groupBy("meso").agg(F.count("*").alias("sessions"), F.round(F.avg(F.coalesce("score", F.lit(50.0)).cast("decimal(12,2)")), 2).cast("double").alias("score"))
    source = edges.join(inside.withColumnRenamed("sid", "src"), "src", "left_semi")
    target = edges.join(inside.withColumnRenamed("sid", "dst"), "dst", "left_semi")
    return {"sessions": members, "clusters": sub, "edges": source.select("src", "dst").union(target.select("src", "dst")).distinct()}


def scope_drill(sessions: DataFrame, edges: DataFrame, cycles: DataFrame, chosen: Column) -> dict[str, DataFrame]:
    """Of the sessions that ``chosen`` (a sub-cluster, a name prefix) names: they, the edges inside, the cycles they are in."""
    inside = sessions.where(chosen).select("sid")
    inner = edges.join(inside.withColumnRenamed("sid", "src"), "src", "left_semi").join(inside.withColumnRenamed("sid", "dst"), "dst", "left_semi")
    met = cycles.where("is_cycle").join(inside.withColumnRenamed("sid", "node"), "node", "left_semi").select("group").distinct()
    return {"sessions": inside, "edges": inner.select("src", "dst"), "cycles": cycles.join(met, "group", "left_semi").select("group", "node")}


def session_blueprint(sessions: DataFrame, edges: DataFrame, scores: DataFrame, sid: DataFrame) -> DataFrame:
    """sid, name, tier, score, direction, other: one session (``sid``, one row) and its direct neighbours; without any, one row."""
    one = sessions.join(F.broadcast(sid), "sid", "left_semi").join(scores.select("sid", "score"), "sid", "left").select("sid", "name", "tier", "score")
    up = edges.select(F.col("dst").alias("sid"), F.lit("upstream").alias("direction"), F.col("src").alias("other"))
    down = edges.select(F.col("src").alias("sid"), F.lit("downstream").alias("direction"), F.col("dst").alias("other"))
    return one.join(up.unionByName(down), "sid", "left").select("sid", "name", "tier", "score", "direction", "other")


def object_detail(tables: DataFrame, connections: DataFrame, tname: str) -> DataFrame:
    """tname, type, tier, and who touches it: relation (reads: source_read edges only; writes) and sid."""
    one = tables.where(F.col("tname") == tname).select("tname", "type", "tier")
    reads = connections.where(F.col("conn_type") == "source_read").select(F.col("from_id").alias("tname"), F.lit("reads").alias("relation"), F.col("to_id").alias("sid"))
    writes = connections.select(F.col("to_id").alias("tname"), F.lit("writes").alias("relation"), F.col("from_id").alias("sid"))
    return one.join(reads.unionByName(writes), "tname", "left").select("tname", "type", "tier", "relation", "sid")


def tag_objects(objects: DataFrame, tags: DataFrame, tag_type: str | None = None) -> DataFrame:
    """object_type, object_id, n_tags, latest: objects with their tags, of one type if asked for; objects without have 0."""
    chosen = tags if tag_type is None else tags.where(F.col("tag_type") == tag_type)
    counted = chosen.groupBy("object_type", "object_id").agg(F.count("*").alias("n_tags"), F.max(F.struct("created", "tag_id")).alias("last"))
    return objects.join(counted, ["object_type", "object_id"], "left").select("object_type", "object_id", F.coalesce("n_tags", F.lit(0)).cast("long").alias("n_tags"), F.col("last.tag_id").alias("latest"))


def cluster_page(summary: DataFrame, pivots: DataFrame, search: str, order: list[Column], limit: int) -> DataFrame:
    """Clusters whose name, or a pivot table of theirs, holds the text; sorted."""
    holds = lambda c: F.contains(F.lower(c), F.lit(search.lower()))
    named = pivots.where(holds("tname")).select("cluster").union(summary.where(holds("cluster")).select("cluster")).distinct()
    return summary.join(named, "cluster", "left_semi").orderBy(*order).limit(limit)


def rank_sessions(results: DataFrame, mode: str, limit: int) -> DataFrame:
    """Sessions by criticality (degree), reach (tier), name, or contested first; then by id."""
    orders = {"criticality": [F.desc("degree")], "reach": [F.desc("tier")], "name": [F.col("name")], "contested": [F.desc("critical"), F.desc("degree")]}
    return results.orderBy(*orders[mode], "sid").limit(limit)


def per_type_topk(hits: DataFrame, k: int = 5, total: int = 15) -> DataFrame:
    """type, id, distance: the ``k`` nearest of each type, once each, and of those the ``total`` nearest."""
    single = hits.groupBy("type", "id").agg(F.min("distance").alias("distance"))
    # first in parts of a type, so no task holds a type
    parted = Window.partitionBy("type", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("distance", "id")
    near = single.withColumn("r", F.row_number().over(parted)).where(F.col("r") <= k)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("distance", "id")))
    return ranked.where(F.col("r") <= k).orderBy("distance", "type", "id").limit(total).select("type", "id", "distance")


def merge_platforms(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two catalogs in one: numeric ids of the second are shifted past the first's; edges follow; stats summed.

    Catalogs hold sessions (id long, name), tables (id long, tname) and connections (from_id, to_id long: session
    and table ids, conn_type).
    """
    out = {}
    shifts = {}
    for part in ("sessions", "tables"):
        shifts[part] = first[part].agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("shift"))
        moved = second[part].crossJoin(F.broadcast(shifts[part])).withColumn("id", F.col("id") + F.col("shift")).drop("shift")
        out[part] = first[part].withColumn("platform", F.lit(1)).unionByName(moved.withColumn("platform", F.lit(2)))
    both = shifts["sessions"].withColumnRenamed("shift", "s").crossJoin(shifts["tables"].withColumnRenamed("shift", "t"))
    edges = second["connections"].crossJoin(F.broadcast(both)).select((F.col("from_id") + F.col("s")).alias("from_id"), (F.col("to_id") + F.col("t")).alias("to_id"), "conn_type")
    out["connections"] = first["connections"].unionByName(edges)
    out["stats"] = out["sessions"].groupBy("platform").agg(F.count("*").alias("sessions"), F.max("id").alias("last_id"))
    return out


def merge_session_lists(parts: DataFrame) -> DataFrame:
    """full_name, workflow, tables: sessions from several files; their lists united, the first file's workflow kept.

    ``parts`` has file, full_name, workflow and tname (a row for each table, null for none).
    """
    first = F.min(F.struct(F.col("workflow").isNull().alias("none"), "file", "workflow"))
    return parts.groupBy("full_name").agg(first.alias("w"), F.array_join(F.sort_array(F.collect_set("tname")), ",").alias("tables")).select("full_name", F.col("w.workflow").alias("workflow"), "tables")


def connection_topology(profiles: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Connections of each system with host, database and the sessions that use them; systems that a session joins.

    ``profiles``: connection, system, host, database. ``links``: sid, connection.
    """
    used = links.groupBy("connection").agg(F.countDistinct("sid").alias("sessions"))
    nodes = profiles.join(used, "connection", "left").select("system", "connection", "host", "database", F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"))
    of = links.join(profiles.select("connection", "system"), "connection").select("sid", "system").distinct()
    other = of.select("sid", F.col("system").alias("to_system"))
    edges = of.withColumnRenamed("system", "from_system").join(other, "sid").where("from_system < to_system").groupBy("from_system", "to_system").agg(F.count("*").alias("sessions"))
    return {"nodes": nodes, "edges": edges}


def assign_orphans(access: DataFrame, labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """sid, cluster of every session: an unlabelled one goes to the cluster with which it shares most tables, else its own.

    Clusters are counted by table first, so no pair of sessions is made.
    """
    orphan = sessions.select("sid").join(labels, "sid", "left_anti")
    held = access.select("sid", "tname").distinct()
    by_table = held.join(labels, "sid").select("tname", "cluster").distinct()
    shared = held.join(orphan, "sid", "left_semi").join(by_table, "tname").groupBy("sid", "cluster").agg(F.count("*").alias("n"))
    best = shared.groupBy("sid").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster")).alias("b")).select("sid", F.col("b.cluster").alias("cluster"))
    own = orphan.join(best, "sid", "left").select("sid", F.coalesce("cluster", F.concat(F.lit("own:"), "sid")).alias("cluster"))
    return labels.select("sid", "cluster").unionByName(own)


def cluster_centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, x, y, size: mean position of its members."""
    return points.join(labels, "sid").groupBy("cluster").agg(F.round(F.avg(F.col("x").cast("decimal(18,6)")), 6).cast("double").alias("x"), F.round(F.avg(F.col("y").cast("decimal(18,6)")), 6).cast("double").alias("y"), F.count("*").alias("size"))


def majority_consensus(labelings: list[DataFrame]) -> DataFrame:
    """sid, cluster, agreement, contested: the first labelling's cluster; the share of labellings in which the session
    lies in the cluster that most of its own cluster's members lie in."""
    base = labelings[0].select("sid", F.col("cluster").alias("base"))
    agreed = base.withColumn("n", F.lit(1))
    for k, labels in enumerate(labelings[1:], 1):
        both = base.join(labels.select("sid", F.col("cluster").cast("string").alias("c")), "sid")
        main = both.groupBy("base", "c").agg(F.count("*").alias("m")).groupBy("base").agg(F.min(F.struct((-F.col("m")).alias("m"), "c")).alias("b")).select("base", F.col("b.c").alias("c"))
        hit = both.join(main, ["base", "c"], "left_semi").select("sid", F.lit(1).alias(f"hit{k}"))
        agreed = agreed.join(hit, "sid", "left").withColumn("n", F.col("n") + F.coalesce(f"hit{k}", F.lit(0))).drop(f"hit{k}")
    share = F.round(F.col("n") / F.lit(len(labelings)), 6)
    return agreed.select("sid", F.col("base").alias("cluster"), share.alias("agreement"), (share < 0.5).alias("contested"))


def nearest_exemplar(pairs: DataFrame, exemplars: DataFrame) -> DataFrame:
    """sid, exemplar: of each other session, the most similar exemplar that it shares a pair with."""
    both = pairs.select(F.col("a").alias("sid"), F.col("b").alias("exemplar"), "sim").unionByName(pairs.select(F.col("b").alias("sid"), F.col("a").alias("exemplar"), "sim"))
    e = exemplars.select(F.col("sid").alias("exemplar"))
    near = both.join(e, "exemplar", "left_semi").join(e.withColumnRenamed("exemplar", "sid"), "sid", "left_anti")
    return near.groupBy("sid").agg(F.min(F.struct((-F.round("sim", 9)).alias("s"), "exemplar")).alias("b")).select("sid", F.col("b.exemplar").alias("exemplar"))


def group_cohesion(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, size, cohesion, coupling: mean similarity over all pairs inside, and over all pairs with the outside.

    Pairs that share nothing count as 0, so sums over the sparse pairs are divided by the numbers of pairs.
    """
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    total = labels.agg(F.count("*").alias("total"))
    la, lb = labels.select(F.col("sid").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("sid").alias("b"), F.col("cluster").alias("cb"))
    marked = pairs.join(la, "a").join(lb, "b").withColumn("sim", F.round("sim", 9).cast("decimal(18,9)"))
    inside = marked.where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("sim").alias("inner_sum"))
    across = marked.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("cluster"), "sim").groupBy("cluster").agg(F.sum("sim").alias("outer_sum"))
    n, rest = F.col("size"), F.col("total") - F.col("size")
    part = lambda s, pairs_: F.round(F.when(pairs_ > 0, F.coalesce(F.col(s), F.lit(0)).cast("double") / pairs_).otherwise(0.0), 6)
    return sizes.join(inside, "cluster", "left").join(across, "cluster", "left").crossJoin(F.broadcast(total)).select("cluster", "size", part("inner_sum", n * (n - 1) / 2).alias("cohesion"), part("outer_sum", n * rest).alias("coupling"))


def independent_sessions(features: DataFrame, most_similar: DataFrame) -> DataFrame:
    """sid, type, confidence, reasons: sessions that hang together with no other.

    Six criteria: nothing upstream, nothing downstream, no write conflict, no chain, no lookup at risk, no similar
    session (below 0.2). All six: full; four or five, with no similar session: near.
    """
    joined = features.join(most_similar, "sid", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    rules = [("no_upstream", F.col("upstream_count") == 0), ("no_downstream", F.col("downstream_count") == 0), ("no_conflict", F.col("write_conflict_count") == 0), ("no_chain", F.col("chain_involvement") == 0), ("no_staleness", F.col("staleness_risk") == 0), ("not_similar", F.col("sim") < 0.2)]
    reasons = F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())
    rows = joined.select("sid", "sim", reasons.alias("r"))
    n = F.size("r")
    return rows.where((n >= 4) & (F.col("sim") < 0.2)).select("sid", F.when(n == 6, "full").otherwise("near").alias("type"), F.round(n / 6.0, 6).alias("confidence"), F.array_join("r", ",").alias("reasons"))


def cluster_entropy(labels: DataFrame) -> DataFrame:
    """clusters, entropy: number of clusters and entropy of their sizes in bits."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    p = F.col("n") / F.col("total")
    return sizes.crossJoin(F.broadcast(total)).agg(F.count("*").alias("clusters"), F.round(-F.sum(F.round(p * F.log2(p), 12).cast("decimal(18,12)")).cast("double"), 6).alias("entropy"))
