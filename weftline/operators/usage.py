"""Who reads, writes and looks up which table, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.ranking import positions


def table_usage(access: DataFrame) -> DataFrame:
    """tname, writers, readers, lookup_users: distinct sessions."""
    n = lambda role: F.count_if(F.col("role") == role)
    return access.groupBy("tname").agg(n("target").alias("writers"), n("source").alias("readers"), n("lookup").alias("lookup_users"))


def _names(role: str):
    return F.array_join(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("sid")))), ",")


def write_conflicts(access: DataFrame, tiers: DataFrame) -> DataFrame:
    """tname, writer_count, writers, tier of tables that two or more sessions write."""
    shared = access.where("role = 'target'").join(tiers, "sid").groupBy("tname").agg(F.count("*").alias("writer_count"), F.array_join(F.sort_array(F.collect_list("sid")), ",").alias("writers"), (F.max("tier") + 0.5).alias("tier"))
    return shared.where("writer_count > 1")


def source_only_tables(access: DataFrame) -> DataFrame:
    return access.where("role <> 'target'").join(access.where("role = 'target'").select("tname"), "tname", "left_anti").select("tname").distinct()


def read_chains(access: DataFrame) -> DataFrame:
    """tname, writers, readers, chain_length of tables written by some and read by others."""
    writes = access.where("role = 'target'").select("tname", "sid")
    readers = access.where("role = 'source'").select("tname", "sid").join(writes, ["tname", "sid"], "left_anti").groupBy("tname").agg(F.count("*").alias("readers"))
    both = writes.groupBy("tname").agg(F.count("*").alias("writers")).join(readers, "tname")
    return both.withColumn("chain_length", F.col("writers") + F.col("readers"))


def table_nodes(access: DataFrame, tiers: DataFrame) -> DataFrame:
    """tname, type, tier, conflict_writers, readers, lookup_users."""
    last = access.where("role = 'target'").join(tiers, "sid").groupBy("tname").agg(F.max("tier").alias("last"))
    kind = F.when(F.col("writers") == 0, "source").when(F.col("writers") > 1, "conflict").when(F.col("readers") + F.col("lookup_users") > 0, "chain").otherwise("independent")
    return table_usage(access).join(last, "tname", "left").select(
        "tname", kind.alias("type"), F.coalesce(F.col("last") + 0.5, F.lit(0.5)).alias("tier"), F.when(F.col("writers") > 1, F.col("writers")).otherwise(0).cast("long").alias("conflict_writers"), "readers", "lookup_users")


def typed_connections(access: DataFrame) -> DataFrame:
    """from_id, to_id, conn_type (distinct): edges between sessions and tables by the table's class."""
    use = table_usage(access).select("tname", "writers", "readers", "lookup_users")
    rows = access.join(use, "tname")
    conflict = F.col("writers") > 1
    chain = (F.col("writers") == 1) & (F.col("readers") + F.col("lookup_users") > 0)
    written = rows.where("role = 'target'").select(F.col("sid").alias("from_id"), F.col("tname").alias("to_id"), F.when(conflict, "write_conflict").when(chain, "chain").otherwise("write_clean").alias("conn_type"))
    read = rows.where("role = 'source'").select(F.col("tname").alias("from_id"), F.col("sid").alias("to_id"), F.when(conflict, "read_after_write").when(F.col("writers") == 1, "chain").otherwise("source_read").alias("conn_type"))
    looked = rows.where("role = 'lookup'").select(F.col("tname").alias("from_id"), F.col("sid").alias("to_id"), F.lit("lookup_stale").alias("conn_type"))
    return written.unionByName(read).unionByName(looked).distinct()


def table_profiles(access: DataFrame) -> DataFrame:
    """tname, counts and lists by role, total_refs."""
    lists = access.groupBy("tname").agg(*[F.count_if(F.col("role") == r).alias(f"{n}_count") for r, n in (("target", "writer"), ("source", "reader"), ("lookup", "lookup"))], *[_names(r).alias(n) for r, n in (("target", "writers"), ("source", "readers"), ("lookup", "lookups"))])
    return lists.withColumn("total_refs", F.col("writer_count") + F.col("reader_count") + F.col("lookup_count"))


def endpoints(connections: DataFrame) -> DataFrame:
    """node_id, conn_type: each edge at both ends."""
    return connections.select(F.explode(F.array("from_id", "to_id")).alias("node_id"), "conn_type")


def node_degree(connections: DataFrame) -> DataFrame:
    """node_id, conn_type, degree; the type ``all`` sums a node's edges."""
    return endpoints(connections).rollup("node_id", "conn_type").agg(F.count("*").alias("degree")).where("node_id is not null").select("node_id", F.coalesce("conn_type", F.lit("all")).alias("conn_type"), "degree")


def shared_table_pairs(access: DataFrame, max_share: int | None = None) -> DataFrame:
    """a, b, shared: session pairs with their number of shared tables; hotter tables than max_share are left out."""
    held = access.select("sid", "tname").distinct()
    if max_share is not None:
        cold = held.groupBy("tname").agg(F.count("*").alias("n")).where(F.col("n") <= max_share)
        held = held.join(cold.select("tname"), "tname", "left_semi")
    other = held.select("tname", F.col("sid").alias("b"))
    return held.withColumnRenamed("sid", "a").join(other, "tname").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def shared_table_stars(access: DataFrame) -> DataFrame:
    """src, dst: of each table, its least session with each other one: what is linked through tables, linear in access."""
    held = access.select("sid", "tname").distinct()
    hubs = held.groupBy("tname").agg(F.min("sid").alias("dst"))
    return held.join(hubs, "tname").where("sid <> dst").select(F.col("sid").alias("src"), "dst").distinct()


def max_share(sessions: DataFrame) -> int:
    """The reference's bound of a table's sessions in the similarity graph; hotter tables link nothing there."""
    return min(500, sessions.count() // 2 + 1)


def similarity_pairs(access: DataFrame, metric: str = "jaccard", max_share: int | None = None) -> DataFrame:
    """a, b, sim: jaccard, cosine or overlap of table sets, for pairs that share a table."""
    sizes = access.select("sid", "tname").distinct().groupBy("sid").agg(F.count("*").alias("n"))
    pairs = shared_table_pairs(access, max_share).join(sizes.select(F.col("sid").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b")
    below = {"jaccard": F.col("na") + F.col("nb") - F.col("shared"), "cosine": F.sqrt(F.col("na") * F.col("nb")), "overlap": F.least("na", "nb")}[metric]
    return pairs.select("a", "b", (F.col("shared") / below).alias("sim"))


def coupling_counts(access: DataFrame, bound: int = 500) -> DataFrame:
    """sid, coupled: other sessions that share a table, exact.

    Tables of more than ``bound`` sessions make no pairs: sessions with one set of such tables are one row with a count, and
    sets meet sets. Other tables make at most ``bound`` pairs a session, of which those stay whose sessions do not meet
    in a hot table anyway.
    """
    held = access.select("sid", "tname").distinct()
    users = held.groupBy("tname").agg(F.count("*").alias("n"))
    hot = held.join(users.where(F.col("n") > bound).select("tname"), "tname", "left_semi").groupBy("sid").agg(F.sort_array(F.collect_set("tname")).alias("hot"))
    sets = hot.groupBy("hot").agg(F.count("*").alias("n"))
    ends = sets.select("hot", "n", F.explode("hot").alias("tname"))
    met = ends.select("hot", "tname").join(ends.select(F.col("hot").alias("other"), "n", "tname"), "tname").select("hot", "other", "n").distinct()
    reach = hot.join(met.groupBy("hot").agg((F.sum("n") - 1).alias("near")), "hot").select("sid", "near")
    cold = held.join(users.where(F.col("n") <= bound).select("tname"), "tname", "left_semi")
    pairs = cold.join(cold.select(F.col("sid").alias("b"), "tname"), "tname").where("sid <> b").select("sid", "b").distinct()
    apart = pairs.join(hot, "sid", "left").join(hot.select(F.col("sid").alias("b"), F.col("hot").alias("theirs")), "b", "left")
    apart = apart.where(~F.coalesce(F.arrays_overlap("hot", "theirs"), F.lit(False)))
    counts = apart.groupBy("sid").agg(F.count("*").alias("far"))
    rows = access.select("sid").distinct().join(counts, "sid", "left").join(reach, "sid", "left")
    return rows.select("sid", (F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0))).cast("long").alias("coupled"))


def table_gravity(access: DataFrame) -> DataFrame:
    """tname, r, w, l, gravity, is_hub: readers x writers x (1 + lookups); hubs are the top twentieth."""
    rows = table_usage(access).select("tname", F.col("readers").alias("r"), F.col("writers").alias("w"), F.col("lookup_users").alias("l"), (F.col("readers") * F.col("writers") * (1 + F.col("lookup_users"))).alias("gravity"))
    ranked = positions(rows, [F.desc("gravity"), F.asc("tname")], "place")
    hubs = ranked.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 20)).alias("hubs"))
    return ranked.crossJoin(F.broadcast(hubs)).withColumn("is_hub", F.col("place") < F.col("hubs")).drop("place", "hubs")


def reference_ranking(access: DataFrame, n: int = 50) -> DataFrame:
    """tname, refs, pct: the most used tables, and their share of all sessions with access."""
    total = access.agg(F.countDistinct("sid").alias("total"))
    refs = access.groupBy("tname").agg(F.countDistinct("sid").alias("refs")).orderBy(F.desc("refs"), "tname").limit(n)
    return refs.crossJoin(F.broadcast(total)).select("tname", "refs", F.round(100.0 * F.col("refs") / F.col("total"), 6).alias("pct"))


def infra_systems(access: DataFrame) -> DataFrame:
    """system, environment, sessions, tables, sample (50 names): a table's prefix stands for its system."""
    system = F.substring_index("tname", "_", 1)
    environment = F.when(system.isin("L0", "L1"), "landing").when(system.isin("L2", "L3"), "staging").otherwise("serving")
    rows = access.select(system.alias("system"), environment.alias("environment"), "sid", "tname")
    keys = ["system", "environment"]
    none = [F.lit(0).cast("long"), F.lit(None).cast("string")]
    sessions = rows.select(*keys, "sid").distinct().groupBy(*keys).agg(F.count("sid").alias("sessions")).select(*keys, "sessions", none[0].alias("tables"), none[1].alias("sample"))
    names = rows.select(*keys, "tname").distinct()
    tables = names.groupBy(*keys).agg(F.count("tname").alias("tables")).select(*keys, none[0].alias("sessions"), "tables", none[1].alias("sample"))
    # tasks keep their first 50 names each, so none holds all names of a system
    first = names.where("tname is not null").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("tname"))).where("place <= 50")
    sample = first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("tname")), ",").alias("sample")).select(*keys, none[0].alias("sessions"), none[0].alias("tables"), "sample")
    return sessions.unionByName(tables).unionByName(sample).groupBy(*keys).agg(F.sum("sessions").alias("sessions"), F.sum("tables").alias("tables"), F.coalesce(F.max("sample"), F.lit("")).alias("sample"))


def infra_edges(access: DataFrame) -> DataFrame:
    """from_system, to_system, sessions, direction: systems that sessions read and write."""
    rows = access.withColumn("system", F.substring_index("tname", "_", 1))
    read = rows.where("role <> 'target'").select("sid", F.col("system").alias("from_system")).distinct()
    wrote = rows.where("role = 'target'").select("sid", F.col("system").alias("to_system")).distinct()
    edges = read.join(wrote, "sid").where("from_system <> to_system").groupBy("from_system", "to_system").agg(F.countDistinct("sid").alias("sessions"))
    back = edges.select(F.col("to_system").alias("from_system"), F.col("from_system").alias("to_system"), F.lit(True).alias("back"))
    return edges.join(back, ["from_system", "to_system"], "left").select("from_system", "to_system", "sessions", F.when(F.col("back"), "both").otherwise("one").alias("direction"))
