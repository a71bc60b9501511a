"""Differences between snapshots, merges of catalogs, and operators on cluster labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: The fields in which two states of a session are compared, and its lists.
FIELDS = (
    "tier", "step", "transforms", "ext_reads", "lookup_count", "critical", "total_loc", "total_functions_used", "distinct_functions_used", "has_embedded_sql", "has_embedded_java", "has_stored_procedure", "core_intent",
    "expression_count", "field_mapping_count",
)
LISTS = ("sources", "targets", "lookups")


def snapshots(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two states of the sessions: b lacks some, has other names for some, and changed transform counts, lookups and criticality."""
    k = F.col("k")
    b = sessions.where("k % 29 <> 0").withColumn("transforms", F.when(k % 37 == 0, F.col("transforms") + 1).otherwise(F.col("transforms")))
    b = b.withColumn("lookup_count", F.when(k % 41 == 0, F.lit(0).cast("long")).otherwise(F.col("lookup_count"))).withColumn("lookups", F.when(k % 41 == 0, F.array(F.lit("added"))).otherwise(F.col("lookups")))
    b = b.withColumn("critical", F.col("critical") != (k % 43 == 0))
    shifted = sessions.where("k % 31 = 0").withColumn("full_name", F.concat("full_name", F.lit("_new")))
    return sessions, b.unionByName(shifted)


def compare_sessions(a: DataFrame, b: DataFrame, fields=FIELDS, lists=LISTS) -> DataFrame:
    """full_name, status, changes: added, removed or matched by name; of matched ones the fields that changed (``field:old>new``) and
    what lists gained and lost (``list:+x;y-z``), comma-joined, in the order of ``fields`` and ``lists``.

    Null is a value of its own, printed as ``null``; a null list is empty. Names should be unique on each side.
    """
    side = lambda df, p: df.select("full_name", F.lit(True).alias(f"in_{p}"), *[F.col(f).alias(f"{p}_{f}") for f in (*fields, *lists)])
    both = F.col("in_a") & F.col("in_b")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    items = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("matched")
    changed = [F.when(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.concat(F.lit(f"{f}:"), text(f"a_{f}"), F.lit(">"), text(f"b_{f}"))) for f in fields]
    for f in lists:
        gained, lost = (F.sort_array(F.array_except(items(x), items(y))) for x, y in ((f"b_{f}", f"a_{f}"), (f"a_{f}", f"b_{f}")))
        mark = lambda sign, x: F.when(F.size(x) > 0, F.concat(F.lit(sign), F.array_join(x, ";"))).otherwise("")
        changed.append(F.when(both & ((F.size(gained) > 0) | (F.size(lost) > 0)), F.concat(F.lit(f"{f}:"), mark("+", gained), mark("-", lost))))
    return side(a, "a").join(side(b, "b"), "full_name", "full_outer").select("full_name", status.alias("status"), F.array_join(F.array_compact(F.array(*changed)), ",").alias("changes"))


def compare_sets(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are only on one side, with status."""
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    return x.exceptAll(y).withColumn("status", F.lit("removed")).unionByName(y.exceptAll(x).withColumn("status", F.lit("added")))


def merge_uploads(a: DataFrame, b: DataFrame) -> DataFrame:
    """sid, source: union of two catalogs; of equal ids the first catalog's row stays."""
    both = a.select("sid", F.lit(1).alias("source")).unionByName(b.select("sid", F.lit(2).alias("source")))
    return both.groupBy("sid").agg(F.min("source").alias("source"))


def merge_duplicates(sessions: DataFrame) -> DataFrame:
    """folder, workflow, targets, sid, members: sessions with the same targets in a workflow; the richest stays."""
    key = ["folder", "workflow", "targets"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("transforms"), "sid"))
    n = F.count("*").over(Window.partitionBy(*key))
    return sessions.withColumn("r", rank).withColumn("members", n).where("r = 1").select("folder", "workflow", F.array_join("targets", ",").alias("targets"), "sid", "members")


def schema_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """sid, added, removed: wired fields by session between two states."""
    x, y = a.distinct().withColumn("a", F.lit(1)), b.distinct().withColumn("b", F.lit(1))
    both = x.join(y, ["sid", "field"], "full_outer")
    return both.groupBy("sid").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count("*").alias("fields"))


def cluster_by_name(sessions: DataFrame, most: int = 500) -> DataFrame:
    """sid, cluster: a type in parentheses, else the name before its last underscore part, else the name.

    Where that makes more than ``most`` groups, those are merged by the name's first part.
    """
    kind = F.regexp_extract("name", r"\(([^()]+)\)", 1)
    prefix = F.regexp_extract("name", r"^(.+)_[^_]*$", 1)
    named = sessions.select("sid", "name", F.when(kind != "", kind).when(prefix != "", prefix).otherwise(F.col("name")).alias("cluster"))
    groups = named.agg(F.countDistinct("cluster").alias("groups"))
    merged = F.when(F.col("groups") > most, F.substring_index("cluster", "_", 1)).otherwise(F.col("cluster"))
    return named.crossJoin(F.broadcast(groups)).select("sid", merged.alias("cluster"))


def cluster_by_workflow(sessions: DataFrame) -> DataFrame:
    """sid, cluster: the workflow and the last digit of the session's name; a labelling for tests of operators on labels."""
    return sessions.select("sid", F.concat_ws(".", "workflow", F.substring("name", -1, 1)).alias("cluster"))


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity of a labelling of the weighted graph (a, b, sim)."""
    la, lb = labels.select(F.col("sid").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("sid").alias("b"), F.col("cluster").alias("cb"))
    marked = pairs.join(la, "a").join(lb, "b")
    ends = marked.select(F.col("ca").alias("c"), "sim").unionByName(marked.select(F.col("cb").alias("c"), "sim"))
    degree = ends.groupBy("c").agg(F.sum("sim").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    return marked.agg(F.sum("sim").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("sim")).otherwise(0.0)).alias("inside")).crossJoin(degree).select(F.round(F.col("inside") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def supernode_graph(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """from_cluster, to_cluster, weight, pairs: mean similarity over all member pairs of two clusters, above 0.01."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    la, lb = labels.select(F.col("sid").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("sid").alias("b"), F.col("cluster").alias("cb"))
    across = pairs.join(la, "a").join(lb, "b").where("ca <> cb").groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.sum("sim").alias("s"), F.count("*").alias("pairs"))
    sized = across.join(sizes.select(F.col("cluster").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("cluster").alias("y"), F.col("n").alias("ny")), "y")
    return sized.select(F.col("x").alias("from_cluster"), F.col("y").alias("to_cluster"), F.round(F.col("s") / (F.col("nx") * F.col("ny")), 6).alias("weight"), "pairs").where("weight > 0.01")


def pivot_tables(labels: DataFrame, access: DataFrame, n: int = 5) -> DataFrame:
    """cluster, tname, members: the five most used tables of each cluster."""
    used = access.select("sid", "tname").distinct().join(labels, "sid").groupBy("cluster", "tname").agg(F.count("*").alias("members"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("members"), "tname"))
    return used.withColumn("r", rank).where(F.col("r") <= n).select("cluster", "tname", "members")


def domain_tables(labels: DataFrame, access: DataFrame) -> DataFrame:
    """cluster, tname, role: core tables are used by more than half of a cluster, cross ones by several."""
    used = access.select("sid", "tname").distinct().join(labels, "sid").groupBy("cluster", "tname").agg(F.count("*").alias("members"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    spread = used.groupBy("tname").agg(F.count("*").alias("clusters"))
    return used.join(sizes, "cluster").join(spread, "tname").select("cluster", "tname", F.when(2 * F.col("members") > F.col("n"), "core").otherwise("peripheral").alias("role"), (F.col("clusters") > 1).alias("cross"))


def co_association(pairs: DataFrame, labelings: list[DataFrame]) -> DataFrame:
    """a, b, fraction: share of the labellings that put a pair together, of the given pairs (a, b) that any does.

    Pairs are those of a similarity graph; all pairs of a cluster grow with its square and are never made.
    Labels below 0 (noise) match nothing.
    """
    met = pairs.select("a", "b")
    for k, labels in enumerate(labelings):
        of = labels.select("sid", F.col("cluster").cast("string").alias("c")).where("c <> '-1'")
        met = met.join(of.select(F.col("sid").alias("a"), F.col("c").alias(f"a{k}")), "a", "left").join(of.select(F.col("sid").alias("b"), F.col("c").alias(f"b{k}")), "b", "left")
    same = sum(F.coalesce((F.col(f"a{k}") == F.col(f"b{k}")).cast("int"), F.lit(0)) for k in range(len(labelings)))
    return met.select("a", "b", F.round(same / F.lit(float(len(labelings))), 6).alias("fraction")).where("fraction > 0")
