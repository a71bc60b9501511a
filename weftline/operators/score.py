"""Scores, ranks, outliers and estimates of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.ranking import positions

DIMENSIONS = {"transforms": 0.3, "join_count": 0.15, "filter_count": 0.1, "router_count": 0.1, "lookup_count": 0.1, "ext_reads": 0.05, "n_sources": 0.1, "n_targets": 0.1}
#: The dimensions of complexity and their weights, which sum to 1.
COMPLEXITY = {
    "transform_volume": 0.10, "diversity": 0.07, "risk": 0.12, "io_volume": 0.07, "lookup_intensity": 0.07, "coupling": 0.10, "structural_depth": 0.07, "external_reads": 0.05,
    "expression_complexity": 0.08, "parameter_dependency": 0.04, "sql_override_complexity": 0.05, "join_complexity": 0.05, "field_mapping_density": 0.04, "lookup_cache_potential": 0.03,
    "error_handling": 0.03, "schedule_dependency": 0.03,
}
#: Dimensions where 0 is a place like others; elsewhere 0 means no complexity.
RANKED_ZEROS = ("diversity", "structural_depth")
HOURS = {"low": (4, 8, 16), "medium": (8, 16, 32), "high": (16, 32, 64), "very_high": (32, 64, 120)}


def percentile_norm(df: DataFrame, column: str, name: str = "norm", zero_floor: bool = False) -> DataFrame:
    """``df`` with the place of each value among all rows from 0 to 100, ties by mean rank; one row gives 50. With ``zero_floor`` values
    of 0 and less are 0, and the others are placed among themselves, at 1 at least. Values are counted first, so ties cost one row."""
    value = F.col("value")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("ties"))
    if zero_floor:
        counts = counts.where(value > 0)
    ranked = positions(counts, ["value"], "below", "ties")
    total = ranked.agg(F.sum("ties").alias("n"))
    raw = 100.0 * (F.col("below") + (F.col("ties") - 1) / 2.0) / F.greatest(F.col("n") - 1, F.lit(1))
    norm = F.when(F.col("n") == 1, F.lit(50.0)).otherwise(F.greatest(F.lit(1.0), raw) if zero_floor else raw)
    norms = ranked.crossJoin(F.broadcast(total)).select(F.col("value").alias(column), norm.alias(name))
    placed = df.join(norms, column, "left")
    return placed.withColumn(name, F.coalesce(name, F.lit(0.0))) if zero_floor else placed


def features(sessions: DataFrame) -> DataFrame:
    return sessions.select("sid", "name", "tier", "workflow", *[c for c in DIMENSIONS if c not in ("n_sources", "n_targets")], F.size("sources").cast("long").alias("n_sources"), F.size("targets").cast("long").alias("n_targets"))


def complexity_inputs(features: DataFrame, coupling: DataFrame) -> DataFrame:
    """sid and the raw value of each dimension of ``COMPLEXITY`` from feature rows and (sid, coupled)."""
    reads = F.col("source_table_count") + F.col("target_table_count") + F.col("lookup_table_count")
    raw = {
        "transform_volume": F.col("transform_count"), "diversity": F.col("total_table_footprint"), "risk": F.col("write_conflict_count") + F.col("staleness_risk"), "io_volume": reads,
        "lookup_intensity": F.col("lookup_count"), "coupling": F.coalesce("coupled", F.lit(0)), "structural_depth": F.col("dependency_depth"), "external_reads": F.col("ext_reads"),
        "expression_complexity": F.col("expression_complexity_score"), "parameter_dependency": F.col("parameter_count"), "sql_override_complexity": F.col("sql_override_count"), "join_complexity": F.col("join_count"),
        "field_mapping_density": F.round(F.col("field_count") / F.greatest(F.col("transform_count"), F.lit(1.0)), 6), "lookup_cache_potential": F.col("lookup_cache_potential"),
        "error_handling": F.col("filter_count") + F.col("router_group_count"), "schedule_dependency": F.col("schedule_frequency_code"),
    }
    return features.join(coupling, "sid", "left").select("sid", *[raw[d].cast("double").alias(d) for d in COMPLEXITY])


def complexity_score(rows: DataFrame) -> DataFrame:
    """sid, score, bucket, hours, raw_d and norm_d of each dimension d, top_drivers (the three that add most, earlier ones
    first among equals).

    A norm is the place of a value among all sessions from 0 to 100, ties by mean rank; but for ``RANKED_ZEROS`` values of 0 and
    less are 0 and the others are placed among themselves, at 1 at least. One value alone is 50. The long form has a row a
    session and dimension; values are counted first and placed by range partitions, so no task holds a dimension. Null
    counts as 0. Empty input: no rows.
    """
    names = list(COMPLEXITY)
    long = rows.selectExpr("sid", f"stack({len(names)}, {', '.join(f"{k}, coalesce({d}, 0d)" for k, d in enumerate(names))}) as (dimension, value)")
    floored = ~F.col("dimension").isin([names.index(d) for d in RANKED_ZEROS])
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("ties"))
    kept = counts.where(~floored | (F.col("value") > 0))
    ranked = positions(kept, ["dimension", "value"], "before", "ties")
    whole = ranked.groupBy("dimension").agg(F.min("before").alias("first"), F.sum("ties").alias("n"))
    below = F.col("before") - F.col("first")
    place = 100.0 * (below + (F.col("ties") - 1) / 2.0) / F.greatest(F.col("n") - 1, F.lit(1))
    norms = ranked.join(F.broadcast(whole), "dimension").select("dimension", "value", F.when(F.col("n") == 1, F.lit(50.0)).otherwise(F.when(floored, F.greatest(F.lit(1.0), place)).otherwise(place)).alias("norm"))
    alone = F.broadcast(rows.agg((F.count("*") == 1).alias("alone")))
    weights = F.array(*[F.lit(w) for w in COMPLEXITY.values()])
    placed = long.join(norms, ["dimension", "value"], "left").crossJoin(alone)
    norm = F.when(F.col("alone"), F.lit(50.0)).otherwise(F.coalesce("norm", F.lit(0.0)))
    share = F.round(norm * F.element_at(weights, F.col("dimension") + 1), 6)
    placed = placed.select("sid", "dimension", "value", norm.alias("norm"), share.alias("share"))
    of = lambda k, c: F.max(F.when(F.col("dimension") == k, F.col(c)))
    drivers = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("less"), "dimension")))
    scored = placed.groupBy("sid").agg(
        F.round(F.sum(F.col("share").cast("decimal(18,6)")), 2).cast("double").alias("score"), drivers.alias("drivers"),
        *[of(k, "value").alias(f"raw_{d}") for k, d in enumerate(names)], *[F.round(of(k, "norm"), 6).alias(f"norm_{d}") for k, d in enumerate(names)])
    s = F.col("score")
    bucket = F.when(s < 30, "low").when(s < 55, "medium").when(s < 75, "high").otherwise("very_high")
    hours = F.when(s < 30, 8).when(s < 55, 16).when(s < 75, 32).otherwise(64) * 0.7
    top = F.array_join(F.transform(F.slice("drivers", 1, 3), lambda x: F.element_at(F.array(*map(F.lit, names)), x["dimension"] + 1)), ",")
    return scored.select("sid", "score", bucket.alias("bucket"), F.round(hours, 2).alias("hours"), top.alias("top_drivers"), *[f"raw_{d}" for d in names], *[f"norm_{d}" for d in names])


def complexity_summary(scores: DataFrame) -> DataFrame:
    """mean, upper median, least, greatest, population deviation and total hours."""
    totals = scores.agg(F.count("*").alias("sessions"), F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.stddev_pop("score"), 4).alias("std"), F.round(F.sum("hours"), 2).alias("hours"))
    ranked = positions(scores.groupBy("score").agg(F.count("*").alias("ties")), ["score"], "below", "ties")
    at = F.floor(F.col("sessions") / 2)
    middle = ranked.crossJoin(F.broadcast(totals.select("sessions"))).where((F.col("below") <= at) & (at < F.col("below") + F.col("ties"))).agg(F.max("score").alias("median"))
    return totals.crossJoin(F.broadcast(middle)).select("sessions", "mean", "median", "least", "most", "std", "hours")


def effort_estimate(scores: DataFrame) -> DataFrame:
    """bucket (all for the total), sessions, hours low, mid and high, weeks for a team of five."""
    def of(k: int) -> Column:
        out = F.lit(0)
        for b, h in HOURS.items():
            out = F.when(F.col("bucket") == b, F.lit(h[k])).otherwise(out)
        return out

    sums = scores.select("bucket", *[of(k).cast("long").alias(f"p{p}") for k, p in enumerate((10, 50, 90))]).rollup("bucket").agg(F.count("*").alias("sessions"), *[F.sum(f"p{p}").alias(f"p{p}") for p in (10, 50, 90)])
    return sums.select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "sessions", "p10", "p50", "p90", F.round(F.col("p50") / (5 * 40 * 0.8), 4).alias("weeks"))


def top_complex(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "sid").limit(n).select("sid", "score", "bucket")


def group_complexity(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster, avg, and sessions by bucket; a session without score counts 50."""
    # whole hundredths, so the mean does not depend on the order of the rows
    cents = F.sum(F.round(F.coalesce("score", F.lit(50.0)) * 100).cast("long"))
    mean = F.floor((cents * 200 + F.count("*")) / (2 * F.count("*"))) / 10000
    return labels.join(scores, "sid", "left").groupBy("cluster").agg(mean.alias("avg"), *[F.count_if(F.col("bucket") == b).alias(b) for b in HOURS])


def composite_heat(sessions: DataFrame, degree: DataFrame, scores: DataFrame) -> DataFrame:
    """sid, heat: 0.4 complexity + 0.3 degree + 0.3 transforms, each against its maximum."""
    d = degree.where("conn_type = 'all'").select(F.col("node_id").alias("sid"), "degree")
    rows = sessions.select("sid", "transforms").join(d, "sid", "left").join(scores.select("sid", "score"), "sid").select("sid", "transforms", F.coalesce("degree", F.lit(0)).alias("degree"), "score")
    top = rows.agg(F.max("transforms").alias("mt"), F.max("degree").alias("md"))
    share = lambda a, m: F.when(F.col(m) > 0, F.col(a) / F.col(m)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(top)).select("sid", F.round(0.4 * F.col("score") / 100 + 0.3 * share("degree", "md") + 0.3 * share("transforms", "mt"), 6).alias("heat"))


def zscore_outliers(rows: DataFrame, z: float = 2.0) -> DataFrame:
    """sid, worst, columns: sessions with a feature further than ``z`` deviations from its mean."""
    names = list(DIMENSIONS)
    moments = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"d_{c}") for c in names])
    score = lambda c: F.abs((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}")).otherwise(1.0))
    scored = rows.crossJoin(F.broadcast(moments)).select("sid", *[F.round(score(c), 6).alias(c) for c in names])
    hit = F.array_compact(F.array(*[F.when(F.col(c) > z, F.lit(c)) for c in names]))
    return scored.select("sid", F.greatest(*names).alias("worst"), F.array_join(hit, ",").alias("columns")).where("columns <> ''")


def rule_anomalies(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """sid, score, types: 0.7 of the strongest rule's weight and 0.3 of the mean of those that fire."""
    rules = [("no_targets", F.col("n_targets") == 0, 0.8), ("no_sources", F.col("n_sources") == 0, 0.6), ("many_lookups", F.col("lookup_count") >= 2, 0.5), ("many_sources", F.col("n_sources") >= 3, 0.4), ("all_external", (F.col("n_sources") > 0) & (F.col("ext_reads") == F.col("n_sources")), 0.7), ("deep", F.col("tier") >= 10, 0.6), ("heavy", F.col("transforms") >= 8, 0.5)]
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(w).alias("w"), F.lit(n).alias("n"))) for n, c, w in rules]))
    weights = F.transform("fired", lambda x: x["w"])
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    scored = rows.select("sid", fired.alias("fired")).where(F.size("fired") > 0).select("sid", F.round(0.7 * F.array_max(weights) + 0.3 * total / F.size("fired"), 6).alias("score"), F.array_join(F.transform("fired", lambda x: x["n"]), ",").alias("types"))
    return scored.where(F.col("score") >= threshold)


def minmax_features(rows: DataFrame) -> DataFrame:
    """sid and each dimension scaled to 0 to 1; a constant one stays as it is."""
    names = list(DIMENSIONS)
    ends = rows.agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names])
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(F.col(c).cast("double"))
    return rows.crossJoin(F.broadcast(ends)).select("sid", *[F.round(scaled(c), 6).alias(c) for c in names])


def compare_pair(rows: DataFrame, a: str, b: str) -> DataFrame:
    """dimension, a, b, most: two sessions side by side."""
    names = list(DIMENSIONS)
    both = rows.where(F.col("sid").isin(a, b))
    long = both.selectExpr("sid", f"stack({len(names)}, {', '.join(f"'{c}', cast({c} as long)" for c in names)}) as (dimension, value)")
    return long.groupBy("dimension").agg(F.max(F.when(F.col("sid") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("sid") == b, F.col("value"))).alias("b"), F.max("value").alias("most"))
