"""Requests and errors of a service: latency by route, and summaries of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import positions

#: From this status on a request has failed.
FAILED = 400


def failed(status: str = "status") -> Column:
    return F.coalesce(F.col(status) >= FAILED, F.lit(False))


def route_latency(requests: DataFrame) -> DataFrame:
    """route, requests, errors, nearest-rank p50, p95 and p99, mean, rate (requests a second between the first and the last of
    all requests) of requests (route, ts, ms, status).

    Ranks are exact, from counts of values in range partitions, so no task holds a route. A null route is ``unknown``;
    requests without a time count as requests, but not in percentiles and means, which are 0 where there is none.
    """
    rows = requests.select(F.coalesce("route", F.lit("unknown")).alias("route"), "ts", "ms", "status")
    span = rows.agg(F.greatest((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6, F.lit(1.0)).alias("span"))
    routes = rows.groupBy("route").agg(F.count("*").alias("requests"), F.count("ms").alias("n"), F.count_if(failed()).alias("errors"), F.round(F.avg("ms"), 7).alias("mean"))
    ranked = positions(rows.where("ms is not null").groupBy("route", "ms").agg(F.count("*").alias("ties")), ["route", "ms"], "before", "ties")
    first = ranked.groupBy("route").agg(F.min("before").alias("first"))
    rank = F.col("before") - F.col("first")
    at = lambda p: F.max(F.when((rank < F.ceil(F.col("n") * p / 100)) & (F.ceil(F.col("n") * p / 100) <= rank + F.col("ties")), F.col("ms")))
    marks = ranked.join(first, "route").join(routes.select("route", "n"), "route").groupBy("route").agg(*[at(p).alias(f"p{p}") for p in (50, 95, 99)])
    found = routes.join(marks, "route", "left").crossJoin(F.broadcast(span))
    return found.select("route", "requests", "errors", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99", "mean")], F.round(F.col("requests") / F.col("span"), 9).alias("rate"))


def error_summary(errors: DataFrame, source: str | None = None, severity: str | None = None) -> DataFrame:
    """dimension (type, severity or total), value, count of errors (type, source, severity), filtered where asked.

    Null types and severities are ``unknown``. Without errors the total alone is there, at 0.
    """
    rows = errors
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    rows = rows.select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("type", "severity")])
    sums = rows.groupingSets([["type"], ["severity"]], "type", "severity").agg(F.count("*").alias("count"), F.grouping("type").alias("no_type"))
    by_value = sums.select(F.when(F.col("no_type") == 0, "type").otherwise("severity").alias("dimension"), F.coalesce("type", "severity").alias("value"), "count")
    return by_value.unionByName(rows.agg(F.count("*").alias("count")).select(F.lit("total").alias("dimension"), F.lit("all").alias("value"), "count"))
