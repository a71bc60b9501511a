"""Latency by route and summaries of errors, against plain loops; nulls and empty tables."""

import datetime as dt
import math
import random

from weftline.operators import requests


def test_latency_equals_plain_ranks(spark):
    draw, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(draw.choice(["a", "b", None]), t0 + dt.timedelta(seconds=k), draw.choice([1.0, 2.0, 5.0, draw.random()]), draw.choice([200, 404, 500, None])) for k in range(400)]
    rows += [("quiet", t0, None, 200)]
    found = {r.route: r for r in requests.route_latency(spark.createDataFrame(rows, "route string, ts timestamp, ms double, status int")).collect()}
    assert set(found) == {"a", "b", "unknown", "quiet"}
    for route in found:
        mine = [r for r in rows if (r[0] or "unknown") == route]
        times = sorted(r[2] for r in mine if r[2] is not None)
        got = found[route]
        assert (got.requests, got.errors) == (len(mine), sum((r[3] or 0) >= 400 for r in mine))
        for p in (50, 95, 99):
            assert got[f"p{p}"] == (times[math.ceil(p * len(times) / 100) - 1] if times else 0.0)
        assert abs(got.rate - len(mine) / 399) < 1e-8


def test_latency_of_nothing(spark):
    assert requests.route_latency(spark.createDataFrame([], "route string, ts timestamp, ms double, status int")).count() == 0


def test_error_counts_by_type_and_severity(spark):
    rows = [("E1", "backend", "error"), ("E1", "frontend", "error"), ("E2", "backend", None), (None, "backend", "critical"), ("E1", "backend", "critical")]
    df = spark.createDataFrame(rows, "type string, source string, severity string")
    of = lambda **by: {(r.dimension, r.value): r["count"] for r in requests.error_summary(df, **by).collect()}
    assert of() == {("type", "E1"): 3, ("type", "E2"): 1, ("type", "unknown"): 1, ("severity", "error"): 2, ("severity", "unknown"): 1, ("severity", "critical"): 2, ("total", "all"): 5}
    assert of(source="backend", severity="critical") == {("type", "unknown"): 1, ("type", "E1"): 1, ("severity", "critical"): 2, ("total", "all"): 2}
    assert of(source="nobody") == {("total", "all"): 0}
