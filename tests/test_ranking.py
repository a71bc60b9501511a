"""Positions and norms against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import ranking, score


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(5), rnd.randrange(1, 4)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, v int, w int").repartition(5)
    got = {r.id: r for r in ranking.positions(df, [F.desc("v"), F.asc("id")], "at").collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [got[r[0]]["at"] for r in want] == list(range(300))
    sums, total = {}, 0
    for r in want:
        sums[r[0]] = total
        total += r[2]
    assert {r.id: r["at"] for r in ranking.positions(df, [F.desc("v"), F.asc("id")], "at", "w").collect()} == sums
    assert ranking.positions(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("values", [[5.0], [0.0, 0.0, 3.0], [1.0, 2.0, 2.0, 4.0, -1.0, 0.0], [0.0]])
def test_percentile_norm(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    n = len(values)
    place = lambda v, all_: sum(x < v for x in all_) + (sum(x == v for x in all_) - 1) / 2
    assert [r.norm for r in score.percentile_norm(df, "v").orderBy("id").collect()] == pytest.approx([50.0 if n == 1 else 100 * place(v, values) / (n - 1) for v in values])
    up = [v for v in values if v > 0]
    want = [0.0 if v <= 0 else 50.0 if len(up) == 1 else max(1.0, 100 * place(v, up) / (len(up) - 1)) for v in values]
    assert [r.norm for r in score.percentile_norm(df, "v", zero_floor=True).orderBy("id").collect()] == pytest.approx(want)
