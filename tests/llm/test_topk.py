"""Exact top-k against brute force."""

import math

from tests.llm.oracle import rows_of_frame, rows_of_sql
from weftline.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), c) for c, w in good if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, k=5, kind="float"):
    v = topk.integer_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string").repartition(3), 256)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(v.where("vec_id % 50 = 0"), v, k).collect())


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rows = [(k, [((k * 37 + j * 11) % 29 - 14) / 16 if (k + j) % 3 else 0.0 for j in range(6)]) for k in range(160)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (400, []), (450, [0.5]), (None, [1.0] * 6)]
    rows += [(500 + k, [1.0] * 6) for k in range(40)] + [(7, [0.9] * 6)] * 3
    assert run(spark, rows) == brute(rows, 5)


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.25]), (2, [0.5, 0.25])]
    assert run(spark, rows) == brute(rows, 5)


def test_large_components(spark):
    assert run(spark, [(0, [1e10]), (1, [1.0])], kind="double") == [(0, 1, 1, 655360000000000)]
    big = float(2**32)
    rows = [(0, [big, big, 1.0]), (50, [1e30, -1e30, 3.0]), (1, [big, -big, 2.0]), (2, [2.0**60, 2.0**60, 5.0]), (3, [-big, big / 2, 7.5]), (4, [1e300, 1e300, 0.5]), (5, [1e300, -1e300, 0.25]), (6, [1.0, 2.0, 3.0]), (7, [-1e30, 1e30, 2.0])]
    assert run(spark, rows, 4, "double") == brute(rows, 4)


def test_different_vectors_with_one_id(spark):
    rows = [(50, [3 / 256, 0.0]), (50, [0.0, 1 / 256]), (1, [1.0, 1.0]), (2, [0.5, 2.0]), (50, [3 / 256, 0.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_grid_of_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARE", 1)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "QUERY_ROWS", 1)
    rows = [(k, [((k * 31 + j * 7) % 17 - 8) / 8 for j in range(4)]) for k in range(0, 300, 5)]
    assert run(spark, rows) == brute(rows, 5)


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of_frame(topk.query(spark, sf)) == rows_of_sql(topk.ORACLE_SQL, sf)
