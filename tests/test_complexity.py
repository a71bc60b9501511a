"""Complexity over sixteen dimensions and couplings, against plain loops."""

import random

from weftline.operators import compare, features, score, usage


def plain_norms(values, floored):
    if len(values) == 1:
        return [50.0]
    kept = [v for v in values if v > 0] if floored else values
    out = []
    for v in values:
        if floored and v <= 0:
            out.append(0.0)
        elif len(kept) == 1:
            out.append(50.0)
        else:
            mean = sum(x < v for x in kept) + (sum(x == v for x in kept) - 1) / 2
            place = 100.0 * mean / (len(kept) - 1)
            out.append(max(1.0, place) if floored else place)
    return out


def plain_scores(rows):
    norms = {d: plain_norms([r[d] or 0.0 for r in rows], d not in score.RANKED_ZEROS) for d in score.COMPLEXITY}
    out = {}
    for k, r in enumerate(rows):
        shares = {d: norms[d][k] * w for d, w in score.COMPLEXITY.items()}
        out[r["sid"]] = sum(shares.values()), {d: norms[d][k] for d in norms}, shares
    return out


def check(spark, rows):
    kinds = "sid string, " + ", ".join(f"{d} double" for d in score.COMPLEXITY)
    df = spark.createDataFrame([tuple([r["sid"], *[r[d] for d in score.COMPLEXITY]]) for r in rows], kinds)
    found = {x.sid: x for x in score.complexity_score(df).collect()}
    want = plain_scores(rows)
    assert set(found) == set(want)
    for sid, (total, norms, shares) in want.items():
        got = found[sid]
        assert abs(got.score - total) < 0.006
        for d in score.COMPLEXITY:
            assert abs(got[f"norm_{d}"] - norms[d]) < 1e-5
        best = [round(shares[d], 6) for d in got.top_drivers.split(",")]
        assert best == sorted((round(v, 6) for v in shares.values()), reverse=True)[:3]
    return found


def test_weights_sum_to_one():
    assert abs(sum(score.COMPLEXITY.values()) - 1) < 1e-9 and len(score.COMPLEXITY) == 16


def test_scores_equal_plain_norms(spark):
    draw = random.Random(5)
    rows = [{"sid": f"S{k}"} | {d: float(draw.choice([0, 0, 1, 2, 3, 7.5])) for d in score.COMPLEXITY} for k in range(60)]
    check(spark, rows)


def test_one_session_all_zeros_nulls_and_no_rows(spark):
    zero = {"sid": "S1"} | dict.fromkeys(score.COMPLEXITY, 0.0)
    assert check(spark, [zero])["S1"].score == 50.0
    check(spark, [zero, zero | {"sid": "S2"}, zero | {"sid": "S3", "risk": None, "coupling": 4.0}])
    kinds = "sid string, " + ", ".join(f"{d} double" for d in score.COMPLEXITY)
    assert score.complexity_score(spark.createDataFrame([], kinds)).count() == 0


def test_inputs_of_features(spark):
    row = dict.fromkeys(features.NAMES, 0.0) | {"transform_count": 4.0, "field_count": 10.0, "write_conflict_count": 2.0, "staleness_risk": 1.0, "filter_count": 3.0, "router_group_count": 2.0, "source_table_count": 1.0, "target_table_count": 2.0, "lookup_table_count": 3.0}
    df = spark.createDataFrame([("S1", *[row[c] for c in features.NAMES])], ["sid", *features.NAMES])
    got = score.complexity_inputs(df, spark.createDataFrame([("S1", 9)], "sid string, coupled long")).first()
    assert (got.field_mapping_density, got.risk, got.error_handling, got.io_volume, got.coupling) == (2.5, 3.0, 5.0, 6.0, 9.0)


def test_coupling_with_hot_tables_equals_plain_sets(spark):
    draw = random.Random(11)
    rows = {(f"S{k}", "source", t) for k in range(80) for t in draw.sample(["hot1", "hot2", "hot3"] * (k % 3 == 0) + [f"T{x}" for x in range(50)], 3)}
    access = spark.createDataFrame(sorted(rows | {("S99", "target", "alone")}), "sid string, role string, tname string")
    held = {}
    for sid, _, t in rows | {("S99", "target", "alone")}:
        held.setdefault(sid, set()).add(t)
    want = {a: sum(a != b and bool(held[a] & held[b]) for b in held) for a in held}
    for bound in (0, 2, 5, 500):
        assert {x.sid: x.coupled for x in usage.coupling_counts(access, bound).collect()} == want


def test_snapshots_differ_by_fields_and_lists(spark):
    kinds = "full_name string, n int, flag boolean, sources array<string>"
    a = spark.createDataFrame([("x", 1, True, ["T1", "T2"]), ("y", None, False, None), ("gone", 1, True, []), ("same", 2, None, ["T"])], kinds)
    b = spark.createDataFrame([("x", 2, True, ["T2", "T3", "T0"]), ("y", 5, False, []), ("new", 1, True, []), ("same", 2, None, ["T"])], kinds)
    found = {r.full_name: (r.status, r.changes) for r in compare.compare_sessions(a, b, ["n", "flag"], ["sources"]).collect()}
    assert found == {"x": ("matched", "n:1>2,sources:+T0;T3-T1"), "y": ("matched", "n:null>5"), "gone": ("removed", ""), "new": ("added", ""), "same": ("matched", "")}
    assert compare.compare_sessions(a.limit(0), b.limit(0), ["n"], ["sources"]).count() == 0
