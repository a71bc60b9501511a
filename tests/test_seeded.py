"""Seeded communities, label votes, k-means for all k, gravity groups: planted groups, plain loops, edge cases."""

import random

import numpy as np

from weftline.operators import seeded

PAIRS = "a string, b string, sim double"


def cliques(n, size, bridges=True):
    names = [[f"c{k}_{i}" for i in range(size)] for k in range(n)]
    rows = [(x, y, 1.0) for c in names for i, x in enumerate(c) for y in c[i + 1:]]
    if bridges:
        rows += [(names[k][0], names[k + 1][0], 0.1) for k in range(n - 1)]
    return names, rows


def frames(spark, nodes, rows):
    return spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(rows, PAIRS)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.node)
    assert all(min(v) == k for k, v in out.items())
    return sorted(map(sorted, out.values()))


def test_votes_find_cliques_and_leave_lone_nodes(spark):
    names, rows = cliques(4, 6)
    nodes, pairs = frames(spark, sum(names, []) + ["alone"], rows)
    found = groups(seeded.seeded_label_vote(nodes, pairs))
    assert found == sorted([sorted(c) for c in names] + [["alone"]])
    again = groups(seeded.seeded_label_vote(nodes.repartition(3), pairs.repartition(5)))
    assert again == found


def test_votes_without_pairs_or_nodes(spark):
    nodes, pairs = frames(spark, ["x", "y"], [])
    assert groups(seeded.seeded_label_vote(nodes, pairs)) == [["x"], ["y"]]
    assert seeded.seeded_label_vote(nodes.limit(0), pairs).count() == 0


def test_k_seeds_share_out_the_largest_component(spark):
    names, rows = cliques(3, 6)
    small = [("z1", "z2", 1.0)]
    nodes, pairs = frames(spark, sum(names, []) + ["z1", "z2", "alone"], rows + small)
    found = groups(seeded.seeded_k_communities(nodes, pairs, k=3))
    assert ["alone"] in found and ["z1", "z2"] in found
    inside = [g for g in found if g[0].startswith("c")]
    assert sum(map(len, inside)) == 18 and len(inside) == 3
    # the seeds are the ends of bridges, one in each clique
    assert inside == sorted(sorted(c) for c in names)
    whole = groups(seeded.seeded_k_communities(nodes, pairs, k=1))
    assert sorted(sum(names, [])) in whole


def test_k_seeds_without_pairs_or_nodes(spark):
    nodes, pairs = frames(spark, ["x", "y"], [])
    assert groups(seeded.seeded_k_communities(nodes, pairs)) == [["x"], ["y"]]
    assert seeded.seeded_k_communities(nodes.limit(0), pairs).count() == 0


def lloyd(x, c):
    for _ in range(40):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        new = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        cost = d.min(1).sum()
        if np.abs(new - c).max() <= 1e-6:
            break
        c = new
    return cost, ((x[:, None] - new[None]) ** 2).sum(2).argmin(1)


def test_elbow_equals_plain_loops(spark):
    draw = random.Random(4)
    middles = [(0, 0), (10, 0), (0, 10), (10, 10), (30, 30)]
    rows = [(k, [draw.gauss(m[0], 0.4), draw.gauss(m[1], 0.4), 3.0]) for k, m in enumerate(middles * 24)]
    df = spark.createDataFrame([*rows, (900, None), (901, [1.0, None, 3.0]), (902, [float("nan"), 1.0, 3.0]), (903, [1.0])], "id long, x array<double>")
    found = {r.id: r for r in seeded.kmeans_elbow(df).collect()}
    assert set(found) == {k for k, _ in rows}
    x = np.array([r[1] for r in rows])
    lo, hi = x.min(0), x.max(0)
    x = np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0.5)
    order = [r.id for r in spark.createDataFrame(rows, "id long, x array<double>").orderBy(seeded.chance(seeded.F.col("id").cast("string")), "id").collect()]
    start = seeded._start(x[order], 7)
    runs = {k: lloyd(x, start[:k].copy()) for k in range(2, len(start) + 1)}
    drops = {k: runs[k - 1][0] - runs[k][0] for k in range(3, len(start) + 1)}
    k = max(drops, key=drops.get)
    assert {r.k for r in found.values()} == {k}
    assert [found[i].cluster for i in range(len(rows))] == list(runs[k][1])


def test_elbow_of_few_equal_or_no_points(spark):
    kinds = "id long, x array<double>"
    one = seeded.kmeans_elbow(spark.createDataFrame([(1, [2.0, 3.0])], kinds)).collect()
    assert [(r.id, r.cluster, r.k) for r in one] == [(1, 0, 1)]
    same = seeded.kmeans_elbow(spark.createDataFrame([(k, [2.0]) for k in range(9)], kinds)).collect()
    assert {(r.cluster, r.k) for r in same} == {(0, 1)} and len(same) == 9
    assert seeded.kmeans_elbow(spark.createDataFrame([], kinds)).count() == 0


def test_gravity_groups_leave_out_independents(spark):
    rows = [(f"S{g}{i}", "source", f"T{g}_{t}") for g in range(3) for i in range(6) for t in range(4)] + [("S99", "source", "own")]
    access = spark.createDataFrame(rows, "sid string, role string, tname string")
    found = seeded.gravity_groups(access, spark.createDataFrame([("S99",)], "sid string")).collect()
    assert {r.sid for r in found} == {r[0] for r in rows} - {"S99"} and {r.k for r in found} == {3}
    assert all(r.cluster[1] == r.sid[1] for r in found)
