"""Clusters by messages, eigenvectors, walks, ranks, forests and bisection, against dense loops and on graphs with known parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import partitions


def blocks(sizes, inner=1.0, outer=0.05, seed=1):
    rnd = random.Random(seed)
    names = [f"{'pqrstuv'[k]}{i:02}" for k, n in enumerate(sizes) for i in range(n)]
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a[0] == b[0] and rnd.random() < 0.8:
                pairs.append((a, b, round(inner * rnd.uniform(0.7, 1), 4)))
            elif a[0] != b[0] and rnd.random() < 0.06:
                pairs.append((a, b, outer))
    return names, pairs


def frames(spark, names, pairs):
    return spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(pairs, "a string, b string, sim double")


def parts(df):
    of = {}
    for r in df.collect():
        of.setdefault(r.cluster, set()).add(r.node)
    return {frozenset(v) for v in of.values()}


def known(names):
    return {frozenset(n for n in names if n[0] == c) for c in {n[0] for n in names}}


def matrix(names, pairs):
    at, w = {n: k for k, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for a, b, s in pairs:
        w[at[a], at[b]] = w[at[b], at[a]] = s
    return w


def plain_exemplars(names, pairs, preference, damping, rounds, settled):
    s = matrix(names, pairs)
    s[s == 0] = -np.inf
    np.fill_diagonal(s, preference)
    n = len(names)
    r, a, chosen, quiet = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n, bool), 0
    linked = np.isfinite(s)
    for _ in range(rounds):
        v = np.where(linked, a + s, -np.inf)
        for i in range(n):
            for k in range(n):
                if linked[i, k]:
                    rest = max((v[i, j] for j in range(n) if j != k and linked[i, j]), default=0.0)
                    r[i, k] = damping * r[i, k] + (1 - damping) * (s[i, k] - rest)
        glad = np.where(linked, np.maximum(r, 0), 0)
        sums = glad.sum(0) - glad.diagonal()
        for i in range(n):
            for k in range(n):
                if linked[i, k]:
                    offer = sums[k] if i == k else min(0.0, r[k, k] + sums[k] - glad[i, k])
                    a[i, k] = damping * a[i, k] + (1 - damping) * offer
        now = (r + a).diagonal() > 0
        quiet = quiet + 1 if (now == chosen).all() else 0
        chosen = now
        if quiet >= settled:
            break
    out = {}
    for i in range(n):
        best = [k for k in range(n) if chosen[k] and linked[i, k] and k != i]
        out[names[i]] = names[i] if chosen[i] or not best else names[max(best, key=lambda k: s[i, k])]
    return out


def test_exemplars(spark):
    names, pairs = blocks([6, 5, 4])
    nodes, df = frames(spark, [*names, "z"], pairs)
    got = {r.node: r.cluster for r in partitions.exemplar_clusters(nodes, df, preference=0.3, noise=0.0).collect()}
    assert got == plain_exemplars(names, pairs, 0.3, 0.5, 50, 5) | {"z": "z"}
    assert {frozenset(n for n in names if got[n] == c) for c in {got[n] for n in names}} == known(names)
    assert partitions.exemplar_clusters(nodes, df).count() == 16 and parts(partitions.exemplar_clusters(nodes, df.limit(0))) == {frozenset([n]) for n in [*names, "z"]}


def test_spectral_blocks_and_moons(spark):
    names, pairs = blocks([12, 9, 7])
    nodes, df = frames(spark, [*names, "z"], pairs)
    assert parts(partitions.spectral_clusters(nodes, df, k_max=6)) == known(names) | {frozenset("z")}
    links = partitions._links(df)
    vectors, values = partitions.leading_vectors(links, 8, 25, 1e-9)
    w = matrix(names, pairs)
    d = w.sum(1)
    true = np.linalg.eigvalsh((np.eye(len(names)) + w / np.sqrt(np.outer(d, d))) / 2)[::-1][:3]
    assert values[:3] == pytest.approx(true, abs=1e-4)
    rnd, points = random.Random(2), []
    for k in range(40):
        t = math.pi * k / 39
        points += [(f"p{k:02}", math.cos(t) + rnd.gauss(0, 0.02), math.sin(t)), (f"q{k:02}", 1 - math.cos(t), 0.5 - math.sin(t) + rnd.gauss(0, 0.02))]
    near = {tuple(sorted((n, m))) for n, x, y in points for m, *_ in sorted(((m, (x - u) ** 2 + (y - v) ** 2) for m, u, v in points if m != n), key=lambda r: r[1])[:4]}
    moon_nodes, moon = frames(spark, [n for n, *_ in points], [(a, b, 1.0) for a, b in near])
    assert parts(partitions.spectral_clusters(moon_nodes, moon, k=2, rounds=40)) == known([n for n, *_ in points])
    assert parts(partitions.spectral_clusters(nodes, df.limit(0))) == {frozenset([n]) for n in [*names, "z"]}


def test_personal_ranks(spark):
    names, pairs = blocks([6, 5, 4])
    nodes, df = frames(spark, [*names, "z"], pairs)
    w = matrix(names, pairs)
    step = w / w.sum(1, keepdims=True)
    exact = 0.15 * np.linalg.inv(np.eye(len(names)) - 0.85 * step)
    epsilon = 1e-3
    got = np.zeros_like(exact)
    for r in partitions.personal_ranks(partitions._links(df), nodes, 0.85, epsilon).collect():
        got[names.index(r.landmark), names.index(r.node)] = r["rank"]
    assert (got <= exact + 1e-9).all() and (exact - got <= epsilon * w.sum(1)[None, :] + 1e-9).all()
    assert parts(partitions.ppr_clusters(nodes, df, k=3)) == known(names) | {frozenset("z")}
    assert partitions.ppr_clusters(nodes, df.limit(0)).count() == 16


def test_walks(spark):
    names, pairs = blocks([7, 6], outer=0.01)
    nodes, df = frames(spark, [*names, "z"], pairs)
    walks = [sorted(tuple(r) for r in partitions.random_walks(partitions._links(d), 4, 6).collect()) for d in (df, df.repartition(5))]
    assert walks[0] == walks[1] and len(walks[0]) == 13 * 4 * 6
    linked = {(a, b) for a, b, _ in pairs} | {(b, a) for a, b, _ in pairs}
    steps = {(r[0], r[1], r[2]): r[3] for r in walks[0]}
    assert all((steps[s, w, k - 1], n) in linked for (s, w, k), n in steps.items() if k)
    found = partitions.walk_embeddings(nodes, df, dims=4, k=2)
    assert parts(found) == known(names) | {frozenset("z")}
    assert {len(r.vector) for r in found.where("node <> 'z'").collect()} == {4} and found.where("node = 'z'").first().vector is None


def test_walk_probabilities(spark):
    names, pairs = blocks([5, 4])
    nodes, df = frames(spark, [*names, "z"], pairs)
    w = matrix(names, pairs)
    exact = np.linalg.matrix_power(w / w.sum(1, keepdims=True), 4)
    got = np.zeros_like(exact)
    for r in partitions.walk_probabilities(partitions._links(df), 4, 0.0).collect():
        got[names.index(r.node), names.index(r.to)] = r.p
    assert got == pytest.approx(exact) and got.sum(1) == pytest.approx(np.ones(len(names)))
    cut = partitions.walk_probabilities(partitions._links(df), 4, 0.01).groupBy("node").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    assert all(r.n <= 100 and 0.5 < r.p <= 1 + 1e-9 for r in cut)
    assert parts(partitions.walk_clusters(nodes, df, k=2)) == known(names) | {frozenset("z")}


def test_spanning_forest(spark):
    names, pairs = blocks([6, 5])
    pairs = [(a, b, round(w, 1)) for a, b, w in pairs] + [("y", "z", 0.5)]
    _, df = frames(spark, names, pairs)
    got = sorted((r.a, r.b, r.w) for r in partitions.spanning_forest(df.withColumnRenamed("sim", "w")).collect())
    root, want = {}, []

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b, w in sorted(pairs, key=lambda e: (-e[2], *sorted(e[:2]))):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((min(a, b), max(a, b), w))
    assert got == sorted(want)


def plain_consensus(labelings, k):
    """Cut of a heaviest spanning forest on all pairs; scores by all pairs."""
    sids = sorted({s for x in labelings for s in x})
    share = lambda a, b: sum(a in x and b in x and x[a] == x[b] for x in labelings) / len(labelings)
    edges = sorted(((a, b, share(a, b)) for i, a in enumerate(sids) for b in sids[i + 1 :] if share(a, b) > 0), key=lambda e: -e[2])
    levels = sorted({e[2] for e in edges})
    by_level = {}
    for least in [*levels, 2.0]:
        of = {s: s for s in sids}
        for a, b, w in edges:
            if w >= least and of[a] != of[b]:
                x, y = sorted((of[a], of[b]))
                of = {s: x if c == y else c for s, c in of.items()}
        by_level[least] = of
    return share, by_level


def test_consensus(spark):
    one = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2, "g": 3, "h": 3}
    two = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 3, "g": 3, "h": 3}
    three = {"a": 1, "b": 1, "c": 2, "d": 2, "e": 2, "f": 2, "g": 3}
    labelings = [one, two, three]
    df = [spark.createDataFrame(list(x.items()), "sid string, cluster int") for x in labelings]
    got = {r.sid: r for r in partitions.consensus_clusters(df).collect()}
    share, by_level = plain_consensus(labelings, 3)
    groups = {frozenset(s for s in got if got[s].cluster == c) for c in {r.cluster for r in got.values()}}
    assert groups == {frozenset("abc"), frozenset("def"), frozenset("gh")}
    for level, of in by_level.items():  # a cut of the forest never splits what one step higher joins
        want = {frozenset(s for s in of if of[s] == c) for c in set(of.values())}
        if level <= 1 and len(want) > 1:  # equal profiles never part
            again = partitions.consensus_clusters(df, k=len(want)).collect()
            assert {frozenset(r.sid for r in again if r.cluster == c) for c in {r.cluster for r in again}} == want, level
    for s, r in got.items():
        others = [x for x in got if x != s and got[x].cluster == r.cluster]
        mean = sum(share(s, x) for x in others) / len(others) if others else 1.0
        assert r.score == pytest.approx(mean, abs=1e-6) and r.contested == (mean < 0.5) and r.confident == (mean > 0.8)


def tables(seed=3):
    rnd = random.Random(seed)
    return [(f"s{g}{i:02}", "source", f"t{g}_{rnd.randrange(5)}") for g in range(3) for i in range(10) for _ in range(4)] + [(f"s{g}00", "lookup", "shared") for g in range(3)]


def plain_silhouette(rows, of):
    vec = {}
    for s, t in {(s, t) for s, _, t in rows}:
        vec.setdefault(s, set()).add(t)
    far = lambda a, b: 2 - 2 * len(vec[a] & vec[b]) / math.sqrt(len(vec[a]) * len(vec[b]))
    total = 0.0
    for s in of:
        mean = {}
        for c in set(of.values()):
            rest = [x for x in of if of[x] == c and x != s]
            if rest:
                mean[c] = sum(far(s, x) for x in rest) / len(rest)
        if of[s] in mean:
            a, b = mean[of[s]], min(v for c, v in mean.items() if c != of[s])
            total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(of)


def test_hierarchical_domains(spark):
    rows = tables()
    access = spark.createDataFrame(rows, "sid string, role string, tname string")
    found = partitions.hierarchical_domains(access, 8).collect()
    of = {r.sid: r.cluster for r in found}
    assert {frozenset(s for s in of if of[s] == c) for c in set(of.values())} == {frozenset(s for s in of if s[1] == g) for g in "012"}
    assert found[0].k == 3 and found[0].silhouette == pytest.approx(plain_silhouette(rows, of), abs=1e-6)
    held = partitions._unit_rows(access.select("sid", "tname").distinct())
    rnd = random.Random(4)
    tries = {k: {s: rnd.randrange(k) for s in of} for k in (2, 3, 5)}
    labels = spark.createDataFrame([(k, s, str(c)) for k, x in tries.items() for s, c in x.items()], "k int, sid string, cluster string")
    got = {r.k: r.silhouette for r in partitions.silhouettes(held, labels).collect()}
    assert got == pytest.approx({k: plain_silhouette(rows, x) for k, x in tries.items()}, abs=1e-6)
    assert partitions.hierarchical_domains(access.limit(0)).count() == 0 and partitions.hierarchical_domains(access.limit(1)).count() == 1


def test_cluster_table_gravity(spark):
    rows = [(f"a{k}", "hub") for k in range(5)] + [(f"b{k}", "other") for k in range(4)] + [("a0", "x"), ("c0", "x"), ("d0", "lonely"), ("e0", "pair"), ("e1", "pair"), ("e0", "only"), ("b0", "only"), ("b1", "only"), ("f0", "f"), ("f1", "f")]
    access = spark.createDataFrame([(s, "source", t) for s, t in rows], "sid string, role string, tname string")
    sessions = spark.createDataFrame([(s,) for s in sorted({s for s, _ in rows} | {"n0"})], "sid string")
    got = {r.sid: r.cluster for r in partitions.cluster_table_gravity(access, sessions).collect()}
    assert {got[f"a{k}"] for k in range(5)} == {"hub"} and {got[f"b{k}"] for k in range(4)} == {"other"}
    assert got["d0"] == got["n0"] == "__other__" and got["f0"] == got["f1"] == "f" and got["c0"] == "hub"
    assert got["e0"] == "other" and got["e1"] == "pair"


def test_cluster_table_gravity_falls_back_to_the_first_twenty(spark):
    """No table is used by 0.5 % of the sessions: the first twenty that are used twice are anchors, as in the reference."""
    rows = [(f"a{t:02}{k}", f"t{t:02}") for t in range(25) for k in range(4)] + [("a030", "x"), ("a240", "x")]
    access = spark.createDataFrame([(s, "source", t) for s, t in rows], "sid string, role string, tname string")
    sessions = spark.createDataFrame([(s,) for s in sorted({s for s, _ in rows} | {f"n{k}" for k in range(900)})], "sid string")
    got = {r.sid: (r.cluster, r.anchor) for r in partitions.cluster_table_gravity(access, sessions).collect()}
    want = {s: (t, t) if t < "t20" else ("__other__", None) for s, t in rows if t != "x"} | {f"n{k}": ("__other__", None) for k in range(900)}
    assert got == want | {"a240": ("t03", "t03")}
    alone = partitions.cluster_table_gravity(access.where("sid like '%0' and tname <> 'x'"), sessions).collect()
    assert all(r.cluster == r.sid and r.anchor is None for r in alone) and len(alone) == len(got)
