"""Waves, betweenness and chains against plain searches."""

import random
from collections import deque

import pytest

from weftline.operators import centrality

CYCLIC = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "d"), ("e", "e"), ("f", "e"), ("a", "b")]


def tangle(n, m, seed, acyclic=True):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    return sorted({(f"n{min(p):02}", f"n{max(p):02}") if acyclic else (f"n{p[0]:02}", f"n{p[1]:02}") for p in pairs if p[0] != p[1]})


def plain_wave(edges, start, mass, cut=0.01):
    """Level by level; of several parents on shortest ways the strongest counts."""
    found, front, hop, passed = {start: (0, 1.0)}, {start: 1.0}, 0, 0
    while front:
        hop += 1
        fresh = {}
        for a, b in set(edges):
            if a != b and front.get(a, 0) > cut and b not in found:
                fresh[b] = max(fresh.get(b, 0), front[a] * 0.7 * mass.get(b, 1.0))
        found |= {b: (hop, amp) for b, amp in fresh.items()}
        passed = hop if any(amp > cut for amp in fresh.values()) else passed
        front = fresh
    return found, passed


def frames(spark, edges, extra=("zz",)):
    nodes = sorted({x for e in edges for x in e} | set(extra))
    return spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in nodes], "node string"), nodes


@pytest.mark.parametrize("edges", [CYCLIC, tangle(25, 60, 1), [(f"k{k:02}", f"k{k + 1:02}") for k in range(20)]])
@pytest.mark.parametrize("heavy", [False, True])
def test_criticality(spark, edges, heavy):
    df, nodes, names = frames(spark, edges)
    mass = {x: 1.0 + k % 3 / 2 for k, x in enumerate(names)} if heavy else {}
    masses = spark.createDataFrame(list(mass.items()), "node string, mass double") if heavy else None
    got = {r.node: r for r in centrality.criticality(df, nodes, masses, exact=True).collect()}
    n, most = len(names), max(mass.values(), default=1.0)
    for x in names:
        (there, d0), (back, d1) = plain_wave(edges, x, mass), plain_wave([(b, a) for a, b in edges], x, mass)
        reach, depth = len(there) + len(back) - 2, max(d0, d1)
        direct = len({e for e in edges if x in e and e[0] != e[1]})
        raw = 100 * (0.4 * reach / n + 0.3 * depth / n + 0.3 * mass.get(x, 1.0) / most)
        assert (got[x].reach, got[x].depth) == (reach, depth)
        assert got[x].score == pytest.approx(min(100, raw), abs=1e-3) and got[x].amplification == pytest.approx(reach / max(direct, 1), abs=1e-3)
        assert got[x].tier == (5 if raw >= 80 else int(raw // 20) + 1)
    if not heavy:  # small sets are exact in sketches, too
        assert {r.node: (r.reach, r.depth, r.score) for r in centrality.criticality(df, nodes).collect()} == {x: (r.reach, r.depth, r.score) for x, r in got.items()}


def test_curves(spark):
    edges = tangle(25, 60, 1)
    df, nodes, names = frames(spark, edges)
    found = centrality.criticality(df, nodes, exact=True)
    reach = {r.node: r.reach for r in found.collect()}
    top = sorted((x for x in names if reach[x] > 0.3 * len(names)), key=lambda x: (-reach[x], x))[:5]
    want = set()
    for x in top:
        hops, total = {}, 0
        for hop, amp in plain_wave(edges, x, {})[0].values():
            hops.setdefault(hop, []).append(amp)
        for hop in sorted(hops):
            total += len(hops[hop])
            want.add((x, hop, round(max(hops[hop]), 4), len(hops[hop]), total))
    assert {(r.node, r.hop, r.amplitude, r.nodes, r.cumulative) for r in centrality.amplitude_curve(df, found, share=0.3, n=5).collect()} == want


def plain_betweenness(edges, names):
    out = dict.fromkeys(names, 0.0)
    to = {x: sorted({b for a, b in edges if a == x and b != x}) for x in names}
    for s in names:
        ways, dist, order, parents, queue = {s: 1.0}, {s: 0}, [], {x: [] for x in names}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in to[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    parents[w].append(v)
        part = dict.fromkeys(names, 0.0)
        for w in reversed(order):
            for v in parents[w]:
                part[v] += ways[v] / ways[w] * (1 + part[w])
            if w != s:
                out[w] += part[w]
    n = len(names)
    return {x: v / ((n - 1) * (n - 2)) for x, v in out.items()}


@pytest.mark.parametrize("edges", [CYCLIC, tangle(20, 50, 2, False), [("a", "b")]])
def test_betweenness(spark, edges):
    df, nodes, names = frames(spark, edges)
    got = {r.node: r.value for r in centrality.betweenness(df, nodes).collect()}
    assert got == pytest.approx(plain_betweenness(edges, names))
    some = centrality.betweenness(df, nodes, pivots=len(names)).collect()
    assert {r.node: r.value for r in some} == pytest.approx(got)
    assert centrality.betweenness(df, nodes, pivots=2).count() == len(names)


def test_composite(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    x = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "node string, x double")
    y = spark.createDataFrame([("a", 7)], "node string, y int")
    z = spark.createDataFrame([("a", 4.0), ("b", 4.0), ("c", 4.0)], "node string, z double")
    got = {r.node: r.score for r in centrality.composite_centrality([(x, "x", 0.5), (y, "y", 0.3), (z, "z", 0.2)], nodes).collect()}
    assert got == {"a": 0.4, "b": 0.6, "c": 0.35}


def plain_chains(edges, n, roots, shortest, longest):
    to, into = {}, {b for _, b in edges}
    for a, b in sorted(set(edges)):
        to.setdefault(a, []).append(b)
    found = []

    def walk(path):
        if len(path) > longest:
            return
        if path[-1] not in to:
            found.append(path)
        for b in to.get(path[-1], []):
            walk([*path, b])

    for r in sorted(set(to) - into)[:roots]:
        walk([r])
    return sorted((p for p in found if len(p) >= shortest), key=lambda p: (-len(p), p))[:n]


@pytest.mark.parametrize("n, roots, shortest, longest", [(200, 100, 3, 50), (7, 100, 3, 50), (20, 2, 2, 5), (5, 100, 4, 6), (3, 100, 3, 4)])
def test_longest_chains(spark, n, roots, shortest, longest):
    edges = tangle(22, 45, 4)
    df, *_ = frames(spark, edges)
    got = [r.path for r in centrality.longest_chains(df, n, roots, shortest, longest).orderBy("chain_id").collect()]
    assert got == plain_chains(edges, n, roots, shortest, longest)


def test_chain_documents(spark):
    chains = spark.createDataFrame([(1, ["a", "b", "q"], 3)], "chain_id long, path array<string>, length long")
    sessions = spark.createDataFrame([("a", 1, list("stuvwx"), ["t1"]), ("b", 2, [], ["t2", "t3"])], "sid string, tier long, sources array<string>, targets array<string>")
    text = centrality.chain_documents(chains, sessions).first().text
    assert text == "DEPENDENCY CHAIN (3 sessions):\nPath: a -> b -> q\n\nSteps:\n  Step 1: a - reads s, t, u, v, w, writes t1\n  Step 2: b - reads , writes t2, t3\n  Step 3: q\n\nThis chain represents a complete data flow spanning 3 processing steps.\nTier range: 1 -> 0\n"


def test_empty(spark):
    df = spark.createDataFrame([], "src string, dst string")
    none = spark.createDataFrame([], "node string")
    one = spark.createDataFrame([("a",)], "node string")
    assert centrality.criticality(df, none).count() == 0 and centrality.betweenness(df, none).count() == 0 and centrality.longest_chains(df).count() == 0
    r = centrality.criticality(df, one).first()
    assert (r.reach, r.depth, r.score, r.tier) == (0, 0, 30.0, 2) and centrality.betweenness(df, one).first().value == 0.0
