"""Communities against a sequential run, on graphs whose communities are known."""

import random

import pytest

from weftline.operators import communities


def quality(pairs, of, gamma=1.0):
    total = 2 * sum(w for *_, w in pairs)
    degree, inside = {}, 0.0
    for a, b, w in pairs:
        for x in (a, b):
            degree[of[x]] = degree.get(of[x], 0.0) + w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - gamma * sum(d * d for d in degree.values()) / total**2


def sequential(pairs, gamma=1.0):
    """Local moves node by node, then contraction, until nothing joins."""
    graph = {}
    for a, b, w in pairs:
        graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0.0) + w
        graph.setdefault(b, {})[a] = graph.setdefault(b, {}).get(a, 0.0) + w
    of, loops = {x: x for x in graph}, {x: 0.0 for x in graph}
    total = sum(sum(v.values()) for v in graph.values())
    while True:
        own = {x: x for x in graph}
        degree = {x: sum(v.values()) + loops[x] for x, v in graph.items()}
        sums, moved, any_moved = dict(degree), True, False
        while moved:
            moved = False
            for x in sorted(graph):
                sums[own[x]] -= degree[x]
                ties = {own[x]: 0.0}
                for y, w in graph[x].items():
                    ties[own[y]] = ties.get(own[y], 0.0) + w
                best = max(sorted(ties), key=lambda c: ties[c] - gamma * degree[x] * sums[c] / total + (1e-12 if c == own[x] else 0))
                if best != own[x]:
                    own[x], moved, any_moved = best, True, True
                sums[best] += degree[x]
        if not any_moved:
            return of
        of = {x: own[c] for x, c in of.items()}
        fresh, inner = {c: {} for c in set(own.values())}, {c: 0.0 for c in set(own.values())}
        for x, v in graph.items():
            inner[own[x]] += loops[x]
            for y, w in v.items():
                if own[x] == own[y]:
                    inner[own[x]] += w
                else:
                    fresh[own[x]][own[y]] = fresh[own[x]].get(own[y], 0.0) + w
        graph, loops = fresh, inner


def ring(cliques, size):
    pairs = [(f"c{k:02}_{i}", f"c{k:02}_{j}", 1.0) for k in range(cliques) for i in range(size) for j in range(i + 1, size)]
    return pairs + [(f"c{k:02}_0", f"c{(k + 1) % cliques:02}_1", 1.0) for k in range(cliques)]


def planted(blocks, size, inner, outer):
    rnd = random.Random(3)
    names = [f"b{k}_{i:02}" for k in range(blocks) for i in range(size)]
    return [(a, b, round(rnd.uniform(0.5, 1), 3)) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < (inner if a[:2] == b[:2] else outer)]


GRAPHS = {"ring": ring(30, 5), "path": [(f"n{k:03}", f"n{k + 1:03}", 1.0) for k in range(200)], "planted": planted(6, 20, 0.5, 0.02)}


@pytest.mark.parametrize("name", GRAPHS)
def test_modularity_of_a_sequential_run(spark, name):
    pairs = GRAPHS[name]
    nodes = spark.createDataFrame([(x,) for x in {x for a, b, _ in pairs for x in (a, b)} | {"alone"}], "node string")
    df = spark.createDataFrame(pairs, "a string, b string, sim double")
    rows = communities.louvain(nodes, df, (0.5, 1.0, 3.0)).collect()
    shown = {r.r: r.modularity for r in communities.modularities(df, spark.createDataFrame(rows)).collect()}
    for gamma in (0.5, 1.0, 3.0):
        of = {r.node: r.cluster for r in rows if r.r == gamma}
        assert len(of) == nodes.count() and of["alone"] == "alone"
        assert quality(pairs, of, gamma) >= 0.99 * quality(pairs, sequential(pairs, gamma), gamma)
        assert shown[gamma] == pytest.approx(quality(pairs, of), abs=1e-6)
        for c in set(of.values()):
            assert c == min(x for x in of if of[x] == c)
    if name == "planted":
        of = {r.node: r.cluster for r in rows if r.r == 1.0}
        assert len({of[x] for x in of if x != "alone"}) == 6 and all(of[x][:2] == x[:2] for x in of)


def test_sweep_auto_and_scales(spark):
    pairs = ring(12, 4) + [("c00_0", "z", 0.2)]
    nodes = spark.createDataFrame([(x,) for x in {x for a, b, _ in pairs for x in (a, b)} | {"alone"}], "node string")
    df = spark.createDataFrame(pairs, "a string, b string, sim double")
    sweep = {r.resolution: r for r in communities.resolution_sweep(nodes, df, (0.1, 1.0, 5.0)).collect()}
    assert sweep[0.1].communities <= sweep[1.0].communities <= sweep[5.0].communities and sweep[0.1].smallest == 1
    auto = communities.louvain_auto(nodes, df, (0.01, 1.0, 2.0), least=8, most=20).collect()
    of = {r.node: r.cluster for r in auto}
    assert {r.resolution for r in auto} == {1.0} and of["z"] == of["c00_0"] and of["alone"] == "alone"
    scales = communities.communities(nodes, df).collect()
    assert {r.scale for r in scales} == {"macro", "meso", "micro"} and len(scales) == 3 * len(of)


def test_singletons_follow_their_strongest_neighbour(spark):
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "f"), ("g", "g")], "node string, cluster string")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.2), ("c", "d", 0.9), ("e", "f", 0.5)], "a string, b string, sim double")
    of = {r.node: r.cluster for r in communities.merge_singletons(labels, pairs).collect()}
    assert of["c"] == of["d"] and of["e"] == of["f"] != of["a"] and of["g"] == "g"
    alone = communities.louvain(labels.select("node"), pairs.limit(0)).collect()
    assert all(r.node == r.cluster for r in alone) and len(alone) == 7
