"""Graph operators on hand graphs: a two-cycle, a self-loop, an isolated node, a chain, an empty input."""

import pytest

from weftline.operators import graph

EDGES = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "e"), ("d", "f")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def test_components_and_tiers(spark, edges):
    groups = {r.node: (r.group, r.size, r.is_cycle, r.internal_edges) for r in graph.scc_groups(edges).collect()}
    assert groups == {"a": ("a", 2, True, 2), "b": ("a", 2, True, 2), "c": ("c", 1, False, 0), "d": ("d", 1, False, 0), "e": ("e", 1, True, 1), "f": ("f", 1, False, 0)}
    dag = graph.break_cycles(edges, graph.scc_groups(edges))
    assert sorted(tuple(r) for r in dag.collect()) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "f")]
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "sid string")
    assert {r.sid: r.tier for r in graph.session_tiers(nodes, dag).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4, "f": 5, "e": 1, "z": 1}


def test_trace_and_components(spark, edges):
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.trace(edges, start, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "node string")
    assert {r.node: r.component for r in graph.connected_components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "f": "a", "e": "e", "z": "z"}


def test_ranks_and_cores(spark, edges):
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "node string")
    assert sum(r.rank for r in graph.page_rank(edges, nodes).collect()) == pytest.approx(1.0)
    square = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("r", "s")], "src string, dst string")
    assert {r.node: r.core for r in graph.k_core(square).collect()} == {"p": 2, "q": 2, "r": 2, "s": 1}


def test_empty(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.scc_groups(none).count() == 0 and graph.break_cycles(none, graph.scc_groups(none)).count() == 0


def test_trace_without_limit(spark):
    """A chain of 60: the cascades stopped at 50 hops."""
    chain = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(60)] + [("n60", "n00")], "src string, dst string").repartition(1)
    start = spark.createDataFrame([("n00",)], "node string")
    assert {r.node: r.depth for r in graph.trace(chain, start, None).collect()} == {f"n{k:02}": k for k in range(61)}


def test_cascades_have_no_limit(spark):
    from types import SimpleNamespace

    from weftline.plans import lineage

    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(55)], "src string, dst string").repartition(1)
    access = spark.createDataFrame([("n54", "target", "far")], "sid string, role string, tname string")
    c = SimpleNamespace(edges=edges, access=access)
    assert lineage.QUERIES["cascade_by_hop"][0](c).count() == 55
    assert [r.tname for r in lineage.QUERIES["cascade_tables"][0](c).collect()] == ["far"]
    assert lineage.QUERIES["shortest_path_lengths"][0](c).count() == 56


def test_label_propagation_until_stable(spark):
    """A lone pair (its labels changed places for ever), two cliques with a thin bridge, a long path."""
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "pq" for i in range(4) for j in range(i + 1, 4)]
    pairs = [("a", "b", 0.5), ("p0", "q0", 0.1), *cliques, *[(f"x{k:02}", f"x{k + 1:02}", 0.2 + k % 3 * 0.1) for k in range(12)]]
    nodes = sorted({x for p in pairs for x in p[:2]} | {"z"})
    got = {r.node: r.cluster for r in graph.label_propagation(spark.createDataFrame([(x,) for x in nodes], "node string").repartition(1), spark.createDataFrame(pairs, "a string, b string, sim double").repartition(1)).collect()}
    assert sorted(got) == nodes and got["z"] == "z" and got["a"] == got["b"]
    for x in nodes:  # by brute force: no label outweighs a node's own
        weight = {}
        for a, b, w in pairs:
            if x in (a, b):
                label = got[b if x == a else a]
                weight[label] = weight.get(label, 0) + w
        assert not weight or weight.get(got[x], 0) >= max(weight.values()) - 1e-8


def test_share_bound(spark):
    from weftline.operators import usage

    assert [usage.max_share(spark.range(n)) for n in (0, 7, 998, 5000)] == [1, 4, 500, 500]
