"""Tiers and components in rounds and in one task, against plain searches; how many tables a loop writes and leaves."""

import os
import random

import pytest

from weftline import shared
from weftline.operators import graph


def _frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").repartition(2)


def _reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for x in {x for e in edges for x in e}:
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[x] = seen
    return out


@pytest.mark.parametrize("small", [4, 1 << 21])
def test_components_and_tiers_equal_plain_searches(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    draw = random.Random(5)
    n = 12 if small < 100 else 60
    edges = sorted({(f"n{draw.randrange(n):02}", f"n{draw.randrange(n):02}") for _ in range(3 * n // 2)} | {(f"p{k}", f"p{k + 1}") for k in range(4)})
    reach = _reach(edges)
    group = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in reach}
    found = {r.node: r for r in graph.scc_groups(_frame(spark, edges)).collect()}
    assert {x: r.group for x, r in found.items()} == group
    assert all(r.is_cycle == (x in reach[x]) and r.size == sum(g == r.group for g in group.values()) and r.internal_edges == sum(group[a] == group[b] == r.group for a, b in edges) for x, r in found.items())
    kept = [(a, b) for a, b in edges if group[a] != group[b] or a < b]
    frame = _frame(spark, edges)
    dag = graph.break_cycles(frame, graph.scc_groups(frame))
    assert sorted(tuple(r) for r in dag.collect()) == kept
    tier = {x: 1 for x in [*reach, "alone"]}
    for _ in tier:
        for a, b in kept:
            tier[b] = max(tier[b], tier[a] + 1)
    sessions = spark.createDataFrame([(x,) for x in tier], "sid string")
    for given in (dag, frame):
        assert {r.sid: r.tier for r in graph.session_tiers(sessions, given).collect()} == tier


def test_tiers_of_a_long_path_write_few_tables(spark, monkeypatch):
    """Each step of a path was a round: 300 tables."""
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or shared.stored(df, name))
    path = _frame(spark, [(f"n{k:03}", f"n{k + 1:03}") for k in range(300)])
    sessions = spark.createDataFrame([(f"n{k:03}",) for k in range(301)], "sid string")
    assert {r.sid: r.tier for r in graph.session_tiers(sessions, path).collect()} == {f"n{k:03}": k + 1 for k in range(301)}
    assert len(written) < 5


def test_tiers_break_cycles_by_name(spark, monkeypatch):
    """Numbers go by their digits: 10 comes before 9."""
    edges = spark.createDataFrame([(9, 10), (10, 9), (9, 11), (3, 3)], "src long, dst long")
    sessions = spark.createDataFrame([(x,) for x in (3, 9, 10, 11)], "sid long")
    for small in (1, 100):
        monkeypatch.setattr(graph, "SMALL", small)
        assert {r.sid: r.tier for r in graph.session_tiers(sessions, edges).collect()} == {3: 1, 9: 2, 10: 1, 11: 3}


def test_released_tables_are_gone(spark):
    table = shared.stored(spark.range(5), "gone")
    shared.release(table, spark.range(3))
    assert not os.path.exists(table._stored)


def test_loops_leave_no_tables_of_earlier_rounds(spark):
    """Every round's table stayed: 21 of ranks, two a hop of paths."""
    base = spark.conf.get("spark.checkpoint.dir")
    edges = _frame(spark, [(f"n{k}", f"n{k + 1}") for k in range(5)])
    ends = [spark.createDataFrame([(x,)], "node string") for x in ("n0", "n5")]
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(6)], "node string")
    for run, most in ((lambda: graph.page_rank(edges, nodes), 1), (lambda: graph.connected_components(nodes, edges), 1), (lambda: graph.trace(edges, ends[0], None), 3), (lambda: graph.shortest_path(edges, *ends), 10)):
        before = set(os.listdir(base))
        assert run().count() == 6
        assert len(set(os.listdir(base)) - before) <= most
