"""Graph operators as DataFrame loops: each round joins a frontier to the edges; one count a round comes to
the driver, and what a round leaves is a table in the shared folder."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import release, settled, stored


def _by_role(access: DataFrame, role: str, name: str) -> DataFrame:
    return access.where(F.col("role") == role).select("tname", F.col("sid").alias(name))


def session_lineage_edges(access: DataFrame) -> DataFrame:
    """src, dst, edge_type, via_table: writers to readers and to lookup users of a table."""
    writers = _by_role(access, "target", "src")
    out = None
    for role, kind in (("source", "data_flow"), ("lookup", "lookup_dependency")):
        part = writers.join(_by_role(access, role, "dst"), "tname").where("src <> dst").select("src", "dst", F.lit(kind).alias("edge_type"), F.col("tname").alias("via_table"))
        out = part if out is None else out.unionByName(part)
    return out


def dependency_edges(access: DataFrame) -> DataFrame:
    """src, dst (distinct): writers to users of a table that do not write it themselves."""
    held = access.repartition("tname").groupBy("tname", "sid").agg(F.bool_or(F.col("role") == "target").alias("writes"))  # one exchange for both sides
    writers = held.where("writes").select("tname", F.col("sid").alias("src"))
    return writers.join(held.where("not writes").select("tname", F.col("sid").alias("dst")), "tname").select("src", "dst").distinct()


#: A graph of at most so many edges is finished in one task, in arrays of bounded size; larger ones go on in rounds.
SMALL = 1 << 21


def _alone(edges: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` over all edges (at most ``SMALL``) in one task: it gets the nodes and the places of both ends in them."""

    kind = pa.int64() if dict(edges.dtypes)["src"] == "bigint" else pa.string()

    def run(batches):
        held = list(batches)
        coded = pa.chunked_array([b.column(c) for c in (0, 1) for b in held], kind).combine_chunks().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield solve(coded.dictionary, at[: len(at) // 2], at[len(at) // 2 :])

    return edges.select("src", "dst").repartition(1).mapInArrow(run, schema)


def _successors(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than nodes) and the nodes after each node."""
    return np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))), dst[np.argsort(src, kind="stable")]


def _roots(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A node of the component of each node (-1: on no cycle) by Tarjan's search, without recursion, after most others are trimmed."""
    m = -1
    while m != len(src) and (m < 0 or len(src) < 0.99 * m):
        m = len(src)
        entered, left = np.zeros(n, bool), np.zeros(n, bool)
        entered[dst] = left[src] = True
        keep = entered[src] & left[dst]
        src, dst = src[keep], dst[keep]
    starts, after = (x.tolist() for x in _successors(n, src, dst))
    number, low, stack, on, root = [0] * n, [0] * n, [], [False] * n, [-1] * n
    clock, following = 0, starts[:-1]
    for first in np.unique(src).tolist():
        if number[first]:
            continue
        walk = [first]
        while walk:
            v = walk[-1]
            if not number[v]:
                clock += 1
                number[v] = low[v] = clock
                stack.append(v)
                on[v] = True
            if following[v] < starts[v + 1]:
                w = after[following[v]]
                following[v] += 1
                if not number[w]:
                    walk.append(w)
                elif on[w]:
                    low[v] = min(low[v], number[w])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[v])
            if low[v] == number[v]:
                while True:
                    w = stack.pop()
                    on[w], root[w] = False, v
                    if w == v:
                        break
    root = np.array(root, np.int64)
    cyclic = (root >= 0) & (np.bincount(root[root >= 0], minlength=n)[root] > 1)
    cyclic[src[src == dst]] = True
    return np.where(cyclic, root, -1)


def _strong(nodes, src: np.ndarray, dst: np.ndarray):
    """node, label of the nodes on cycles."""
    root = _roots(len(nodes), src, dst)
    which = np.flatnonzero(root >= 0)
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(which)), nodes.take(pa.array(root[which]))], ["node", "label"])


def _levels(nodes, src: np.ndarray, dst: np.ndarray):
    """node, tier (1 + the longest path that ends in it) of all nodes that an edge enters."""
    starts, after = _successors(len(nodes), src, dst)
    waiting, tier = np.bincount(dst, minlength=len(nodes)), np.ones(len(nodes), np.int64)
    entered = np.flatnonzero(waiting)
    now, level = np.flatnonzero(waiting == 0), 1
    while len(now):
        sizes = starts[now + 1] - starts[now]
        reached = after[np.repeat(starts[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        met, times = np.unique(reached, return_counts=True)
        waiting[met] -= times
        level += 1
        now = met[waiting[met] == 0]
        tier[now] = level
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(entered)), pa.array(tier[entered])], ["node", "tier"])


def _trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges left after taking away, again and again, nodes that nothing enters or nothing leaves, until none goes or at most
    ``SMALL`` edges are left; and their number."""
    edges = settled(edges, "trim")
    first, n = edges, edges.count()
    while n > SMALL:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = stored(kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trim")
        m = kept.count()
        if edges is not first:
            release(edges)
        edges = kept
        if m == n:
            break
        n = m
    return edges, n


def reach_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the greatest node that reaches it (itself included)."""
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        pushed = edges.join(labels, edges.src == labels.node).groupBy(F.col("dst").alias("n")).agg(F.max("label").alias("l"))
        fresh = stored(labels.join(pushed, labels.node == pushed.n, "left").select("node", F.greatest("label", F.coalesce("l", "label")).alias("label"), F.col("label").alias("old")), "labels")
        moved = fresh.where("label <> old").limit(1).count()
        release(labels)
        labels = fresh.select("node", "label")
        labels._stored = fresh._stored
        if not moved:
            return labels


def _strong_parts(edges: DataFrame) -> DataFrame:
    """node, label of the nodes of components of two and more, and of nodes with an edge to themselves.

    Nodes outside cycles are trimmed; what is small then is solved in one task. Else a node whose greatest ancestor is itself
    is the root of the component of those that also reach it, which backward spreading within its label finds.
    """
    found, (rest, n) = None, _trim(edges)
    while n > SMALL:
        ends = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        labels = reach_labels(rest, ends)
        reached = stored(labels.where("node = label"), "scc")
        same = labels.select(F.col("node").alias("n"), F.col("label").alias("n_label"))
        frontier = reached
        while True:
            back = frontier.join(rest, frontier.node == rest.dst).select(F.col("src").alias("node"), "label").distinct()
            back = back.join(same, (back.node == same.n) & (back.label == same.n_label), "left_semi").join(reached, ["node", "label"], "left_anti")
            spread = stored(back, "scc")
            if frontier is not reached:
                release(frontier)
            frontier = spread
            if not frontier.limit(1).count():
                break
            grown = stored(reached.unionByName(frontier), "scc")
            release(reached)
            reached = grown
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select(F.col("node").alias("g"))
        rest, n = _trim(rest.join(gone, rest.src == gone.g, "left_anti").join(gone, rest.dst == gone.g, "left_anti"))
    kind = dict(edges.dtypes)["src"]
    last = _alone(rest, _strong, f"node {kind}, label {kind}")
    if found is None:
        return last
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    several = found.join(found.groupBy("label").agg(F.count("*").alias("m")).where("m > 1"), "label", "left_semi")
    return several.unionByName(found.join(loops, "node", "left_semi").join(several, "node", "left_anti").select("label", "node")).unionByName(last)


def cycle_groups(edges: DataFrame) -> DataFrame:
    """node, group (the least node of its component), size, is_cycle (true), internal_edges of the nodes on cycles alone."""
    members = stored(_strong_parts(edges).select("node", "label"), "cycles")
    names = members.groupBy("label").agg(F.min("node").alias("group"), F.count("*").alias("size"))
    grouped = members.join(names, "label")
    left, right = members.select(F.col("node").alias("src"), F.col("label").alias("sl")), members.select(F.col("node").alias("dst"), F.col("label").alias("dl"))
    inner = edges.join(left, "src").join(right, "dst").where("sl = dl").groupBy(F.col("sl").alias("label")).agg(F.count("*").alias("internal_edges"))
    return stored(grouped.join(inner, "label").select("node", "group", "size", F.lit(True).alias("is_cycle"), "internal_edges"), "cycles")


def scc_groups(edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """node, group, size, is_cycle, internal_edges of every node on an edge; ``cycles``: what ``cycle_groups`` found in them."""
    cycles = cycle_groups(edges) if cycles is None else cycles
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(cycles, "node", "left").select(
        "node", F.coalesce("group", "node").alias("group"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"), F.coalesce("internal_edges", F.lit(0)).cast("long").alias("internal_edges"))


def break_cycles(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges without those that go back by name (or nowhere) inside a component."""
    g = groups.where("is_cycle").select("node", "group")
    joined = edges.join(g.select(F.col("node").alias("src"), F.col("group").alias("sg")), "src", "left").join(g.select(F.col("node").alias("dst"), F.col("group").alias("dg")), "dst", "left")
    return joined.where(F.col("sg").isNull() | F.col("dg").isNull() | (F.col("sg") != F.col("dg")) | (F.col("src").cast("string") < F.col("dst").cast("string"))).select("src", "dst")


def session_tiers(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """sid, tier: 1 + the longest path that ends in it, over the edges that ``break_cycles`` leaves; nodes may be numbers, which
    then go by their digits as names do.

    Each round takes away the nodes that nothing enters, whose tier is the round's number, and those that nothing leaves, whose
    edges wait; what is small is solved in one task. Cycles are left in what no round takes away: where there are any, they are
    broken and the rounds begin again. Then the rounds go back: a node that nothing left is one after the last of its
    waiting edges. So an edge is read in as many rounds as paths go on at both of its ends.
    """
    edges = whole = settled(edges, "dag")
    n, turn, waiting, broken = edges.count(), 1, [], False
    while True:
        m = -1
        while n > SMALL and m != n:
            m = n
            heads = stored(edges.select(F.col("dst").alias("node")).distinct(), "tier-heads")
            tails = edges.select(F.col("src").alias("t")).distinct()
            inner = edges.join(heads, edges.src == heads.node, "left_semi")
            split = stored(inner.join(tails, inner.dst == tails.t, "left").select("src", "dst", F.col("t").isNull().alias("waits")), "dag")
            edges = split.where("not waits").select("src", "dst")
            n = edges.count()
            waiting.append((turn, heads, split))
            turn += 1
        if broken:
            break
        cycles = stored(_strong_parts(settled(edges, "dag")), "cycles").select("node", F.col("label").alias("group"), F.lit(True).alias("is_cycle"))
        if not cycles.limit(1).count():
            break
        for _, heads, split in waiting:
            release(heads, split)
        edges = whole = stored(break_cycles(whole, cycles), "dag")
        n, turn, waiting, broken = edges.count(), 1, [], True
    known = stored(_alone(edges, _levels, f"node {dict(edges.dtypes)['src']}, tier long").select("node", (F.col("tier") + (turn - 1)).alias("tier")), "tiers")
    for at, heads, split in reversed(waiting):
        least = F.lit(at + 1).cast("long")
        ends = split.where("waits").select(F.col("src").alias("node"), "dst").join(known, "node", "left").groupBy(F.col("dst").alias("node")).agg((F.max(F.coalesce("tier", least)) + 1).alias("late"))
        fresh = heads.join(known, "node", "left").join(ends, "node", "left").select("node", F.coalesce("tier", "late", least).alias("tier"))
        after = stored(fresh, "tiers")
        release(known, heads, split)
        known = after
    if broken:
        release(whole)
    return sessions.select("sid").join(known.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("tier", F.lit(1)).cast("long").alias("tier"))


def trace(edges: DataFrame, start: DataFrame, max_hops: int | None) -> DataFrame:
    """node, depth of all nodes within ``max_hops`` (None: any number) of the ``start`` nodes (column node, depth 0)."""
    edges = stored(edges.select("src", "dst"), "trace-edges")  # every hop reads them
    visited = stored(start.select("node", F.lit(0).cast("long").alias("depth")), "trace")
    frontier = visited
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        fresh = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        found = stored(fresh.select("node", F.lit(hop).cast("long").alias("depth")), "trace")
        if not found.limit(1).count():
            break
        grown = stored(visited.unionByName(found), "trace")
        release(visited, frontier)
        visited, frontier = grown, found
    release(edges)
    return visited


def shortest_path(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """step, node of a path with the fewest hops from ``start`` to ``end`` (column node, a row each); of several
    parents the least by name is taken. Empty where there is none. A round a hop, and one back."""
    edges = settled(edges.select("src", "dst"), "pairs")  # once: each hop reads both ends
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    visited = stored(start.select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent")), "path")
    frontier = visited
    for hop in count(1):
        if visited.join(end.select("node"), "node", "left_semi").limit(1).count():
            break
        at = frontier.select(F.col("node").alias("src"))
        met = edges.join(at, "src").unionByName(back.join(at, "src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        fresh = stored(met.join(visited, "node", "left_anti").select("node", F.lit(hop).cast("long").alias("depth"), "parent"), "path")
        if not fresh.limit(1).count():
            return visited.limit(0).select(F.col("depth").alias("step"), "node")
        grown = stored(visited.unionByName(fresh), "path")
        release(visited, frontier)
        visited, frontier = grown, fresh
    at = stored(visited.join(end.select("node"), "node", "left_semi"), "walk")
    walked = at
    while at.where("parent is not null").limit(1).count():
        at = stored(visited.join(at.select(F.col("parent").alias("node")), "node", "left_semi"), "walk")
        walked = walked.unionByName(at)
    return walked.select(F.col("depth").alias("step"), "node")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def connected_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, component (its least node): least label of neighbours, then the label of the label."""
    # a pair that is there both ways does no harm to a minimum
    edges = stored(pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "pairs")
    labels = stored(nodes.select("node", F.col("node").alias("component")), "components")
    while True:
        met = edges.join(labels, edges.dst == labels.node).groupBy(F.col("src").alias("n")).agg(F.min("component").alias("c"))
        spread = labels.join(met, labels.node == met.n, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        fresh = stored(spread.join(jump, spread.component == jump.j, "left").select("node", "old", F.least("component", F.coalesce("jc", "component")).alias("component")), "components")
        moved = fresh.where("component <> old").limit(1).count()
        release(labels)
        labels = fresh.select("node", "component")
        labels._stored = fresh._stored
        if not moved:
            release(edges)
            return labels


def label_propagation(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, cluster: until no label outweighs a node's own among its neighbours (the least by name among equals).

    ``pairs`` has a, b, sim, each pair once. While the number of nodes that want another label reaches new lows, about
    half of them (by hash, anew each round) move at once. In other rounds only those move that come before all
    neighbours that want to: each such round adds weight between nodes of one label, so the loop ends.
    """
    both = stored(pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")), "pairs")
    labels = stored(nodes.select("node", F.col("node").alias("cluster")), "labels")
    least = None
    for turn in count(1):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "cluster").agg(F.round(F.sum("sim"), 9).alias("w"))
        seen = votes.join(labels.withColumnRenamed("cluster", "old"), "node").groupBy("node").agg(
            F.min(F.struct((-F.col("w")).alias("w"), "cluster")).alias("best"), F.coalesce(F.max(F.when(F.col("cluster") == F.col("old"), F.col("w"))), F.lit(0.0)).alias("own"))
        wishes = stored(seen.where(-F.col("best.w") > F.col("own")).select("node", F.col("best.cluster").alias("fresh"), F.xxhash64("node", F.lit(turn)).alias("rank")), "wishes")
        n = wishes.count()
        if not n:
            return labels
        if least is None or n < least:
            least, moves = n, wishes.where(F.col("rank") % 2 == 0)
        else:
            order = F.struct("rank", "node")
            after = both.join(wishes.select(F.col("node").alias("a"), order.alias("ra")), "a").join(wishes.select(F.col("node").alias("b"), order.alias("rb")), "b").where("ra > rb")
            moves = wishes.join(after.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        labels = stored(labels.join(moves, "node", "left").select("node", F.coalesce("fresh", "cluster").alias("cluster")), "labels")


def page_rank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank: weighted by edge weight where there is one, dangling mass spread evenly."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    total = weighted.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = stored(weighted.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "shares")
    n = max(1, nodes.count())
    leaving = shares.select(F.col("src").alias("node")).distinct().withColumn("leaves", F.lit(True))
    ranks = stored(nodes.select("node").join(leaving, "node", "left").select("node", "leaves", F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(rounds):
        got = shares.join(ranks, shares.src == ranks.node).groupBy(F.col("dst").alias("d")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = ranks.where("leaves is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        moved = ranks.join(got, ranks.node == got.d, "left").crossJoin(F.broadcast(lost))
        fresh = stored(moved.select("node", "leaves", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")), "ranks")
        release(ranks)
        ranks = fresh
    release(shares)
    return ranks.select("node", "rank")


def k_core(edges: DataFrame) -> DataFrame:
    """node, core: the h-index of neighbours' estimates, until none changes."""
    pairs = stored(both_ways(edges).where("src <> dst"), "pairs")
    core = stored(pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core")), "core")
    while True:
        seen = pairs.join(core.select(F.col("node").alias("dst"), F.col("core").alias("c")), "dst").groupBy(F.col("src").alias("s"), "c").agg(F.count("*").alias("n"))
        from pyspark.sql.window import Window

        high = seen.withColumn("at_least", F.sum("n").over(Window.partitionBy("s").orderBy(F.desc("c"))))
        h = high.groupBy("s").agg(F.max(F.least("c", "at_least")).alias("h"))
        fresh = stored(core.join(h, core.node == h.s).select("node", F.col("core").alias("old"), F.least("core", "h").alias("core")), "core")
        moved = fresh.where("core <> old").limit(1).count()
        core = fresh.select("node", "core")
        if not moved:
            return core
