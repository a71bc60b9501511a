"""How much hangs on a session: reach of every node by mergeable sketches, exact waves from chosen origins, betweenness,
and the longest chains. All are rounds over edges; a node keeps a state of bounded size, never a list of what it reaches."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import stored

#: Fixed values of the wave: what an amplitude keeps a hop, and where it ends.
DECAY, CUT = 0.7, 0.01
#: A sketch has 2 ** LOG_SLOTS slots: relative error of reach about 1.04 / sqrt(slots), 2.3 %.
LOG_SLOTS = 11
#: Sessions of a chain at least and at most, chains that are kept, and roots that chains begin at.
SHORTEST, LONGEST, CHAINS, ROOTS = 3, 50, 200, 100


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select("src", "dst").distinct()


def expanded_hops(decay: float = DECAY, cut: float = CUT) -> int:
    """The last hop whose nodes still pass a wave of constant mass on."""
    hop = 0
    while decay ** (hop + 1) > cut:
        hop += 1
    return hop


def wave(edges: DataFrame, origins: DataFrame, mass: DataFrame | None = None, decay: float = DECAY, cut: float = CUT) -> DataFrame:
    """origin, node, hop, amp: a wave from every origin (column node), exactly; a row for each node that an origin reaches.

    Amplitude starts at 1 and is multiplied by ``decay`` and the node's mass (node, mass; 1 where absent) at each hop; of
    several parents on shortest ways the strongest counts. Nodes at ``cut`` or below are reached, but pass nothing on.
    """
    edges = stored(_plain(edges), "wave-edges")
    if mass is not None:
        edges = stored(edges.join(mass.select(F.col("node").alias("dst"), "mass"), "dst", "left").select("src", "dst", F.coalesce("mass", F.lit(1.0)).alias("mass")), "wave-edges")
    else:
        edges = edges.withColumn("mass", F.lit(1.0))
    front = stored(origins.select(F.col("node").alias("origin"), "node", F.lit(0).cast("long").alias("hop"), F.lit(1.0).alias("amp")).distinct(), "wave")
    seen = front
    for hop in count(1):
        met = front.where(F.col("amp") > cut).join(edges, front.node == edges.src)
        fresh = met.groupBy("origin", F.col("dst").alias("node")).agg(F.max(F.col("amp") * F.lit(decay) * F.col("mass")).alias("amp")).join(seen, ["origin", "node"], "left_anti")
        front = stored(fresh.select("origin", "node", F.lit(hop).cast("long").alias("hop"), "amp"), "wave")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def exact_reach(edges: DataFrame, nodes: DataFrame, mass: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """node, reach, depth: nodes that a wave from the node reaches, and the last hop that passes it on."""
    found = wave(edges, nodes, mass, cut=cut)
    far = found.groupBy(F.col("origin").alias("node")).agg((F.count("*") - 1).alias("reach"), F.max(F.when((F.col("amp") > cut) | (F.col("hop") == 0), F.col("hop"))).alias("depth"))
    return nodes.select("node").distinct().join(far, "node", "left").select("node", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def sketched_reach(edges: DataFrame, nodes: DataFrame, slots: int = LOG_SLOTS, decay: float = DECAY, cut: float = CUT) -> DataFrame:
    """node, reach, depth of every node as :func:`exact_reach` with mass 1, by sketches: a node's sketch of all within h + 1 hops
    is the union of its successors' sketches of h hops. A round moves a sketch along each edge whose end has changed.

    Memory is constant a node. Small sets are counted exactly by the sketch; the error of large ones is about
    ``1.04 / sqrt(2 ** slots)``. A depth is the last passing hop at which a sketch grew.
    """
    edges = stored(_plain(edges), "reach-edges")
    start = nodes.select("node").distinct().groupBy("node").agg(F.hll_sketch_agg("node", slots).alias("sketch"))
    state = stored(start.select("node", "sketch", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("moved")), "reach")
    last = expanded_hops(decay, cut)
    for hop in range(1, last + 2):
        sent = edges.join(state.where("moved").select(F.col("node").alias("dst"), "sketch"), "dst").groupBy(F.col("src").alias("node")).agg(F.hll_union_agg("sketch").alias("got"))
        met = state.join(sent, "node", "left").withColumn("both", F.when(F.col("got").isNotNull(), F.hll_union("sketch", "got")).otherwise(F.col("sketch")))
        # sketches of equal content may differ in bytes: what counts is the estimate, which never falls
        grew = F.col("got").isNotNull() & (F.hll_sketch_estimate("both") > F.hll_sketch_estimate("sketch"))
        depth = F.when(grew & F.lit(hop <= last), F.lit(hop).cast("long")).otherwise(F.col("depth"))
        state = stored(met.select("node", F.when(grew, F.col("both")).otherwise(F.col("sketch")).alias("sketch"), depth.alias("depth"), grew.alias("moved")), "reach")
        if not state.where("moved").limit(1).count():
            break
    return state.select("node", (F.hll_sketch_estimate("sketch") - 1).alias("reach"), "depth")


def criticality(edges: DataFrame, nodes: DataFrame, mass: DataFrame | None = None, exact: bool = False, slots: int = LOG_SLOTS) -> DataFrame:
    """node, reach, depth, score, amplification, tier of every node (column node).

    reach: nodes that its failure reaches forwards and backwards; depth: the longer of both ways; score: 0.4 of the reach and
    0.3 of the depth, each over all nodes, and 0.3 of the mass over the greatest mass; amplification: reach over direct
    neighbours; tier: 1 to 5 by twenties of the score. ``exact`` follows every wave, with masses in the amplitude; otherwise
    reach comes from sketches, and masses count in the score alone. Node without edges: reach 0. No nodes: no rows.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if exact:
        ways = [exact_reach(e, nodes, mass) for e in (edges, back)]
    else:
        ways = [sketched_reach(e, nodes, slots) for e in (edges, back)]
    there, here = (w.select("node", F.col("reach").alias(f"r{k}"), F.col("depth").alias(f"d{k}")) for k, w in enumerate(ways))
    ends = _plain(edges).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("direct"))
    rows = there.join(here, "node").join(ends, "node", "left")
    rows = rows.withColumn("mass", F.lit(1.0)) if mass is None else rows.join(mass.select("node", "mass"), "node", "left").withColumn("mass", F.coalesce("mass", F.lit(1.0)))
    total = rows.agg(F.count("*").alias("n"), F.max("mass").alias("most"))
    reach, depth = F.col("r0") + F.col("r1"), F.greatest("d0", "d1")
    raw = 100 * (0.4 * reach / F.col("n") + 0.3 * depth / F.col("n") + 0.3 * F.col("mass") / F.greatest(F.col("most"), F.lit(1.0)))
    tier = F.when((raw < 0) | (raw >= 80), 5).otherwise((F.floor(raw / 20) + 1).cast("int"))
    return rows.crossJoin(F.broadcast(total)).select(
        "node", reach.alias("reach"), depth.alias("depth"), F.round(F.least(raw, F.lit(100.0)), 3).alias("score"), F.round(reach / F.greatest(F.coalesce("direct", F.lit(0)), F.lit(1)), 3).alias("amplification"), tier.cast("int").alias("tier"))


def amplitude_curve(edges: DataFrame, found: DataFrame, mass: DataFrame | None = None, share: float = 0.1, n: int = 50) -> DataFrame:
    """node, hop, amplitude, nodes, cumulative: exact waves of the ``n`` nodes of greatest reach (least by name among equals) that
    reach more than ``share`` of all; ``found``: the rows of :func:`criticality`. At most ``n`` rows a node are held."""
    size = found.agg(F.count("*").alias("all"))
    top = found.crossJoin(F.broadcast(size)).where(F.col("reach") > share * F.col("all")).orderBy(F.desc("reach"), "node").limit(n).select("node")
    hops = wave(edges, top, mass).groupBy(F.col("origin").alias("node"), "hop").agg(F.round(F.max("amp"), 4).alias("amplitude"), F.count("*").alias("nodes"))
    from pyspark.sql.window import Window

    return hops.withColumn("cumulative", F.sum("nodes").over(Window.partitionBy("node").orderBy("hop")))


def betweenness(edges: DataFrame, nodes: DataFrame, pivots: int | None = None) -> DataFrame:
    """node, value: the share of shortest ways (fewest hops) between other nodes that lead through the node, normalised.

    Level by level from every pivot at once: rows (pivot, node) with hops and the number of shortest ways; then, from the last level
    back, a node hands its parents their part of it. ``pivots``: how many nodes are origins, the first by hash, and the
    sum is scaled up; None: all, which is exact and has a row for each pair that is connected.
    """
    nodes = nodes.select("node").distinct()
    edges, n = stored(_plain(edges), "between-edges"), nodes.count()
    chosen = nodes if pivots is None else nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
    origins = n if pivots is None else min(n, pivots)
    level = stored(chosen.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("ways")), "between")
    levels, seen = [level], level.select("pivot", "node")
    while True:
        met = levels[-1].join(edges, levels[-1].node == edges.src).select("pivot", F.col("dst").alias("node"), "ways")
        level = stored(met.groupBy("pivot", "node").agg(F.sum("ways").alias("ways")).join(seen, ["pivot", "node"], "left_anti"), "between")
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("pivot", "node"))
    sums, below = [], None
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k]
        if below is None:
            own = own.withColumn("part", F.lit(0.0))
        else:
            given = edges.join(below.select("pivot", F.col("node").alias("dst"), F.col("ways").alias("theirs"), "part"), "dst").join(own.select("pivot", F.col("node").alias("src"), F.col("ways")), ["pivot", "src"])
            shares = given.groupBy("pivot", F.col("src").alias("node")).agg(F.sum(F.col("ways") / F.col("theirs") * (1 + F.col("part"))).alias("part"))
            own = own.join(shares, ["pivot", "node"], "left").select("pivot", "node", "ways", F.coalesce("part", F.lit(0.0)).alias("part"))
        below = stored(own, "between-back")
        sums.append(below.select("node", "part"))
    scale = n / origins / ((n - 1) * (n - 2)) if n > 2 and origins else 0.0
    if not sums:
        return nodes.select("node", F.lit(0.0).alias("value"))
    total = reduce(DataFrame.unionByName, sums).groupBy("node").agg(F.sum("part").alias("part"))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("value"))


def composite_centrality(parts: list[tuple[DataFrame, str, float]], nodes: DataFrame) -> DataFrame:
    """node, the named metrics, and score: each metric (node, name) from 0 to 1 between its least and greatest value (0.5 where all
    are equal), summed by weight. A node that a metric lacks counts 0 in it."""
    rows = nodes.select("node").distinct()
    for df, name, _ in parts:
        rows = rows.join(df.select("node", F.col(name).cast("double").alias(name)), "node", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    ends = rows.agg(*[f(name).alias(f"{tag}_{name}") for _, name, _ in parts for f, tag in ((F.min, "lo"), (F.max, "hi"))])
    span = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    scaled = [F.lit(w) * F.when(span(c) > 0, (F.col(c) - F.col(f"lo_{c}")) / span(c)).otherwise(0.5) for _, c, w in parts]
    return rows.crossJoin(F.broadcast(ends)).select("node", *[F.round(c, 9).alias(c) for _, c, _ in parts], F.round(reduce(lambda a, b: a + b, scaled), 4).alias("score"))


def _lengths(edges: DataFrame, longest: int) -> DataFrame:
    """node, ways: bit k - 1 is set if a way of k nodes (k up to ``longest``) leads from the node to a leaf of the acyclic graph."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    leaves = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    state = stored(nodes.join(leaves.withColumn("leaf", F.lit(1).cast("long")), "node", "left").select("node", F.coalesce("leaf", F.lit(0).cast("long")).alias("ways")), "chain-ways")
    moved, limit = state.where("ways > 0"), (1 << longest) - 1
    while True:
        sent = edges.join(moved.select(F.col("node").alias("dst"), "ways"), "dst").groupBy(F.col("src").alias("node")).agg(F.bit_or(F.shiftleft("ways", 1).bitwiseAND(F.lit(limit))).alias("got"))
        met = state.join(sent, "node", "left").select("node", F.coalesce(F.col("ways").bitwiseOR(F.col("got")), "ways").alias("ways"), F.col("ways").alias("old"))
        fresh = stored(met.select("node", "ways", (F.col("ways") != F.col("old")).alias("moved")), "chain-ways")
        state, moved = fresh.select("node", "ways"), fresh.where("moved")
        if not moved.limit(1).count():
            return state


def longest_chains(edges: DataFrame, n: int = CHAINS, roots: int = ROOTS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """chain_id (from 1), path, length: the ``n`` longest ways from a root to a leaf of an acyclic graph, of ``shortest`` to ``longest`` (62
    at most) nodes, from the first ``roots`` roots by name; among equals the first by the nodes' names.

    Each node knows as bits which lengths lead on to a leaf. Ways grow from the roots in step; the ``n`` that can become longest are
    kept. Each of those has a way of its own to the end, so no way that is left out is among the ``n`` longest.
    """
    edges = stored(_plain(edges), "chain-edges")
    ways = stored(_lengths(edges, longest), "chain-ways")
    # the greatest length that the way can have in all: steps so far, and bits of the end that stay within the limit
    fits = F.col("ways").bitwiseAND(F.expr(f"shiftright({(1 << longest) - 1}L, size(path) - 1)"))
    most = F.when(fits > 0, F.size("path") - 1 + F.length(F.bin(fits))).otherwise(0)
    starts = ways.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").orderBy("node").limit(roots)
    best = lambda df: df.withColumn("most", most.cast("long")).where(F.col("most") >= shortest).orderBy(F.desc("most"), "path").limit(n)
    open_ = stored(best(starts.select(F.array("node").alias("path"), "node", "ways")), "chains")
    closed = None
    while open_.limit(1).count():
        leaf = F.col("ways") == 1
        ended = open_.where(leaf)
        closed = ended if closed is None else closed.unionByName(ended)
        grown = open_.where(~leaf).select("path", F.col("node").alias("src")).join(edges, "src").join(ways.select(F.col("node").alias("dst"), "ways"), "dst")
        grown = grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), "ways")
        # ways that have ended compete with those that may yet grow
        rivals = best(grown.unionByName(closed.select("path", "node", "ways")))
        rivals = stored(rivals, "chains")
        closed = rivals.where(leaf)
        open_ = rivals.where(~leaf)
    if closed is None:
        return open_.select(F.lit(0).cast("long").alias("chain_id"), "path", F.size("path").cast("long").alias("length"))
    from pyspark.sql.window import Window

    # at most n rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.size("path")), "path"))
    return closed.select(place.cast("long").alias("chain_id"), "path", F.size("path").cast("long").alias("length"))


def chain_documents(chains: DataFrame, sessions: DataFrame) -> DataFrame:
    """chain_id, text: each chain described step by step; ``sessions`` has sid, tier, sources and targets (lists)."""
    steps = chains.select("chain_id", "length", F.array_join("path", " -> ").alias("whole"), F.posexplode("path").alias("at", "sid"))
    known = steps.join(sessions.select("sid", "tier", "sources", "targets"), "sid", "left")
    few = lambda c: F.array_join(F.slice(c, 1, 5), ", ")
    line = F.concat(F.lit("  Step "), F.col("at") + 1, F.lit(": "), "sid", F.when(F.col("tier").isNotNull(), F.concat(F.lit(" - reads "), few("sources"), F.lit(", writes "), few("targets"))).otherwise(""))
    lines = known.groupBy("chain_id", "length", "whole").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line"), F.coalesce("tier", F.lit(0)).alias("tier")))).alias("lines"))
    text = F.concat(
        F.lit("DEPENDENCY CHAIN ("), "length", F.lit(" sessions):\nPath: "), "whole", F.lit("\n\nSteps:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
        F.lit("\n\nThis chain represents a complete data flow spanning "), "length", F.lit(" processing steps.\nTier range: "), F.element_at("lines", 1)["tier"], F.lit(" -> "), F.element_at("lines", -1)["tier"], F.lit("\n"))
    return lines.select("chain_id", text.alias("text"))
