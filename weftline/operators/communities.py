"""Modularity communities at several resolutions side by side: local moves and contraction as DataFrame rounds.

All resolutions run in the same rounds (a column ``r`` keys every table), so a sweep costs the jobs of one run. A round
evaluates every node once: the weight to its own and to the best other community. The same table gives the modularity of
the labels, so a round that moved about half of the nodes that gain is kept only if modularity rose; otherwise only
moves are made that are the best of all that touch their old or their new community. Those never touch the same
community, so their gains add up, and modularity rises in every such round. A level ends when nothing gains, or when such
a round gains less than ``SETTLED``. A contracted community's inner weight stays as a loop: it counts in degrees and in
modularity, never as a tie to a community.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import connected_components
from weftline.shared import stored

SCALES = {"macro": 0.3, "meso": 1.0, "micro": 3.0}
AUTO = (0.5, 0.8, 1.0, 1.3, 1.8, 2.5, 4.0)
SWEEP = (0.1, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 3.0, 5.0)
#: A round of separate moves that adds less modularity ends a level.
SETTLED = 1e-5


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _evaluated(edges: DataFrame, labels: DataFrame, degree: DataFrame, total: float, turn: int) -> DataFrame:
    """r, node, old, d, rank, and for every node: inside (weight to its own community), whole (its community's degree), fresh
    (the best other community) and gain (what moving there adds, in weight)."""
    held = labels.join(degree, ["r", "node"])
    sizes = held.groupBy("r", "cluster").agg(F.sum("d").alias("whole"))
    other = labels.select("r", F.col("node").alias("b"), "cluster")
    ties = edges.where("a <> b").join(other, ["r", "b"]).groupBy("r", F.col("a").alias("node"), "cluster").agg(F.round(F.sum("sim"), 9).alias("w"))
    own = held.withColumnRenamed("cluster", "old").join(sizes.select("r", F.col("cluster").alias("old"), "whole"), ["r", "old"])
    priced = ties.join(sizes.withColumnRenamed("whole", "theirs"), ["r", "cluster"]).join(own.select("r", "node", "old", "d"), ["r", "node"])
    here = F.col("cluster") == F.col("old")
    value = F.col("w") - F.col("r") * F.col("d") * F.col("theirs") / total
    best = priced.groupBy("r", "node").agg(F.max(F.when(here, F.col("w"))).alias("inside"), F.min(F.when(~here, F.struct((-value).alias("less"), "cluster"))).alias("best"))
    stay = F.coalesce("inside", F.lit(0.0)) - F.col("r") * F.col("d") * (F.col("whole") - F.col("d")) / total
    return own.join(best, ["r", "node"], "left").select("r", "node", "old", "d", "whole", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.col("best.cluster").alias("fresh"), (-F.col("best.less") - stay).alias("gain"), F.xxhash64("node", F.lit(turn)).alias("rank"))


def _separate(wishes: DataFrame) -> DataFrame:
    """The wishes that are the best of all that touch their old or their new community."""
    order = F.struct((-F.col("gain")).alias("less"), "rank", "node")
    touched = wishes.select("r", "node", order.alias("order"), F.explode(F.array("old", "fresh")).alias("at"))
    first = touched.groupBy("r", "at").agg(F.min("order").alias("first"))
    won = touched.join(first, ["r", "at"]).where(F.col("order") == F.col("first")).groupBy("r", "node").agg(F.count("*").alias("wins"))
    return wishes.join(won.where("wins = 2").select("r", "node"), ["r", "node"], "left_semi")


def _level(edges: DataFrame, total: float, inner: dict[float, float], settled: float) -> DataFrame:
    """r, node, cluster after the local moves of one level; ``inner``: weight of the loops of each resolution."""
    degree = stored(edges.groupBy("r", F.col("a").alias("node")).agg(F.sum("sim").alias("d")), "community-degree")
    labels = stored(degree.select("r", "node", F.col("node").alias("cluster")), "communities")
    known: dict[float, float] = {}
    before, ended, strict, turn = None, [], set(), 0
    live = edges
    while True:
        turn += 1
        seen = stored(_evaluated(live, labels, degree, total, turn), "community-moves")
        stats = {x.r: x for x in seen.groupBy("r").agg(F.sum("inside").alias("inside"), F.sum(F.col("d") * F.col("whole")).alias("sq"), F.count_if(F.col("gain") > 1e-9).alias("n")).collect()}
        redo, over = [], []
        for r, x in stats.items():
            q = (x.inside + inner.get(r, 0.0)) / total - r * x.sq / total**2
            gain = q - known[r] if r in known else None
            if gain is not None and gain <= 1e-12 and r not in strict:
                redo.append(r)
                continue
            known[r] = q
            if not x.n or gain is not None and r in strict and gain < settled:
                over.append(r)
        strict = set(redo)
        if redo:  # back to the labels before, and only separate moves from there
            old_labels, old_seen = before
            undone = F.col("r").isin(redo)
            labels, seen = labels.where(~undone).unionByName(old_labels.where(undone)), seen.where(~undone).unionByName(old_seen.where(undone))
        wishes = seen.where("gain > 1e-9")
        if over:
            ended.append(labels.where(F.col("r").isin(over)))
            labels, wishes, live = (x.where(~F.col("r").isin(over)) for x in (labels, wishes, live))
            if len(over) == len(stats):
                break
        moves = wishes.where(F.pmod("rank", F.lit(2)) == 0)
        if redo:
            moves = moves.where(~undone).unionByName(_separate(wishes.where(undone)))
        before = labels, seen
        labels = stored(labels.join(moves.select("r", "node", "fresh"), ["r", "node"], "left").select("r", "node", F.coalesce("fresh", "cluster").alias("cluster")), "communities")
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def louvain(nodes: DataFrame, pairs: DataFrame, resolutions=(1.0,), settled: float = SETTLED) -> DataFrame:
    """r, node, cluster (its least node): communities of the weighted graph (a, b, sim; each pair once) at each resolution.

    Levels follow until one joins nothing. Nodes without a pair stay alone. Empty graph: every node alone."""
    rs = F.array(*[F.lit(float(r)) for r in resolutions])
    found = stored(nodes.select(F.explode(rs).alias("r"), "node", F.col("node").alias("cluster")), "communities-found")
    both = _both(pairs.where("a <> b"))
    total = both.agg(F.coalesce(F.sum("sim"), F.lit(0.0))).first()[0]
    if not total:
        return found
    edges = stored(both.select(F.explode(rs).alias("r"), "a", "b", "sim"), "community-edges")
    while True:
        inner = {x.r: x.w for x in edges.where("a = b").groupBy("r").agg(F.sum("sim").alias("w")).collect()}
        labels = stored(_level(edges, total, inner, settled), "community-level")
        moved = [x.r for x in labels.where("node <> cluster").select("r").distinct().collect()]
        if not moved:
            break
        up = labels.select("r", F.col("node").alias("cluster"), F.col("cluster").alias("up"))
        found = stored(found.join(up, ["r", "cluster"], "left").select("r", "node", F.coalesce("up", "cluster").alias("cluster")), "communities-found")
        of = lambda end: labels.select("r", F.col("node").alias(end), F.col("cluster").alias(f"{end}c"))
        edges = edges.where(F.col("r").isin(moved)).join(of("a"), ["r", "a"]).join(of("b"), ["r", "b"])
        edges = stored(edges.groupBy("r", F.col("ac").alias("a"), F.col("bc").alias("b")).agg(F.sum("sim").alias("sim")), "community-edges")
    names = found.groupBy("r", "cluster").agg(F.min("node").alias("least"))
    return found.join(names, ["r", "cluster"]).select("r", "node", F.col("least").alias("cluster"))


def modularities(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """r, modularity of each labelling (r, node, cluster) of the weighted graph, at resolution 1."""
    of = lambda end: labels.select("r", F.col("node").alias(end), F.col("cluster").alias(f"{end}c"))
    ends = _both(pairs).join(of("a"), "a").join(of("b").withColumnRenamed("r", "rb"), "b").where("r = rb")
    sums = ends.groupBy("r", "ac").agg(F.sum("sim").alias("d"), F.sum(F.when(F.col("ac") == F.col("bc"), F.col("sim")).otherwise(0.0)).alias("inside"))
    per = sums.groupBy("r").agg(F.sum("inside").alias("inside"), F.sum(F.col("d") * F.col("d")).alias("sq"), F.sum("d").alias("total"))
    return labels.select("r").distinct().join(per, "r", "left").select("r", F.round(F.coalesce(F.col("inside") / F.col("total") - F.col("sq") / (F.col("total") * F.col("total")), F.lit(0.0)), 6).alias("modularity"))


def communities(nodes: DataFrame, pairs: DataFrame, scales=SCALES) -> DataFrame:
    """scale, node, cluster, modularity: communities at each named resolution."""
    pairs = stored(pairs, "community-pairs")
    labels = louvain(nodes, pairs, tuple(scales.values()))
    name = F.lit(None).cast("string")
    for k, r in scales.items():
        name = F.when(F.col("r") == float(r), k).otherwise(name)
    return labels.join(F.broadcast(modularities(pairs, labels)), "r").select(name.alias("scale"), "node", "cluster", "modularity")


def resolution_sweep(nodes: DataFrame, pairs: DataFrame, resolutions=SWEEP) -> DataFrame:
    """resolution, communities, modularity, largest, smallest."""
    pairs = stored(pairs, "community-pairs")
    labels = stored(louvain(nodes, pairs, resolutions), "sweep")
    sizes = labels.groupBy("r", "cluster").agg(F.count("*").alias("n"))
    per = sizes.groupBy("r").agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return per.join(modularities(pairs, labels), "r").select(F.col("r").alias("resolution"), "communities", "modularity", "largest", "smallest")


def merge_singletons(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``labels`` (node, cluster) with members of one-node clusters in the cluster of their strongest neighbour (the least by
    name among equals). Where that one is alone, too, they join it; nodes without a neighbour stay."""
    alone = labels.join(labels.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1"), "cluster", "left_semi")
    best = _both(pairs).join(alone.select(F.col("node").alias("a")), "a", "left_semi").groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("less"), "b")).alias("best"))
    to = best.select("a", F.col("best.b").alias("node")).join(labels, "node").select(F.col("a").alias("node"), F.col("cluster").alias("to"))
    links = stored(to.join(labels, "node").select(F.col("cluster").alias("src"), F.col("to").alias("dst")), "singletons")
    groups = connected_components(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), links)
    return labels.join(groups.select(F.col("node").alias("cluster"), "component"), "cluster", "left").select("node", F.coalesce("component", "cluster").alias("cluster"))


def louvain_auto(nodes: DataFrame, pairs: DataFrame, resolutions=AUTO, least: int = 8, most: int = 200, near: int = 50) -> DataFrame:
    """node, cluster, resolution: of the resolutions in order the first with ``least`` to ``most`` communities, else the one nearest
    to ``near`` (the earlier of equals); then single nodes join their strongest neighbour."""
    pairs = stored(pairs, "community-pairs")
    labels = stored(louvain(nodes, pairs, resolutions), "auto")
    counts = {x.r: x.n for x in labels.groupBy("r").agg(F.countDistinct("cluster").alias("n")).collect()}
    if not counts:
        return labels.select("node", "cluster", F.col("r").alias("resolution"))
    fits = [r for r in resolutions if least <= counts[float(r)] <= most]
    chosen = float(fits[0] if fits else min(resolutions, key=lambda r: abs(counts[float(r)] - near)))
    return merge_singletons(labels.where(F.col("r") == chosen).select("node", "cluster"), pairs).withColumn("resolution", F.lit(chosen))
