"""Labels that grow from seeds or votes on a weighted graph (a, b, sim; each pair once), and k-means for all k side by side.

What looks random is a hash of names and rounds, so results are the same however rows are dealt out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import connected_components
from weftline.operators.partitions import chance, hierarchical_domains
from weftline.shared import stored


def _links(pairs: DataFrame) -> DataFrame:
    plain = pairs.where("a <> b").select("a", "b", F.col("sim").alias("w"))
    return stored(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "seeded-links")


def _votes(links: DataFrame, labels: DataFrame, draw: Column) -> DataFrame:
    """node, cluster (that of the greatest weight among neighbours, equals by ``draw``), best (its weight), own (weight of the node's own label)."""
    held = links.join(labels.select(F.col("node").alias("b"), "cluster"), "b").where("cluster is not null")
    votes = held.groupBy(F.col("a").alias("node"), "cluster").agg(F.round(F.sum("w"), 9).alias("v")).join(labels.select("node", F.col("cluster").alias("mine")), "node")
    best = votes.groupBy("node").agg(F.max(F.struct("v", draw.alias("draw"), "cluster")).alias("top"), F.max(F.when(F.col("cluster") == F.col("mine"), F.col("v"))).alias("own"))
    return best.select("node", F.col("top.cluster").alias("cluster"), F.col("top.v").alias("best"), F.coalesce("own", F.lit(0.0)).alias("own"))


def seeded_label_vote(nodes: DataFrame, pairs: DataFrame, rounds: int = 20, seed: int = 42) -> DataFrame:
    """node, cluster (its least node) by weighted votes of neighbours.

    All begin alone. In each of ``rounds`` rounds half of the nodes, drawn by a hash of name, round and seed, take the label of
    the greatest weight among their neighbours; equals are drawn, too. Rounds end early when no node would gain by another label.
    Nodes without a neighbour stay alone.
    """
    links = _links(pairs)
    labels = stored(nodes.select("node").distinct().select("node", F.col("node").alias("cluster")), "votes")
    for turn in range(rounds):
        found = stored(_votes(links, labels, F.xxhash64("cluster", "node", F.lit(turn), F.lit(seed))), "votes-cast")
        if not found.where("best > own").limit(1).count():
            break
        moved = found.where(chance("node", F.lit(turn), F.lit(seed)) < 0.5).select("node", F.col("cluster").alias("to"))
        labels = stored(labels.join(moved, "node", "left").select("node", F.coalesce("to", "cluster").alias("cluster")), "votes")
    names = labels.groupBy("cluster").agg(F.min("node").alias("least"))
    return labels.join(names, "cluster").select("node", F.col("least").alias("cluster"))


def seeded_k_communities(nodes: DataFrame, pairs: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """node, cluster (its least node): the largest component is shared out among ``k`` seeds, its nodes of most neighbours (by
    name among equals); every other component is a cluster.

    Seeds keep their labels. The others take the label of the greatest weight among their neighbours, at first by waves from the
    seeds; then half of those that gain by another label move in each round, until none gains. With fewer than two seeds the
    component is one cluster.
    """
    links = _links(pairs)
    parts = stored(connected_components(nodes.select("node").distinct(), links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "seeded-parts")
    top = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).collect()
    if not top or min(k, top[0].n) < 2:
        return parts.select("node", F.col("component").alias("cluster"))
    inside = parts.where(F.col("component") == top[0].component).select("node")
    degree = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")).join(inside, "node", "left_semi")
    seeds = stored(degree.orderBy(F.desc("d"), "node").limit(k).select("node", F.col("node").alias("first")), "seeds")
    labels = stored(inside.join(F.broadcast(seeds), "node", "left").select("node", F.col("first").alias("cluster"), F.col("first").isNotNull().alias("fixed")), "seeded")
    near = stored(links.join(inside.select(F.col("node").alias("a")), "a", "left_semi"), "seeded-near")
    turn = 0
    while True:
        wishes = _votes(near, labels, F.xxhash64("cluster", F.lit(seed))).where("best > own").withColumnRenamed("cluster", "to")
        wishes = stored(labels.join(wishes, "node").where("not fixed").select("node", "to", F.col("cluster").isNull().alias("new")), "seeded-wishes")
        if not wishes.limit(1).count():
            break
        moved = wishes.where(F.col("new") | (chance("node", F.lit(turn), F.lit(seed)) < 0.5))
        labels = stored(labels.join(moved.select("node", "to"), "node", "left").select("node", F.coalesce("to", "cluster").alias("cluster"), "fixed"), "seeded")
        turn += 1
    names = labels.groupBy("cluster").agg(F.min("node").alias("least"))
    shared = labels.join(names, "cluster").select("node", F.col("least").alias("cluster"))
    return shared.unionByName(parts.where(F.col("component") != top[0].component).select("node", F.col("component").alias("cluster")))


def _start(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows, each the furthest from those before; the first is the nearest to the mean."""
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmin())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _assign(x: np.ndarray, centres: dict[int, np.ndarray]):
    """k, nearest centre of each row, squared distance, for each k."""
    for k, c in centres.items():
        d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
        at = d.argmin(1)
        yield k, at, d[np.arange(len(x)), at]


def kmeans_elbow(points: DataFrame, k_max: int = 15, rounds: int = 40, tolerance: float = 1e-6, sample: int = 2000) -> DataFrame:
    """id, cluster (a number from 0), k of points (id, x array<double>): the k from 3 to the least of ``k_max`` and the root of half the
    points where the sum of squares falls most against k - 1 (the least of equals); 2 where it falls nowhere.

    Dimensions are scaled to 0 to 1 (constant ones to 0.5). All k run side by side: a round reads the points once, tasks sum
    by (k, centre), and some k_max^2 / 2 sums come to the driver. Centres start from ``sample`` points, the first by hash, each
    the furthest from those before. Points that are null, shorter than the longest, or hold nulls or non-finite numbers take no
    part; one point alone, or only equal ones, are cluster 0 of k 1.
    """
    good = points.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = stored(good.select("id", F.col("x").cast("array<double>").alias("x")), "elbow-points")
    ends = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("at").collect()
    rows = rows.where(F.size("x") == len(ends))
    n = rows.count()
    lo, hi = np.array([r.lo for r in ends]), np.array([r.hi for r in ends])
    width = np.where(hi > lo, hi - lo, 1.0)

    def scaled(lists) -> np.ndarray:
        x = np.array(lists, dtype=float).reshape(len(lists), len(lo))
        return np.where(hi > lo, (x - lo) / width, 0.5)

    drawn = rows.orderBy(chance(F.col("id").cast("string")), "id").limit(sample).collect()
    most = max(2, min(int((n / 2) ** 0.5), k_max))
    start = _start(scaled([r.x for r in drawn]), most) if drawn and len(lo) else np.zeros((0, 0))
    if len(start) < 2:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(1).alias("k"))
    centres = {k: start[:k].copy() for k in range(2, len(start) + 1)}

    def sums(now: dict[int, np.ndarray]):
        def run(batches):
            total = {k: (np.zeros((len(c), c.shape[1] + 2))) for k, c in now.items()}
            for batch in batches:
                x = scaled(batch.column("x").to_pylist())
                for k, at, d in _assign(x, now):
                    np.add.at(total[k], at, np.column_stack([x, np.ones(len(x)), d]))
            out = [(k, j, list(row)) for k, t in total.items() for j, row in enumerate(t)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["k", "j", "s"])

        parts = rows.select("x").mapInArrow(run, "k int, j int, s array<double>").select("k", "j", F.posexplode("s").alias("at", "v"))
        found = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in now.items()}
        for r in parts.groupBy("k", "j", "at").agg(F.sum("v").alias("v")).collect():
            found[r.k][r.j, r["at"]] = r.v
        return found

    cost, live = {}, dict(centres)
    for _ in range(rounds):
        found, moving = sums(live), {}
        for k, t in found.items():
            cost[k] = float(t[:, -1].sum())
            new = np.where(t[:, -2:-1] > 0, t[:, :-2] / np.maximum(t[:, -2:-1], 1), live[k])
            if np.abs(new - live[k]).max() > tolerance:
                moving[k] = new
            centres[k] = new
        live = moving
        if not live:
            break
    drops = {k: round(cost[k - 1] - cost[k], 9) for k in range(3, len(start) + 1)}
    best = max(drops, key=lambda k: (drops[k], -k)) if drops and max(drops.values()) > 0 else 2
    chosen = {best: centres[best]}

    def label(batches):
        for batch in batches:
            _, at, _ = next(_assign(scaled(batch.column("x").to_pylist()), chosen))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype("int32"))], ["id", "cluster"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(label, f"id {kind}, cluster int").withColumn("k", F.lit(best))


def gravity_groups(access: DataFrame, independents: DataFrame, target: int = 10) -> DataFrame:
    """sid, cluster (its least sid), k, silhouette: groups of the sessions that are not in ``independents`` (sid), by the tables
    they use; k up to ``target`` (half of the sessions at most) and four more, by silhouette."""
    rest = stored(access.join(independents.select("sid"), "sid", "left_anti"), "gravity-rest")
    n = rest.select("sid").distinct().count()
    return hierarchical_domains(rest, min(target, max(2, n // 2)) + 4)
