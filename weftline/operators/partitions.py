"""Clusters of a weighted graph (a, b, sim; each pair once) by messages, eigenvectors, walks and personalised ranks, of table
sets by bisection, and of several labellings by a spanning forest. No operator makes pairs that the graph does not have."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.graph import connected_components
from weftline.shared import stored


def _links(pairs: DataFrame) -> DataFrame:
    """a, b, w: each pair from both ends."""
    plain = pairs.where("a <> b").select("a", "b", F.col("sim").alias("w"))
    return plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _named(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, cluster: each cluster named by its least node; nodes without a label stay alone."""
    names = labels.groupBy("cluster").agg(F.min("node").alias("least"))
    of = labels.join(names, "cluster").select("node", "least")
    return nodes.select("node").distinct().join(of, "node", "left").select("node", F.coalesce("least", "node").alias("cluster"))


def chance(*parts) -> Column:
    """A number from 0 to 1 that depends on the given values alone."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)


def k_means(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """node, cluster (a number) of points (node, x array<double>)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select("node", array_to_vector("x").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("node", "cluster")


# -- exemplars ------------------------------------------------------------------------------------------------------


def exemplar_clusters(nodes: DataFrame, pairs: DataFrame, preference: float | None = None, damping: float = 0.5, rounds: int = 50, settled: int = 5, noise: float = 1e-9) -> DataFrame:
    """node, cluster (its exemplar) by passing messages on the graph's pairs.

    A row (i, k) holds what i asks of k (r) and what k offers i (a); pairs that the graph lacks are never exemplars of each other.
    Two windows a round, over a node's rows; rounds end when no exemplar has changed ``settled`` times. ``preference``:
    what a node asks of itself, by default the median similarity (to one part in 10,000). ``noise`` by hash of the pair parts
    equal similarities. A node whose neighbours are no exemplars is alone.
    """
    links = _links(pairs)
    if preference is None:
        preference = links.agg(F.percentile_approx("w", 0.5, 10_000)).first()[0]
    if preference is None:
        return nodes.select("node", F.col("node").alias("cluster"))
    asked = links.select(F.col("a").alias("i"), F.col("b").alias("k"), "w").unionByName(nodes.select(F.col("node").alias("i"), F.col("node").alias("k"), F.lit(float(preference)).alias("w")))
    state = stored(asked.select("i", "k", (F.col("w") + noise * chance("i", "k")).alias("s"), F.lit(0.0).alias("r"), F.lit(0.0).alias("a"), F.lit(False).alias("chosen")), "exemplars")
    by_i, by_k, quiet = Window.partitionBy("i"), Window.partitionBy("k"), 0
    for _ in range(rounds):
        v = F.col("a") + F.col("s")
        first = state.withColumn("v", v).withColumn("top", F.max(F.struct("v", "k")).over(by_i))
        rest = F.max(F.when(F.col("k") != F.col("top.k"), F.col("v"))).over(by_i)
        rival = F.when(F.col("k") == F.col("top.k"), rest).otherwise(F.col("top.v"))
        # a node with no pair asks all of itself
        heard = first.withColumn("r", damping * F.col("r") + (1 - damping) * (F.col("s") - F.coalesce(rival, F.lit(0.0))))
        mine = F.col("i") == F.col("k")
        glad = F.greatest(F.lit(0.0), F.col("r"))
        heard = heard.withColumn("sum", F.sum(F.when(~mine, glad)).over(by_k)).withColumn("own", F.max(F.when(mine, F.col("r"))).over(by_k)).withColumn("sum", F.coalesce("sum", F.lit(0.0)))
        offer = F.when(mine, F.col("sum")).otherwise(F.least(F.lit(0.0), F.col("own") + F.col("sum") - glad))
        heard = heard.withColumn("a", damping * F.col("a") + (1 - damping) * offer).withColumn("now", mine & (F.col("r") + F.col("a") > 0))
        state = stored(heard.select("i", "k", "s", "r", "a", F.col("now").alias("chosen"), (F.col("now") != F.col("chosen")).alias("turned")), "exemplars")
        quiet = 0 if state.where("turned").limit(1).count() else quiet + 1
        state = state.drop("turned")
        if quiet >= settled:
            break
    exemplars = state.where("chosen").select(F.col("i").alias("k"))
    best = state.where("i <> k").join(exemplars, "k", "left_semi").groupBy("i").agg(F.min(F.struct((-F.col("s")).alias("less"), "k")).alias("best"))
    own = exemplars.select(F.col("k").alias("i"), F.lit(True).alias("own"))
    return nodes.select(F.col("node").alias("i")).join(own, "i", "left").join(best, "i", "left").select(F.col("i").alias("node"), F.when(F.col("own"), F.col("i")).otherwise(F.coalesce("best.k", "i")).alias("cluster"))


# -- eigenvectors ---------------------------------------------------------------------------------------------------


def leading_vectors(links: DataFrame, m: int, rounds: int = 60, tolerance: float = 1e-5, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(node, x array of m numbers) and the m greatest eigenvalues of ``(I + D^-1/2 W D^-1/2) / 2`` of symmetric links (a, b, w).

    Block power iteration: a round joins the links to the vectors and sums by node; the m x m products of the vectors come
    to the driver, whose eigenvectors turn the block orthonormal again. Memory a node is m numbers.
    """
    degree = links.groupBy("a").agg(F.sum("w").alias("d"))
    other = degree.select(F.col("a").alias("b"), F.col("d").alias("e"))
    scaled = stored(links.join(degree, "a").join(other, "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("v")), "spectral-links")
    names = [f"x{k}" for k in range(m)]
    state = stored(degree.select(F.col("a").alias("node"), *[(chance("a", F.lit(seed), F.lit(k)) - 0.5).alias(n) for k, n in enumerate(names)]), "spectral")
    kinds = "node string, " + ", ".join(f"{n} double" for n in names)

    def products(df: DataFrame) -> np.ndarray:
        def run(batches):
            total = np.zeros((m, m))
            for batch in batches:
                x = np.stack([batch.column(n).to_numpy() for n in names], 1)
                total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(total.ravel())], ["at", "v"])

        found = df.select(*names).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(found, key=lambda r: r["at"])]).reshape(m, m) if found else np.zeros((m, m))

    def turned(df: DataFrame, by: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(n).to_numpy() for n in names], 1) @ by
                yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(m))], ["node", *names])

        return df.select("node", *names).mapInArrow(run, kinds)

    values = None
    for _ in range(rounds):
        squares, vectors = np.linalg.eigh(products(state))
        squares, vectors = squares[::-1], vectors[:, ::-1]
        scale = np.where(squares > 1e-24 * max(squares[0], 1e-300), 1 / np.sqrt(np.maximum(squares, 1e-300)), 0.0)
        vectors = vectors * np.where(np.sign(vectors[np.abs(vectors).argmax(0), np.arange(m)]) < 0, -1, 1)
        unit, found = turned(state, vectors * scale), np.sqrt(np.maximum(squares, 0))
        if values is not None and np.abs(found - values).max() < tolerance:
            break
        # from the second round on the block was orthonormal before it was multiplied, so lengths are eigenvalues
        values = found
        unit = stored(unit, "spectral-unit")
        sums = scaled.join(unit.withColumnRenamed("node", "b"), "b").groupBy("a").agg(*[F.sum(F.col("v") * F.col(n)).alias(f"s{n}") for n in names])
        state = stored(unit.join(sums, F.col("node") == F.col("a"), "left").select("node", *[((F.col(n) + F.coalesce(f"s{n}", F.lit(0.0))) / 2).alias(n) for n in names]), "spectral")
    return unit.select("node", F.array(*names).alias("x")), found


def spectral_clusters(nodes: DataFrame, pairs: DataFrame, k: int | None = None, k_max: int = 10, rounds: int = 60) -> DataFrame:
    """node, cluster (its least node): k-means on the rows of the leading eigenvectors, each row of length 1.

    ``k``: by default where the gap between neighbouring eigenvalues is greatest, from 2 to ``k_max``. Nodes without a pair are alone.
    """
    links = stored(_links(pairs), "spectral-pairs")
    if not links.limit(1).count():
        return nodes.select("node", F.col("node").alias("cluster"))
    # a block that is wider than k settles sooner
    vectors, values = leading_vectors(links, max(k or 0, k_max) + 2, rounds)
    if k is None:
        k = 2 + int(np.argmax(values[1:k_max] - values[2 : k_max + 1]))
    x = F.slice("x", 1, k)
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = stored(vectors.select("node", F.transform(x, lambda v: v / F.when(length > 0, length).otherwise(1.0)).alias("x")), "spectral-rows")
    return _named(k_means(rows, k), nodes)


# -- walks and personalised ranks -------------------------------------------------------------------------------------


def personal_ranks(links: DataFrame, landmarks: DataFrame, alpha: float = 0.85, epsilon: float = 1e-4) -> DataFrame:
    """landmark, node, rank: the share of a walk from the landmark (column node) that ends at the node, where it goes on with chance ``alpha``.

    Forward push from all landmarks at once: rows hold a rank and a residue; a residue over ``epsilon`` times the node's degree is
    paid out. What stays is under that, so in the end a rank is at most ``epsilon`` times the node's degree too small, and the rows of
    a landmark are at most ``1 / ((1 - alpha) * epsilon)`` over the least degree.
    """
    degree = links.groupBy("a").agg(F.sum("w").alias("d"))
    shares = stored(links.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).alias("share")), "push-links")
    degree = stored(degree.select(F.col("a").alias("node"), "d"), "push-degree")
    start = landmarks.select(F.col("node").alias("landmark"), "node", F.lit(0.0).alias("rank"), F.lit(1.0).alias("rest"))
    state = stored(start.join(degree, "node").select("landmark", "node", "d", "rank", "rest", (F.col("rest") > epsilon * F.col("d")).alias("due")), "push")
    while state.where("due").limit(1).count():
        due = state.where("due")
        sent = due.join(shares, due.node == shares.a).select("landmark", F.col("b").alias("node"), F.lit(0.0).alias("rank"), (alpha * F.col("rest") * F.col("share")).alias("rest"))
        kept = state.select("landmark", "node", F.when(F.col("due"), F.col("rank") + (1 - alpha) * F.col("rest")).otherwise(F.col("rank")).alias("rank"), F.when(F.col("due"), 0.0).otherwise(F.col("rest")).alias("rest"))
        sums = kept.unionByName(sent).groupBy("landmark", "node").agg(F.sum("rank").alias("rank"), F.sum("rest").alias("rest"))
        state = stored(sums.join(degree, "node").select("landmark", "node", "d", "rank", "rest", (F.col("rest") > epsilon * F.col("d")).alias("due")), "push")
    return state.where("rank > 0").select("landmark", "node", "rank")


def ppr_clusters(nodes: DataFrame, pairs: DataFrame, k: int = 10, alpha: float = 0.85, landmarks: int = 500, epsilon: float = 1e-4) -> DataFrame:
    """node, cluster (its least node): k-means on the personalised ranks of up to ``landmarks`` nodes (the first by hash), each
    row over its length. Nodes that no landmark reaches are alone."""
    links = stored(_links(pairs), "push-pairs")
    chosen = stored(links.select(F.col("a").alias("node")).distinct().orderBy(chance("node"), "node").limit(landmarks), "landmarks")
    place = {r.node: k for k, r in enumerate(chosen.orderBy("node").collect())}
    if not place:
        return nodes.select("node", F.col("node").alias("cluster"))
    ranks = personal_ranks(links, chosen, alpha, epsilon)
    where = F.broadcast(nodes.sparkSession.createDataFrame(list(place.items()), "landmark string, at int"))
    held = ranks.join(where, "landmark").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("m"), F.sqrt(F.sum(F.col("rank") * F.col("rank"))).alias("length"))
    # at most ``landmarks`` numbers a node
    rows = stored(held.select("node", F.transform(F.sequence(F.lit(0), F.lit(len(place) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("length")).alias("x")), "rank-rows")
    return _named(k_means(rows, min(k, max(2, len(place)))), nodes)


def random_walks(links: DataFrame, walks: int = 10, length: int = 10, seed: int = 42) -> DataFrame:
    """start, walk, step, node: weighted walks from every node on a link. The next node is read off a hash of (start, walk, step) in the
    sums of the neighbours' weights, so walks are the same however rows are dealt out."""
    order = Window.partitionBy("a").orderBy("b")
    upto, total = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("w").over(Window.partitionBy("a"))
    last = F.lead("b").over(order).isNull()
    table = links.select("a", "b", ((upto - F.col("w")) / total).alias("low"), F.when(last, F.lit(1.0)).otherwise(upto / total).alias("high"))
    # neighbours meet: the end of one is the start of the next
    table = stored(table.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))), "walk-table")
    at = stored(links.select(F.col("a").alias("start")).distinct().select("start", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.lit(0).alias("step"), F.col("start").alias("node")), "walks")
    out = [at]
    for step in range(1, length):
        drawn = at.withColumn("u", chance("start", "walk", F.lit(step), F.lit(seed)))
        met = drawn.join(table, (drawn.node == table.a) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        at = stored(met.select("start", "walk", F.lit(step).alias("step"), F.col("b").alias("node")), "walks")
        out.append(at)
    return reduce(DataFrame.unionByName, out)


def walk_embeddings(nodes: DataFrame, pairs: DataFrame, dims: int = 32, length: int = 10, walks: int = 10, window: int = 5, k: int = 10, rounds: int = 15) -> DataFrame:
    """node, vector, cluster: nodes that walks meet together lie together.

    Pairs of nodes within ``window`` steps of a walk are counted, weighed by how much more often they meet than by chance (the
    positive logarithm), and factorised by block power iteration; k-means gives clusters, named by their least node. Nodes without
    a pair have no vector and are alone.
    """
    steps = random_walks(stored(_links(pairs), "walk-links"), walks, length)
    path = steps.groupBy("start", "walk").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("path"))
    ends = path.select(F.posexplode(F.transform("path", lambda x: x["node"])).alias("at", "a"), F.transform("path", lambda x: x["node"]).alias("all"))
    near = ends.select("a", F.explode(F.expr(f"slice(all, greatest(at - {window} + 1, 1), at + 1 + {window} - greatest(at - {window} + 1, 1) + 1)")).alias("b")).where("a <> b")
    counts = stored(near.groupBy("a", "b").agg(F.count("*").alias("n")), "walk-counts")
    if not counts.limit(1).count():
        return nodes.select("node", F.lit(None).cast("array<double>").alias("vector"), F.col("node").alias("cluster"))
    each = counts.groupBy("a").agg(F.sum("n").alias("na"))
    total = counts.agg(F.sum("n")).first()[0]
    weighed = counts.join(each, "a").join(each.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").select("a", "b", F.log(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb"))).alias("w")).where("w > 0")
    vectors, values = leading_vectors(stored(weighed, "walk-weights"), dims, rounds)
    scale = F.array(*[F.lit(float(v)) for v in values])
    rows = stored(vectors.select("node", F.zip_with("x", scale, lambda x, s: x * s).alias("x")), "walk-vectors")
    length_ = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = rows.select("node", F.transform("x", lambda v: v / F.when(length_ > 0, length_).otherwise(1.0)).alias("x"))
    return _named(k_means(unit, k), nodes).join(rows.select("node", F.col("x").alias("vector")), "node", "left").select("node", "vector", "cluster")


def walk_probabilities(links: DataFrame, t: int = 4, least: float = 1e-4) -> DataFrame:
    """node, to, p: the chance to be at ``to`` after ``t`` steps from the node; chances under ``least`` are cut after each step, so a node has at
    most ``1 / least`` rows and what it lacks of 1 is what was cut."""
    degree = links.groupBy("a").agg(F.sum("w").alias("d"))
    step = stored(links.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).alias("q")), "steps")
    now = stored(step.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("q").alias("p")).where(F.col("p") >= least), "walk-chances")
    for _ in range(t - 1):
        met = now.join(step, F.col("to") == F.col("a")).groupBy("node", "b").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        now = stored(met.select("node", F.col("b").alias("to"), "p").where(F.col("p") >= least), "walk-chances")
    return now


def walk_clusters(nodes: DataFrame, pairs: DataFrame, t: int = 4, k: int = 15, least: float = 1e-4, dims: int = 256) -> DataFrame:
    """node, cluster (its least node): bisecting k-means on where walks of ``t`` steps end, each chance over the root of the end's
    degree; ends are hashed to ``dims`` signed places, so a row has a bounded size. Nodes without a pair are alone."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    links = stored(_links(pairs), "walk-links")
    if not links.limit(1).count():
        return nodes.select("node", F.col("node").alias("cluster"))
    degree = links.groupBy(F.col("a").alias("to")).agg(F.sum("w").alias("d"))
    sign = F.when(F.pmod(F.xxhash64("to", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    ends = walk_probabilities(links, t, least).join(degree, "to").groupBy("node", F.pmod(F.xxhash64("to"), F.lit(dims)).cast("int").alias("at")).agg(F.sum(sign * F.col("p") / F.sqrt("d")).alias("v"))
    held = ends.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    rows = stored(held.select("node", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x")), "walk-rows")
    points = rows.select("node", array_to_vector("x").alias("features"))
    model = BisectingKMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster").fit(points)
    return _named(model.transform(points).select("node", "cluster"), nodes)


# -- several labellings ---------------------------------------------------------------------------------------------


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, w: a heaviest spanning forest of the weighted graph, by rounds in which each tree takes its heaviest edge to another tree (the
    first by names among equals, so no circle forms)."""
    edges = stored(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w")), "forest-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    trees, taken = stored(nodes.select("node", F.col("node").alias("component")), "trees"), edges.limit(0)
    while True:
        of = lambda end: trees.select(F.col("node").alias(end), F.col("component").alias(f"{end}t"))
        across = stored(edges.join(of("a"), "a").join(of("b"), "b").where("at <> bt"), "forest-edges")
        if not across.limit(1).count():
            return taken
        order = F.struct((-F.col("w")).alias("less"), "a", "b")
        best = across.select(F.explode(F.array("at", "bt")).alias("tree"), "a", "b", "w", order.alias("order")).groupBy("tree").agg(F.min(F.struct("order", "w")).alias("best"))
        fresh = stored(best.select(F.col("best.order.a").alias("a"), F.col("best.order.b").alias("b"), F.col("best.w").alias("w")).distinct(), "forest")
        taken = taken.unionByName(fresh)
        links = stored(fresh.join(of("a"), "a").join(of("b"), "b").select(F.col("at").alias("src"), F.col("bt").alias("dst")), "forest-links")
        joined = connected_components(trees.select(F.col("component").alias("node")).distinct(), links)
        trees = stored(trees.join(joined.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("node", F.col("up").alias("component")), "trees")
        edges = across.select("a", "b", "w")


def consensus_clusters(labelings: list[DataFrame], k: int | None = None) -> DataFrame:
    """sid, cluster (its least sid), score, contested, confident of the labellings (sid, cluster each).

    Sessions with equal labels everywhere are one profile, so work grows with profiles. Two profiles' weight is the share of
    labellings that agree on them. Profiles that agree on a set of labellings are linked to the first of them only: these stars
    hold a heaviest spanning forest. Its weakest edges are cut until ``k`` clusters are left (default: the median number of labels, 2 at
    least; more where fewer links than that exist, fewer where there are fewer profiles). score: the mean agreement with the cluster's other members, from counts of
    labels; contested under 0.5, confident over 0.8; alone: 1. A session that a labelling lacks agrees with none there.
    """
    names = [f"c{j}" for j in range(len(labelings))]
    rows = reduce(DataFrame.unionByName, [x.select("sid") for x in labelings]).distinct()
    for name, x in zip(names, labelings, strict=True):
        rows = rows.join(x.select("sid", F.col("cluster").cast("string").alias(name)), "sid", "left")
    key = F.sha2(F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), n), F.concat(F.lit("?"), F.col("sid"))).alias(n) for n in names])), 256)
    rows = stored(rows.withColumn("profile", key), "consensus")
    profiles = stored(rows.groupBy("profile").agg(F.min("sid").alias("lead"), *[F.min(n).alias(n) for n in names]), "profiles")
    stars = []
    for size in range(len(names), 0, -1):
        for some in combinations(names, size):
            held = profiles.where(" and ".join(f"{n} is not null" for n in some))
            hub = held.groupBy(*some).agg(F.min("lead").alias("hub"))
            stars.append(held.join(hub, list(some)).where("hub <> lead").select(F.col("hub").alias("a"), F.col("lead").alias("b")))
    links = stored(reduce(DataFrame.unionByName, stars).distinct(), "stars")
    of = lambda end: profiles.select(F.col("lead").alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names])
    agree = sum(F.coalesce((F.col(f"a_{n}") == F.col(f"b_{n}")).cast("int"), F.lit(0)) for n in names)
    forest = stored(spanning_forest(links.join(of("a"), "a").join(of("b"), "b").select("a", "b", (agree / len(names)).alias("w"))), "consensus-forest")
    if k is None:
        counts = sorted(x.select("cluster").distinct().count() for x in labelings)
        middle = len(counts) // 2
        k = max(2, counts[middle] if len(counts) % 2 else (counts[middle - 1] + counts[middle]) // 2)
    trees = profiles.count() - forest.count()
    cut = forest.orderBy("w", F.desc("a"), F.desc("b")).limit(max(0, k - trees)).select("a", "b")  # at most k rows
    kept = forest.join(cut, ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = connected_components(profiles.select(F.col("lead").alias("node")), kept)
    labels = rows.join(profiles.select("profile", "lead"), "profile").join(groups.select(F.col("node").alias("lead"), F.col("component").alias("group")), "lead")
    labels = stored(labels.select("sid", "group", *names), "consensus-labels")
    size = labels.groupBy("group").agg(F.count("*").alias("size"), F.min("sid").alias("cluster"))
    scored = labels.join(size, "group")
    for n in names:
        scored = scored.join(labels.where(F.col(n).isNotNull()).groupBy("group", n).agg(F.count("*").alias(f"n_{n}")), ["group", n], "left")
    total = sum(F.coalesce(F.col(f"n_{n}") - 1, F.lit(0)) for n in names)
    mean = F.when(F.col("size") > 1, total / (len(names) * (F.col("size") - 1))).otherwise(1.0)
    return scored.select("sid", "cluster", F.round(mean, 6).alias("score"), (mean < 0.5).alias("contested"), (mean > 0.8).alias("confident"))


# -- table sets -----------------------------------------------------------------------------------------------------


def _unit_rows(held: DataFrame) -> DataFrame:
    """sid, tname, x: a session's tables as a vector of length 1."""
    size = held.groupBy("sid").agg(F.count("*").alias("n"))
    return held.join(size, "sid").select("sid", "tname", (1 / F.sqrt("n")).alias("x"))


def _centres(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tname, m: mean vectors; a session without a table of its cluster counts 0 there."""
    size = labels.groupBy(*keys).agg(F.count("*").alias("size"))
    return rows.join(labels, "sid").groupBy(*keys, "tname").agg(F.sum("x").alias("sum")).join(size, keys).select(*keys, "tname", (F.col("sum") / F.col("size")).alias("m"), "size")


def bisections(rows: DataFrame, k_max: int, rounds: int = 8) -> DataFrame:
    """sid, path: a tree of two-means splits, all clusters of a level at once; path has a digit 0 or 1 for each split on the way.

    A split begins with the member that is nearest its cluster's mean, and the one that is furthest from that member, by name among
    equals; distances need a member's own tables only, as all rows have length 1.
    """
    labels = stored(rows.select("sid").distinct().withColumn("path", F.lit("")), "bisect")
    depth = max(1, (k_max - 1).bit_length() + 1)
    for _ in range(depth):
        open_ = labels.groupBy("path").agg(F.count("*").alias("size")).where("size > 1").select("path")
        inside = stored(labels.join(open_, "path", "left_semi"), "bisect-open")
        if not inside.limit(1).count():
            break
        mean = _centres(rows, inside, ["path"])
        near = rows.join(inside, "sid").join(mean, ["path", "tname"]).groupBy("path", "sid").agg(F.round(F.sum(F.col("x") * F.col("m")), 9).alias("dot"))
        first = stored(near.groupBy("path").agg(F.min(F.struct((-F.col("dot")).alias("less"), "sid")).alias("best")).select("path", F.col("best.sid").alias("lead")), "bisect-first")
        lead = rows.join(first.withColumnRenamed("lead", "sid"), "sid").select("path", "tname", F.col("x").alias("m"))
        apart = inside.join(rows, "sid").join(lead, ["path", "tname"], "left").groupBy("path", "sid").agg(F.round(F.sum(F.coalesce(F.col("x") * F.col("m"), F.lit(0.0))), 9).alias("dot"))
        second = apart.join(first, "path").where("sid <> lead").groupBy("path").agg(F.min(F.struct("dot", "sid")).alias("best")).select("path", F.col("best.sid").alias("sid"), F.lit("1").alias("side"))
        seeds = first.select("path", F.col("lead").alias("sid"), F.lit("0").alias("side")).unionByName(second)
        centres = stored(rows.join(seeds, "sid").select("path", "side", "tname", F.col("x").alias("m")), "bisect-centres")
        sides = None
        for _ in range(rounds):
            square = centres.groupBy("path", "side").agg(F.sum(F.col("m") * F.col("m")).alias("sq"))
            dots = inside.join(rows, "sid").join(centres, ["path", "tname"]).groupBy("path", "sid", "side").agg(F.sum(F.col("x") * F.col("m")).alias("dot"))
            both = inside.join(square, "path").join(dots, ["path", "sid", "side"], "left").select("path", "sid", "side", F.round(F.col("sq") - 2 * F.coalesce("dot", F.lit(0.0)), 9).alias("far"))
            now = stored(both.groupBy("path", "sid").agg(F.min(F.struct("far", "side")).alias("best")).select("path", "sid", F.col("best.side").alias("side")), "bisect-sides")
            moved = True if sides is None else bool(now.join(sides.withColumnRenamed("side", "was"), ["path", "sid"]).where("side <> was").limit(1).count())
            sides = now
            if not moved:
                break
            centres = stored(_centres(rows, now, ["path", "side"]).select("path", "side", "tname", "m"), "bisect-centres")
        labels = stored(labels.join(sides.select("sid", "side"), "sid", "left").select("sid", F.concat("path", F.coalesce("side", F.lit(""))).alias("path")), "bisect")
    return labels


def silhouettes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """k, silhouette: the mean over sessions of (b - a) / max(a, b), from squared distances to all members of the own (a) and of the
    nearest other cluster (b); ``labels``: k, sid, cluster.

    The mean squared distance of a row of length 1 to a cluster is 2 - 2 times its product with the cluster's mean (less the row itself in its
    own), so sums of clusters do and no pair is made. A cluster that shares no table is at distance 2.
    """
    size = labels.groupBy("k", "cluster").agg(F.count("*").alias("n"))
    mean = rows.join(labels, "sid").groupBy("k", "cluster", "tname").agg(F.sum("x").alias("s"))
    dots = labels.withColumnRenamed("cluster", "own").join(rows, "sid").join(mean, ["k", "tname"]).groupBy("k", "sid", "own", "cluster").agg(F.sum(F.col("x") * F.col("s")).alias("dot"))
    met = dots.join(size, ["k", "cluster"])
    here = F.col("own") == F.col("cluster")
    far = F.when(here, F.when(F.col("n") > 1, (2 * (F.col("n") - 1) - 2 * (F.col("dot") - 1)) / (F.col("n") - 1))).otherwise(2 - 2 * F.col("dot") / F.col("n"))
    seen = met.withColumn("far", F.greatest(F.lit(0.0), far)).groupBy("k", "sid").agg(F.max(F.when(here, F.col("far"))).alias("a"), F.max(F.when(here, F.col("n"))).alias("n"), F.min(F.when(~here, F.col("far"))).alias("b"))
    b = F.least(F.coalesce("b", F.lit(2.0)), F.lit(2.0))
    value = F.when((F.col("n") == 1) | (F.greatest("a", b) <= 0), 0.0).otherwise((b - F.col("a")) / F.greatest("a", b))
    return seen.groupBy("k").agg(F.round(F.avg(value), 6).alias("silhouette"))


def hierarchical_domains(access: DataFrame, k_max: int = 20) -> DataFrame:
    """sid, cluster (its least sid), k, silhouette: domains of sessions by the tables they use.

    The splits of a bisecting tree are taken in order of how much they lessen the squares (parents before children), which gives a
    labelling for each k from 2 to ``k_max`` (half the sessions at most); the one of the greatest silhouette is returned, the smaller k
    among equals. One session: alone. No access: no rows.
    """
    rows = stored(_unit_rows(access.select("sid", "tname").distinct()), "domain-rows")
    n = rows.select("sid").distinct().count()
    k_max = min(k_max, max(2, n // 2))
    alone = rows.select("sid").distinct().select("sid", F.min("sid").over(Window.partitionBy(F.col("sid"))).alias("cluster"), F.lit(1).alias("k"), F.lit(0.0).alias("silhouette"))
    if n < 2:
        return alone
    leaves = bisections(rows, k_max)
    depth = leaves.agg(F.max(F.length("path"))).first()[0]
    # all inner nodes of the tree: what a split lessens is |sum 0|^2 / n0 + |sum 1|^2 / n1 - |sum|^2 / n
    at = stored(leaves.select("sid", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("d"), "path").select("sid", F.expr("substring(path, 1, d)").alias("path")), "domain-tree")
    weight = rows.join(at, "sid").groupBy("path", "tname").agg(F.sum("x").alias("s")).groupBy("path").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    sums = {r.path: r.sq / r.n for r in weight.join(at.groupBy("path").agg(F.count("*").alias("n")), "path").collect()}  # 2 ** (depth + 1) at most
    gains = {p: sums[p + "0"] + sums[p + "1"] - sums[p] for p in sums if p + "0" in sums and p + "1" in sums}
    splits, ready = [], [""] if "" in gains else []
    while ready and len(splits) < k_max - 1:
        best = max(sorted(ready), key=lambda p: round(gains[p], 9))
        ready.remove(best)
        splits.append(best)
        ready += [c for c in (best + "0", best + "1") if c in gains]
    if not splits:
        return alone
    step = {p: j for j, p in enumerate(splits)}
    # with k clusters the first k - 1 splits hold; a session is at the end of those on its way
    ways = leaves.select("path").distinct().collect()
    table = [(w.path, k, next((w.path[:d] for d in range(depth + 1) if step.get(w.path[:d], k_max) >= k - 1), w.path)) for w in ways for k in range(2, len(splits) + 2)]
    of = F.broadcast(leaves.sparkSession.createDataFrame(table, "path string, k int, cluster string"))
    labels = stored(leaves.join(of, "path").select("k", "sid", "cluster"), "domain-labels")
    found = silhouettes(rows, labels).collect()
    best = min(found, key=lambda r: (-r.silhouette, r.k))
    chosen = labels.where(F.col("k") == best.k)
    names = chosen.groupBy("cluster").agg(F.min("sid").alias("least"))
    return chosen.join(names, "cluster").select("sid", F.col("least").alias("cluster"), F.lit(best.k).alias("k"), F.lit(best.silhouette).alias("silhouette"))


def cluster_table_gravity(access: DataFrame, sessions: DataFrame, max_anchors: int = 100, fallback: int = 20, small: int = 3) -> DataFrame:
    """sid, cluster, anchor: sessions around the most used tables.

    Anchors are the tables of at least max(2, 0.5 % of the sessions), the first ``max_anchors`` by use and name (if none, the first ``fallback`` of at
    least 2). A session is at its most used anchor; one without an anchor is with the anchor whose sessions share most of its tables
    (the most used among equals), or in ``__other__``. Clusters of fewer than ``small`` sessions join the large cluster whose tables
    they share most; without any they stay. Clusters do not grow while sessions are assigned, so order does not matter.
    """
    held = stored(access.select("sid", "tname").distinct(), "gravity-held")
    n = sessions.count()
    refs = held.groupBy("tname").agg(F.count("*").alias("refs"))
    order = [F.desc("refs"), F.asc("tname")]
    anchors = [r.tname for r in refs.where(F.col("refs") >= max(2, int(n * 0.005))).orderBy(*order).limit(max_anchors).collect()]
    anchors = anchors or [r.tname for r in refs.where("refs >= 2").orderBy(*order).limit(fallback).collect()]
    if not anchors:
        return sessions.select("sid", F.col("sid").alias("cluster"), F.lit(None).cast("string").alias("anchor"))
    ranks = F.broadcast(held.sparkSession.createDataFrame([(t, k) for k, t in enumerate(anchors)], "tname string, place int"))
    placed = stored(sessions.select("sid").join(held.join(ranks, "tname").groupBy("sid").agg(F.min("place").alias("place")), "sid", "left"), "gravity")
    near = stored(held.join(placed.where("place is not null"), "sid").select("place", "tname").distinct(), "gravity-tables")
    rest = held.join(placed.where("place is null").select("sid"), "sid").join(near, "tname").groupBy("sid", "place").agg(F.count("*").alias("shared")).groupBy("sid").agg(F.min(F.struct((-F.col("shared")).alias("less"), "place")).alias("best"))
    labels = stored(placed.join(rest, "sid", "left").select("sid", F.coalesce("place", "best.place", F.lit(-1)).alias("place")), "gravity")
    tables = stored(held.join(labels, "sid").select("place", "tname").distinct(), "gravity-tables")
    sizes = labels.groupBy("place").agg(F.count("*").alias("size"))
    large = F.broadcast(sizes.where(f"size >= {small}").select(F.col("place").alias("to")))
    tiny = F.broadcast(sizes.where(f"size < {small} and place >= 0").select("place"))
    met = tables.join(tiny, "place").join(tables.select(F.col("place").alias("to"), "tname").join(large, "to"), "tname").groupBy("place", "to").agg(F.count("*").alias("shared"))
    moves = met.groupBy("place").agg(F.min(F.struct((-F.col("shared")).alias("less"), F.when(F.col("to") < 0, 1 << 30).otherwise(F.col("to")).alias("order"), "to")).alias("best")).select("place", F.col("best.to").alias("to"))
    names = F.broadcast(held.sparkSession.createDataFrame([(k, t) for k, t in enumerate(anchors)], "at int, anchor string"))
    final = labels.join(F.broadcast(moves), "place", "left").select("sid", F.coalesce("to", "place").alias("at")).join(names, "at", "left")
    return final.select("sid", F.coalesce("anchor", F.lit("__other__")).alias("cluster"), "anchor")
