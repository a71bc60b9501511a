"""Queries over reach, centrality and chains. They have no oracle SQL: tests hold the operators against plain searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import centrality, graph
from weftline.plans.scores import _scores
from weftline.shared import stored

#: Origins of the approximated betweenness.
PIVOTS = 32


def _nodes(c):
    return c.base.select(F.col("sid").alias("node"))


def _mass(c):
    """At least 1: a session's complexity over 50."""
    return _scores(c).select(F.col("sid").alias("node"), F.greatest(F.lit(1.0), F.col("score") / 50).alias("mass"))


def _criticality(c):
    return centrality.criticality(stored(c.edges, "critical-edges"), _nodes(c), _mass(c))


def _curves(c):
    edges = stored(c.edges, "critical-edges")
    return centrality.amplitude_curve(edges, stored(centrality.criticality(edges, _nodes(c)), "critical")).withColumnRenamed("node", "sid")


def _composite(c):
    edges, nodes = stored(c.edges, "central-edges"), _nodes(c)
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("all")))).select("node", (F.col("n") / F.greatest(F.col("all") - 1, F.lit(1))).alias("degree"))
    parts = [(graph.page_rank(edges, nodes), "rank", 0.35), (centrality.betweenness(edges, nodes, PIVOTS).withColumnRenamed("value", "betweenness"), "betweenness", 0.25), (degree, "degree", 0.2), (graph.k_core(edges), "core", 0.2)]
    return centrality.composite_centrality(parts, nodes).withColumnRenamed("node", "sid")


def _chains(c):
    return stored(centrality.longest_chains(c.acyclic), "chains")


QUERIES = {
    "criticality": (lambda c: _criticality(c).withColumnRenamed("node", "sid"), None),
    "amplitude_curve": (_curves, None),
    "betweenness": (lambda c: centrality.betweenness(c.edges, _nodes(c), PIVOTS).select(F.col("node").alias("sid"), F.round("value", 9).alias("value")), None),
    "composite_centrality": (_composite, None),
    "longest_chains": (lambda c: _chains(c).select("chain_id", F.array_join("path", ",").alias("path"), "length"), None),
    "doc_chain": (lambda c: centrality.chain_documents(_chains(c), c.tiered), None),
}
