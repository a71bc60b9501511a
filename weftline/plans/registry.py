"""All registered queries of the lineage engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.catalog import Catalog
from weftline.plans import centrality, clusters, code, detail, documents, exported, flows, jobs, lineage, more, partitions, scores
from weftline.plans.oracle import oracle

_FAMILIES = (lineage.QUERIES, code.QUERIES, scores.QUERIES, jobs.QUERIES, more.QUERIES, detail.QUERIES, exported.QUERIES, flows.QUERIES, documents.QUERIES, centrality.QUERIES, partitions.QUERIES, clusters.QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["write_conflicts"](spark, sf_dir)


def _bind(build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Catalog(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for family in _FAMILIES for name, (build, _) in family.items()}


def oracle_sql() -> dict[str, str]:
    """A statement that begins with WITH is whole; others build on the catalog's expressions."""
    return {name: sql if sql.lstrip().upper().startswith("WITH ") else oracle(sql) for family in _FAMILIES for name, (_, sql) in family.items() if sql}
