"""Projections, filters, pages, layouts and per-group views of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.ranking import positions
from weftline.operators.usage import endpoints


def norm_table_name(name: Column, lookup: bool = False) -> Column:
    """Trimmed upper-case name without connection, database or owner prefix, brackets and quotes."""
    out = F.upper(F.trim(name))
    out = F.element_at(F.split(out, "[/:.]"), -1)
    out = F.regexp_replace(out, r"[\[\]\"'`]", "")
    return F.substring_index(out, "@", 1) if lookup else out


def display_name(name: Column, mode: str) -> Column:
    """full; smart: without the leading s_m_ or wf_; short: the last three parts between underscores."""
    if mode == "smart":
        return F.regexp_replace(name, "^(s_m_|s_|m_|wf_)", "")
    if mode == "short":
        parts = F.split(name, "_")
        return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), "_")
    return name


def filter_tiers(sessions: DataFrame, connections: DataFrame, hidden_tiers: list[int], hidden_types: list[str], search: str) -> DataFrame:
    """from_id, to_id, conn_type of edges whose session survives; tables always do."""
    kept = sessions.where(~F.col("tier").isin(*hidden_tiers) & F.contains(F.lower("name"), F.lit(search.lower()))).select("sid")
    edges = connections.where(~F.col("conn_type").isin(*hidden_types))
    a = edges.join(kept, edges.from_id == kept.sid, "left_semi")
    return a.unionByName(edges.join(kept, edges.to_id == kept.sid, "left_semi"))


def filter_graph(sessions: DataFrame, connections: DataFrame, low: int, high: int, min_degree: int, conflicts_only: bool) -> DataFrame:
    """sid, transforms, degree of sessions in a transform range with enough edges."""
    degree = endpoints(connections).groupBy("node_id").agg(F.count("*").alias("degree"), F.count_if(F.col("conn_type").isin("write_conflict", "read_after_write")).alias("conflicts"))
    rows = sessions.where(F.col("transforms").between(low, high)).join(degree, F.col("sid") == F.col("node_id")).where(F.col("degree") >= min_degree)
    return (rows.where("conflicts > 0") if conflicts_only else rows).select("sid", "transforms", "degree")


def isolate_neighbours(connections: DataFrame, node: str) -> DataFrame:
    out = connections.where(F.col("from_id") == node).select(F.col("to_id").alias("node_id"))
    return out.union(connections.where(F.col("to_id") == node).select("from_id")).union(connections.sparkSession.createDataFrame([(node,)], "node_id string")).distinct()


def scope_subgraph(tables: DataFrame, connections: DataFrame, sids: DataFrame) -> DataFrame:
    """Tables on edges that touch the given sessions."""
    touching = connections.join(sids, F.col("from_id") == F.col("sid"), "left_semi").select(F.col("to_id").alias("tname"))
    touching = touching.union(connections.join(sids, F.col("to_id") == F.col("sid"), "left_semi").select("from_id"))
    return tables.join(touching, "tname", "left_semi")


def search_page(rows: DataFrame, search: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the rows whose name holds the text, whatever its case."""
    return rows.where(F.contains(F.lower("name"), F.lit(search.lower()))).orderBy(*order).offset(offset).limit(limit)


def global_search(sessions: DataFrame, tables: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """kind, name: sessions, then tables, then workflows whose name holds the text of two characters or more."""
    holds = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    found = sessions.where(holds("name")).select(F.lit(1).alias("p"), F.lit("session").alias("kind"), "name")
    found = found.unionByName(tables.where(holds("tname")).select(F.lit(2).alias("p"), F.lit("table").alias("kind"), F.col("tname").alias("name")))
    found = found.unionByName(sessions.where(holds("workflow")).select(F.lit(3).alias("p"), F.lit("workflow").alias("kind"), F.col("workflow").alias("name")).distinct())
    return found.where(F.lit(len(text) >= 2)).orderBy("p", "name").limit(limit).select("kind", "name")


def explorer_detail(sessions: DataFrame, connections: DataFrame) -> DataFrame:
    """sid, conflict_count, chain_count, total_connections."""
    n = endpoints(connections).groupBy("node_id").agg(F.count_if(F.col("conn_type").isin("write_conflict", "read_after_write")).alias("c"), F.count_if(F.col("conn_type") == "chain").alias("h"), F.count("*").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sessions.select("sid").join(n, F.col("sid") == F.col("node_id"), "left").select("sid", zero("c").alias("conflict_count"), zero("h").alias("chain_count"), zero("t").alias("total_connections"))


def exec_order(sessions: DataFrame, connections: DataFrame) -> DataFrame:
    """position, sid, has_conflict, has_chain by (step, tier, sid)."""
    flags = endpoints(connections).groupBy("node_id").agg(F.bool_or(F.col("conn_type").isin("write_conflict", "read_after_write")).alias("x"), F.bool_or(F.col("conn_type") == "chain").alias("y"))
    no = F.lit(False)
    placed = positions(sessions.select("sid", "step", "tier"), ["step", "tier", "sid"])
    return placed.join(flags, F.col("sid") == F.col("node_id"), "left").select("position", "sid", F.coalesce("x", no).alias("has_conflict"), F.coalesce("y", no).alias("has_chain"))


def session_ids(sessions: DataFrame) -> DataFrame:
    return positions(sessions.select("sid", "tier", "step", "name"), ["tier", "step", "name"]).select("sid", F.concat(F.lit("S"), F.col("position") + 1).alias("display_id"))


def matrix_cells(sessions: DataFrame, tables: DataFrame, connections: DataFrame) -> DataFrame:
    """sid, name, tname, conn_type of every session x table cell that holds an edge."""
    s, t = sessions.select("sid", "name"), tables.select("tname")
    out = connections.join(s, F.col("from_id") == F.col("sid")).join(t, F.col("to_id") == F.col("tname"))
    back = connections.join(s, F.col("to_id") == F.col("sid")).join(t, F.col("from_id") == F.col("tname"))
    return out.unionByName(back).select("sid", "name", "tname", "conn_type").distinct()


def tier_groups(sessions: DataFrame, tables: DataFrame) -> DataFrame:
    rows = sessions.select(F.col("tier").cast("double").alias("tier"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(tables.select("tier", F.lit(0).alias("s"), F.lit(1).alias("t")))
    return rows.groupBy("tier").agg(F.sum("s").alias("sessions"), F.sum("t").alias("tables"))


def folder_metrics(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("folder").agg(F.count("*").alias("sessions"), F.countDistinct("workflow").alias("workflows"), F.round(F.avg("tier"), 6).alias("avg_tier"), F.count_if("critical").alias("critical"))


def workflow_rollup(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """workflow, sessions, links: dependency edges inside a workflow are its task links."""
    w = sessions.select("sid", "workflow")
    links = edges.join(w.select(F.col("sid").alias("src"), F.col("workflow").alias("a")), "src").join(w.select(F.col("sid").alias("dst"), F.col("workflow").alias("b")), "dst").where("a = b").groupBy(F.col("a").alias("workflow")).agg(F.count("*").alias("links"))
    return sessions.groupBy("workflow").agg(F.count("*").alias("sessions")).join(links, "workflow", "left").select("workflow", "sessions", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def catalog_stats(sessions: DataFrame, tables: DataFrame, connections: DataFrame) -> DataFrame:
    s = sessions.agg(F.count("*").alias("sessions"), F.max("tier").alias("max_tier"))
    t = tables.agg(F.count_if(F.col("type") == "conflict").alias("conflicts"), F.count_if(F.col("type") == "chain").alias("chains"), F.count_if(F.col("type") == "source").alias("source_tables"))
    c = connections.agg(F.count_if(F.col("conn_type") == "lookup_stale").alias("stale"))
    return s.crossJoin(t).crossJoin(c)  # one row each


def galaxy_layout(sessions: DataFrame) -> DataFrame:
    """node_id, x, y, size: around a circle of radius 100 x tier by rank, size from transforms."""
    n, rank = F.count("*").over(Window.partitionBy("tier")), F.row_number().over(Window.partitionBy("tier").orderBy("sid")) - 1
    angle = F.lit(2 * 3.141592653589793) * rank / n
    return sessions.select(F.col("sid").alias("node_id"), (F.round(100 * F.col("tier") * F.cos(angle), 4) + 0.0).alias("x"), (F.round(100 * F.col("tier") * F.sin(angle), 4) + 0.0).alias("y"), F.least(F.greatest("transforms", F.lit(1)), F.lit(10)).cast("long").alias("size"))


def tier_layout(sessions: DataFrame, tables: DataFrame) -> DataFrame:
    s = sessions.select(F.col("sid").alias("node_id"), F.lit("session").alias("kind"), F.col("tier").cast("double").alias("band"), F.col("critical").alias("flag"))
    return s.unionByName(tables.select(F.col("tname").alias("node_id"), F.col("type").alias("kind"), F.col("tier").alias("band"), (F.col("type") == "conflict").alias("flag")))


def tables_touched(access: DataFrame, sid: str) -> DataFrame:
    return access.where(F.col("sid") == sid).select("tname", F.when(F.col("role") == "target", "writes").when(F.col("role") == "source", "reads").otherwise("looks_up").alias("relation"))


def table_lineage(access: DataFrame, tname: str) -> DataFrame:
    return access.where(F.col("tname") == tname).select("role", "sid")


def apply_glossary(access: DataFrame, glossary: DataFrame) -> DataFrame:
    """tname, business_name: the glossary's name, else the table's own."""
    names = access.select("tname").distinct()
    return names.join(glossary, F.upper("tname") == F.col("term"), "left").select("tname", F.coalesce("label", "tname").alias("business_name"))
