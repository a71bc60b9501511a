"""Queries over expressions, SQL, transforms, names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as t
from weftline.operators import views


def _cases(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE '{otherwise}' END"


def _category_sql(name: str) -> str:
    return _cases([(f"{name} IN ({', '.join(repr(x) for x in names)})", kind) for kind, names in t.CATEGORIES.items()], "custom_udf")


_LANGUAGE_SQL = _cases([(r"regexp_matches(upper(x), '^\s*(BEGIN|DECLARE)\b')", "plsql"), (r"regexp_matches(upper(x), '^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE)\b')", "sql"), ("regexp_matches(upper(x), 'PUBLIC CLASS|IMPORT JAVA')", "java"),
    (r"regexp_matches(upper(x), '\bDEF \w+\(|^IMPORT ')", "python"), ("regexp_matches(upper(x), '^#!')", "shell"), (r"regexp_matches(upper(x), '\bFUNCTION\s*\(')", "javascript"), (r"regexp_matches(upper(x), '\b[A-Z_]+\(')", "expression")], "text")
_TYPE_SQL = _cases([("regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$')", "passthrough"), (r"regexp_matches(upper(x), '\b(SUM|COUNT|AVG|MIN|MAX)\s*\(')", "aggregated"), (r"regexp_matches(upper(x), ':LKP\.')", "lookup"), (r"regexp_matches(upper(x), '\b(IIF|DECODE)\s*\(')", "conditional"), ("regexp_matches(x, '^(''[^'']*''|[0-9.]+)$')", "constant")], "derived")
_LOC_SQL = "len(list_filter(string_split(x, chr(10)), lambda l: trim(l) <> ''))"
_TABLES_SQL = r"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(x), '\b(?:FROM|JOIN|INTO|UPDATE|TABLE|USING)\s+([A-Z_][A-Z0-9_.]*)', 1), lambda n: n NOT IN ('SELECT', 'SET')))), ',')"
_QUESTION_SQL = _cases([("regexp_matches(lower(x), 'impact|affect|break')", "impact"), ("regexp_matches(lower(x), 'lineage|upstream|downstream|depend')", "lineage"), ("regexp_matches(lower(x), 'complex|effort|hours')", "complexity"), ("regexp_matches(lower(x), 'duplicate|similar')", "similarity"), ("regexp_matches(lower(x), 'conflict|write')", "conflict"), ("regexp_matches(lower(x), 'table|column|schema')", "table")], "general")


def _rewrite_sql() -> str:
    out = "x"
    for _, pattern, new in t.REWRITES:
        new = new.replace("\\$", "\x00")
        for k in range(1, 4):
            new = new.replace(f"${k}", f"\\{k}")
        out = f"regexp_replace({out}, '{pattern}', '{new.replace(chr(0), '$')}', 'g')"
    return out


def _funnel(c):
    """Rows that reach the end of a session's transforms, 100 a source: each kind keeps a share."""
    factor = F.when(F.col("transformation_type") == "Filter", 0.5).when(F.col("transformation_type") == "Joiner", 0.8).when(F.col("transformation_type") == "Aggregator", 0.1).when(F.col("transformation_type") == "Router", 0.7).otherwise(1.0)
    steps = c.instance.where("inst_type = 'TRANSFORMATION'").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", factor.alias("f"), F.col("inst_name").alias("n")))).alias("s"))
    out = c.session.select("sid", (100 * F.size("sources")).cast("long").alias("source_volume")).join(steps, "sid", "left")
    ratio = F.aggregate(F.coalesce("s", F.array().cast("array<struct<pos:bigint,f:double,n:string>>")), F.lit(1.0), lambda a, x: a * x["f"])
    neck = F.filter("s", lambda x: x["f"] < 0.5)
    return out.select("sid", "source_volume", F.round(F.col("source_volume") * ratio, 4).alias("output_volume"), F.when(F.size(neck) > 0, neck[0]["n"]).otherwise("").alias("bottleneck"))


def _chokepoint(c):
    """Instances by in-degree x out-degree."""
    ends = c.connector.select("sid", F.col("from_instance").alias("i"), F.lit(0).alias("d"), F.lit(1).alias("o")).unionAll(c.connector.select("sid", "to_instance", F.lit(1), F.lit(0)))
    per = ends.groupBy("sid", "i").agg((F.sum("d") * F.sum("o")).alias("m"), (F.sum("d") + F.sum("o")).alias("g"))
    return per.groupBy("sid").agg(F.count("*").alias("transforms"), F.max("m").alias("most"), F.min(F.struct((-F.col("m")).alias("m"), "i"))["i"].alias("chokepoint"), F.round(F.avg("g"), 6).alias("avg_degree"))


def _functions(c):
    names = c.expression.select("sid", F.explode(t.function_names(F.col("expression_text"))).alias("function"))
    return names.groupBy("function").agg(F.count("*").alias("calls"), F.countDistinct("sid").alias("sessions")).select("function", t.category(F.col("function")).alias("category"), "calls", "sessions")


def _chunks(docs, size=400, overlap=50):
    """doc_id, chunk_index, text: windows of words; a short text is one chunk as it is."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(size - overlap))
    rows = docs.select("doc_id", "text", words.alias("w")).select("doc_id", "text", "w", F.posexplode(starts).alias("i", "at"))
    piece = F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ")
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.when(F.size("w") <= size, F.coalesce("text", F.lit(""))).otherwise(piece).alias("text"))


def _dedup(docs):
    """Documents by content hash: the first of each by id."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    first = docs.groupBy(h.alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.select("doc_id", h.alias("sha256")).join(first, "sha256").select("doc_id", "sha256", (F.col("doc_id") == F.col("first_id")).alias("is_first"), "copies")


def _intents(c):
    """The intent with the most signals; ties in a fixed order."""
    s = c.instance.groupBy("sid").agg(*[F.count_if(F.col("transformation_type") == k).alias(a) for k, a in (("Aggregator", "ag"), ("Joiner", "jo"), ("Filter", "fi"), ("Router", "ro"), ("Expression", "ex"))])
    scores = [(F.col("ag") * 3, "aggregation"), (F.col("jo") * 2, "integration"), (F.col("ro") * 2, "routing"), (F.col("fi"), "filtering"), (F.col("ex"), "transformation")]
    best = F.greatest(*[x for x, _ in scores])
    total = sum((x for x, _ in scores[1:]), scores[0][0])
    return s.select("sid", t.first_of(*[((x == best) & (best > 0), n) for x, n in scores], otherwise="passthrough").alias("intent"), F.round(F.when(total > 0, best / total).otherwise(0.0), 6).alias("confidence"))


_NORM = "sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])))"
DISTANCES_SQL = f"q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / ({_NORM.format('embedding')} * {_NORM.format('e')}), 5) AS distance FROM embeddings, q WHERE vec_id <> 0) "
HITS_SQL = DISTANCES_SQL + ", hits AS (SELECT lang AS type, doc_id AS id, distance FROM s JOIN documents ON doc_id = vec_id) "

INTENT_SQL = """SELECT sid, CASE greatest(ag, jo, ro, fi, ex) WHEN 0 THEN 'passthrough' WHEN ag THEN 'aggregation' WHEN jo THEN 'integration' WHEN ro THEN 'routing' WHEN fi THEN 'filtering' ELSE 'transformation' END AS intent,
        round(CASE WHEN ag + jo + ro + fi + ex > 0 THEN greatest(ag, jo, ro, fi, ex) / (ag + jo + ro + fi + ex) ELSE 0.0 END, 6) AS confidence FROM (SELECT sid, 3 * count(*) FILTER (transformation_type = 'Aggregator') AS ag, 2 * count(*) FILTER (transformation_type = 'Joiner') AS jo, 2 * count(*) FILTER (transformation_type = 'Router') AS ro, count(*) FILTER (transformation_type = 'Filter') AS fi, count(*) FILTER (transformation_type = 'Expression') AS ex FROM cat_instance GROUP BY sid)"""

QUERIES = {
    "classify_language": (lambda c: c.sql.select("sid", "transform", t.classify_language(F.col("sql_text")).alias("language")), f"SELECT sid, transform, {_LANGUAGE_SQL} AS language FROM (SELECT *, sql_text AS x FROM cat_sql)"),
    "classify_language_documents": (lambda c: c.table("documents").select("doc_id", t.classify_language(F.coalesce("text", F.lit(""))).alias("language")).groupBy("language").agg(F.count("*").alias("n")), f"WITH d AS (SELECT {_LANGUAGE_SQL} AS language FROM (SELECT coalesce(text, '') AS x FROM documents)) SELECT language, count(*) AS n FROM d GROUP BY 1"),
    "count_loc": (lambda c: c.table("documents").select("doc_id", t.count_loc(F.coalesce("text", F.lit(""))).alias("loc")), f"WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, {_LOC_SQL} AS loc FROM d"),
    "extract_functions": (_functions, rf"SELECT f AS function, {_category_sql('f')} AS category, count(*) AS calls, count(DISTINCT sid) AS sessions FROM (SELECT sid, unnest(regexp_extract_all(upper(expression_text), '([A-Z_][A-Z0-9_]*)\s*\(', 1)) AS f FROM cat_expression) GROUP BY f"),
    "function_profile": (lambda c: c.expression.select("sid", F.explode(t.function_names(F.col("expression_text"))).alias("f")).groupBy("sid").agg(F.count("*").alias("calls"), F.countDistinct("f").alias("distinct_functions"), *[F.count_if(t.category(F.col("f")) == k).alias(k) for k in t.CATEGORIES]),
        rf"SELECT sid, count(*) AS calls, count(DISTINCT f) AS distinct_functions, {', '.join(f'count(*) FILTER ({_category_sql(chr(102))} = {k!r}) AS {chr(34)}{k}{chr(34)}' for k in t.CATEGORIES)} FROM (SELECT sid, unnest(regexp_extract_all(upper(expression_text), '([A-Z_][A-Z0-9_]*)\s*\(', 1)) AS f FROM cat_expression) GROUP BY sid"),
    "extract_sql_tables": (lambda c: c.sql.select("sid", "transform", F.array_join(F.sort_array(t.sql_tables(F.col("sql_text"))), ",").alias("tables")), f"SELECT sid, transform, {_TABLES_SQL} AS tables FROM (SELECT *, sql_text AS x FROM cat_sql)"),
    "embedded_code": (lambda c: c.sql.select("sid", "transform", "kind", t.classify_language(F.col("sql_text")).alias("language"), t.count_loc(F.col("sql_text")).alias("lines"), F.length("sql_text").cast("long").alias("chars"), F.regexp_like(F.upper("sql_text"), F.lit(r"\b(INSERT|UPDATE|DELETE|MERGE)\b")).alias("dml"), F.regexp_like(F.upper("sql_text"), F.lit(r"\b(CREATE|DROP|ALTER|TRUNCATE)\b")).alias("ddl"), F.array_join(F.sort_array(t.sql_tables(F.col("sql_text"))), ",").alias("tables")),
        rf"SELECT sid, transform, kind, {_LANGUAGE_SQL} AS language, {_LOC_SQL} AS lines, length(x) AS chars, regexp_matches(upper(x), '\b(INSERT|UPDATE|DELETE|MERGE)\b') AS dml, regexp_matches(upper(x), '\b(CREATE|DROP|ALTER|TRUNCATE)\b') AS ddl, {_TABLES_SQL} AS tables FROM (SELECT *, sql_text AS x FROM cat_sql)"),
    "code_presence_flags": (lambda c: c.sql.groupBy("sid").agg(F.bool_or(t.classify_language(F.col("sql_text")) == "sql").alias("has_sql"), F.bool_or(t.classify_language(F.col("sql_text")) == "plsql").alias("has_plsql"), F.bool_or(F.col("kind") == "pre_sql").alias("has_pre"), F.bool_or(F.col("kind") == "post_sql").alias("has_post"), F.count("*").alias("blocks")),
        f"SELECT sid, bool_or({_LANGUAGE_SQL} = 'sql') AS has_sql, bool_or({_LANGUAGE_SQL} = 'plsql') AS has_plsql, bool_or(kind = 'pre_sql') AS has_pre, bool_or(kind = 'post_sql') AS has_post, count(*) AS blocks FROM (SELECT *, sql_text AS x FROM cat_sql) GROUP BY sid"),
    "ext_transform_fields": (lambda c: c.expression.select("sid", "transform", "field", t.expression_type(F.col("expression_text")).alias("expression_type")), f"SELECT sid, transform, field, {_TYPE_SQL} AS expression_type FROM (SELECT *, expression_text AS x FROM cat_expression)"),
    "classify_expression": (lambda c: c.expression.select("sid", "transform", "field", t.expression_type(F.col("expression_text")).alias("type"), F.size(t.function_names(F.col("expression_text"))).cast("long").alias("functions"), t.depth(F.col("expression_text")).alias("depth")),
        rf"""SELECT sid, transform, field, {_TYPE_SQL} AS type, len(regexp_extract_all(upper(x), '([A-Z_][A-Z0-9_]*)\s*\(')) AS functions,
        CAST(coalesce(list_max(list_transform(range(1, len(p) + 1), lambda k: len(replace(p[1:k], ')', '')) - len(replace(p[1:k], '(', '')))), 0) AS BIGINT) AS depth FROM (SELECT *, expression_text AS x, regexp_replace(expression_text, '[^()]', '', 'g') AS p FROM cat_expression)"""),
    "ext_parameters": (lambda c: c.expression.select("sid", F.explode(F.regexp_extract_all("expression_text", F.lit(r"\$\$([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("name")).groupBy("name").agg(F.countDistinct("sid").alias("sessions")).select("name", F.when(F.col("name").startswith("PM"), "system").otherwise("user").alias("type"), "sessions"),
        r"SELECT name, CASE WHEN starts_with(name, 'PM') THEN 'system' ELSE 'user' END AS type, count(DISTINCT sid) AS sessions FROM (SELECT sid, unnest(regexp_extract_all(expression_text, '\$\$([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM cat_expression) GROUP BY name"),
    "transpile_expression": (lambda c: c.expression.select("sid", "transform", "field", t.transpile(F.col("expression_text")).alias("sql"), t.transpile_rules(F.col("expression_text")).alias("rules")).drop("rules"), f"SELECT sid, transform, field, {_rewrite_sql()} AS sql FROM (SELECT *, expression_text AS x FROM cat_expression)"),
    "expression_complexity": (lambda c: c.expression.groupBy("sid").agg(F.count("*").alias("n"), F.avg(t.depth(F.col("expression_text"))).alias("d"), F.sum(F.size(t.function_names(F.col("expression_text")))).alias("f")).select("sid", F.col("n").alias("expressions"), F.round("d", 6).alias("avg_depth"), F.col("f").alias("functions"), F.round(F.least(F.lit(100.0), 10 * F.col("d") + 5 * F.col("f") / F.col("n") + 0.5 * F.col("f")), 4).alias("score")),
        r"""SELECT sid, count(*) AS expressions, round(avg(d), 6) AS avg_depth, CAST(sum(f) AS BIGINT) AS functions, round(least(100.0, 10 * avg(d) + 5 * sum(f) / count(*) + 0.5 * sum(f)), 4) AS score
        FROM (SELECT sid, coalesce(list_max(list_transform(range(1, len(p) + 1), lambda k: len(replace(p[1:k], ')', '')) - len(replace(p[1:k], '(', '')))), 0) AS d, len(regexp_extract_all(upper(expression_text), '([A-Z_][A-Z0-9_]*)\s*\(')) AS f
          FROM (SELECT *, regexp_replace(expression_text, '[^()]', '', 'g') AS p FROM cat_expression)) GROUP BY sid"""),
    "data_funnel": (_funnel, """, st AS (SELECT *, CASE transformation_type WHEN 'Filter' THEN 0.5 WHEN 'Joiner' THEN 0.8 WHEN 'Aggregator' THEN 0.1 WHEN 'Router' THEN 0.7 ELSE 1.0 END AS f FROM cat_instance WHERE transformation_type NOT IN ('Source Definition', 'Target Definition'))
        SELECT sid, 100 * n_sources AS source_volume, round(100 * n_sources * coalesce((SELECT product(CAST(f AS DOUBLE)) FROM st WHERE st.sid = c.sid), 1.0), 4) AS output_volume, coalesce((SELECT min_by(inst_name, pos) FROM st WHERE st.sid = c.sid AND f < 0.5), '') AS bottleneck FROM cat_session c"""),
    "transform_chokepoint": (_chokepoint, """, p AS (SELECT sid, i, CAST(sum(d) * sum(o) AS BIGINT) AS m, sum(d) + sum(o) AS g FROM (SELECT sid, from_instance AS i, 0 AS d, 1 AS o FROM cat_connector UNION ALL SELECT sid, to_instance, 1, 0 FROM cat_connector) GROUP BY ALL)
        SELECT sid, count(*) AS transforms, max(m) AS most, (SELECT i FROM p q WHERE q.sid = p.sid ORDER BY m DESC, i LIMIT 1) AS chokepoint, round(avg(g), 6) AS avg_degree FROM p GROUP BY sid"""),
    "session_intent": (_intents, INTENT_SQL),
    "classify_transform_node": (lambda c: c.instance.select("sid", "inst_name", t.first_of((F.col("inst_type") == "SOURCE", "source"), (F.col("inst_type") == "TARGET", "target"), (F.col("transformation_type") == "Filter", "filter"), (F.col("transformation_type") == "Joiner", "join"), (F.col("transformation_type") == "Router", "router"), (F.col("transformation_type") == "Aggregator", "aggregate"), otherwise="transform").alias("node_type")),
        "SELECT sid, inst_name, CASE transformation_type WHEN 'Source Definition' THEN 'source' WHEN 'Target Definition' THEN 'target' WHEN 'Filter' THEN 'filter' WHEN 'Joiner' THEN 'join' WHEN 'Router' THEN 'router' WHEN 'Aggregator' THEN 'aggregate' ELSE 'transform' END AS node_type FROM cat_instance"),
    "column_lineage": (lambda c: c.connector.select("sid", F.concat_ws(".", "from_instance", "from_field").alias("from_column"), F.concat_ws(".", "to_instance", "to_field").alias("to_column")).join(c.instance.select("sid", F.col("inst_name").alias("i"), "transformation_type"), "sid").where("split_part(to_column, '.', 1) = i").select("sid", "from_column", "to_column", "transformation_type"),
        "SELECT k.sid, concat(from_instance, '.', from_field) AS from_column, concat(to_instance, '.', to_field) AS to_column, transformation_type FROM cat_connector k JOIN cat_instance i ON i.sid = k.sid AND inst_name = to_instance"),
    "record_filters": (lambda c: c.sql.where("kind = 'pre_sql'").select("sid", "transform", "sql_text"), "SELECT sid, transform, sql_text FROM cat_sql WHERE kind = 'pre_sql'"),
    "norm_table_name": (lambda c: c.table("part").select("p_partkey", views.norm_table_name(F.concat(F.lit(" conn/db:own.["), "p_name", F.lit("]@LINK ")), True).alias("tname")), "WITH p AS (SELECT p_partkey, string_split_regex(upper(trim(concat(' conn/db:own.[', p_name, ']@LINK '))), '[/:.]')[-1] AS n FROM part) SELECT p_partkey, split_part(regexp_replace(n, '[\\[\\]\"''`]', '', 'g'), '@', 1) AS tname FROM p"),
    "display_name": (lambda c: c.session.select("sid", views.display_name(F.col("name"), "smart").alias("smart"), views.display_name(F.col("full_name"), "short").alias("short")), "SELECT sid, regexp_replace(name, '^(s_m_|s_|m_|wf_)', '') AS smart, array_to_string(string_split(full_name, '_')[greatest(1, len(string_split(full_name, '_')) - 2):], '_') AS short FROM cat_names"),
    "infer_system": (lambda c: c.table("part").select("p_partkey", t.infer_system(F.col("p_type")).alias("system")), "WITH p AS (SELECT p_partkey, upper(p_type) AS n FROM part) SELECT p_partkey, CASE WHEN regexp_matches(n, 'ORA') THEN 'oracle' WHEN regexp_matches(n, 'TERA|TD_') THEN 'teradata' WHEN regexp_matches(n, 'SNOW') THEN 'snowflake' WHEN regexp_matches(n, 'MSSQL|SQLSRV|SERVER=') THEN 'sqlserver' WHEN regexp_matches(n, 'HIVE|HDFS|HADOOP') THEN 'hadoop' WHEN regexp_matches(n, 'KAFKA') THEN 'kafka' WHEN regexp_matches(n, 'S3|BUCKET') THEN 'object_store' WHEN regexp_matches(n, 'FILE|CSV|FTP') THEN 'file' ELSE 'database' END AS system FROM p"),
    "group_by_schema": (lambda c: c.sql.select(F.explode(t.sql_tables(F.col("sql_text"))).alias("n")).select(F.when(F.contains("n", F.lit(".")), F.substring_index("n", ".", 1)).otherwise("(default)").alias("schema"), F.substring_index("n", ".", -1).alias("tname")).groupBy("schema").agg(F.array_join(F.sort_array(F.collect_set("tname")), ",").alias("tables")),
        r", n AS (SELECT unnest(list_distinct(list_filter(regexp_extract_all(upper(sql_text), '\b(?:FROM|JOIN|INTO|UPDATE|TABLE|USING)\s+([A-Z_][A-Z0-9_.]*)', 1), lambda n: n NOT IN ('SELECT', 'SET')))) AS n FROM cat_sql) SELECT CASE WHEN contains(n, '.') THEN split_part(n, '.', 1) ELSE '(default)' END AS schema, string_agg(DISTINCT split_part(n, '.', -1), ',' ORDER BY split_part(n, '.', -1)) AS tables FROM n GROUP BY 1"),
    # documents and retrieval
    "chunk_text": (lambda c: _chunks(c.table("documents")), """WITH d AS (SELECT doc_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), ' ') AS w FROM documents), s AS (SELECT *, unnest(range(0, greatest(0, len(w) - 51) + 1, 350)) AS pos FROM d)
        SELECT doc_id, CAST(pos // 350 AS BIGINT) AS chunk_index, CASE WHEN len(w) <= 400 THEN x ELSE array_to_string(w[pos + 1 : pos + 400], ' ') END AS text FROM s"""),
    "dedup_content_hash": (lambda c: _dedup(c.table("documents")), "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT doc_id, h AS sha256, doc_id = min(doc_id) OVER (PARTITION BY h) AS is_first, count(*) OVER (PARTITION BY h) AS copies FROM d"),
    "exact_duplicates": (lambda c: c.session.groupBy(F.md5(F.concat_ws("|", F.array_join("sources", ","), F.array_join("targets", ","), F.array_join("lookups", ",")).cast("binary")).alias("fingerprint")).agg(F.count("*").alias("members"), F.min("sid").alias("first")).where("members > 1"), "SELECT md5(concat_ws('|', sources, targets, lookups)) AS fingerprint, count(*) AS members, min(sid) AS first FROM cat_session GROUP BY 1 HAVING count(*) > 1"),
    "classify_question": (lambda c: c.table("conversations").select("conv_id", "turn", t.classify_question(F.coalesce("text", F.lit(""))).alias("intent")), f"WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations) SELECT conv_id, turn, {_QUESTION_SQL} AS intent FROM q"),
    "search_code": (lambda c: c.table("documents").where(F.contains(F.lower("text"), F.lit("license"))).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")).unionByName(c.table("pages").where(F.contains(F.lower("html"), F.lit("license"))).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))).orderBy("kind", "id").limit(50), "WITH f AS (SELECT 'document' AS kind, doc_id AS id FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'page', page_id FROM pages WHERE contains(lower(html), 'license')) SELECT kind, id FROM f ORDER BY kind, id LIMIT 50"),
    "vector_topk": (lambda c: _vector_topk(c), "WITH " + DISTANCES_SQL + "SELECT vec_id, distance FROM s ORDER BY distance, vec_id LIMIT 10"),
}


def vector_distances(c, query_id: int = 0):
    """vec_id, distance: cosine distance of every other vector to one (a single row, broadcast)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = c.table("embeddings")
    q = v.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    rows = v.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(q))
    return rows.select("vec_id", F.round(1 - dot("embedding", "q") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q", "q"))), 5).alias("distance"))


def document_hits(c):
    """type (language), id, distance of the documents that have a vector."""
    return vector_distances(c).join(c.table("documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id").select(F.col("lang").alias("type"), F.col("vec_id").alias("id"), "distance")


def _vector_topk(c, k: int = 10):
    return vector_distances(c).orderBy("distance", "vec_id").limit(k)
