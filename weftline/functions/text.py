"""Column functions over code, expressions, names and questions. Patterns avoid look-around, so that any
regular-expression engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function categories by name, first match wins.
CATEGORIES = {
    "aggregate": ["SUM", "COUNT", "AVG", "MIN", "MAX"], "conditional": ["IIF", "DECODE", "CASE"], "null_handling": ["ISNULL", "NVL", "COALESCE"],
    "string": ["SUBSTR", "INSTR", "CONCAT", "LTRIM", "RTRIM", "UPPER", "LOWER"], "conversion": ["TO_CHAR", "TO_DATE", "TO_INTEGER"],
}


def first_of(*rules: tuple[Column, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def classify_language(text: Column) -> Column:
    """plsql, sql, java, python, shell, javascript, expression or text; the first rule that fits."""
    t = F.upper(text)
    has = lambda p: F.regexp_like(t, F.lit(p))
    return first_of((has(r"^\s*(BEGIN|DECLARE)\b"), "plsql"), (has(r"^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE)\b"), "sql"), (has(r"PUBLIC CLASS|IMPORT JAVA"), "java"), (has(r"\bDEF \w+\(|^IMPORT "), "python"),
                    (has(r"^#!"), "shell"), (has(r"\bFUNCTION\s*\("), "javascript"), (has(r"\b[A-Z_]+\("), "expression"), otherwise="text")


def count_loc(text: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long")


def function_names(text: Column) -> Column:
    """Names of all calls, in order."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z_][A-Z0-9_]*)\s*\("), F.lit(1))


def category(name: Column) -> Column:
    return first_of(*[(name.isin(*names), kind) for kind, names in CATEGORIES.items()], otherwise="custom_udf")


def sql_tables(text: Column) -> Column:
    """Distinct upper-case table names after FROM, JOIN, INTO, UPDATE, TABLE and USING."""
    names = F.regexp_extract_all(F.upper(text), F.lit(r"\b(?:FROM|JOIN|INTO|UPDATE|TABLE|USING)\s+([A-Z_][A-Z0-9_.]*)"), F.lit(1))
    return F.array_distinct(F.array_except(names, F.array(F.lit("SELECT"), F.lit("SET"))))


def expression_type(text: Column) -> Column:
    """passthrough, aggregated, lookup, conditional, constant or derived; the first rule that fits."""
    t = F.upper(text)
    has = lambda p: F.regexp_like(t, F.lit(p))
    return first_of((F.regexp_like(text, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*$")), "passthrough"), (has(r"\b(SUM|COUNT|AVG|MIN|MAX)\s*\("), "aggregated"), (has(r":LKP\."), "lookup"), (has(r"\b(IIF|DECODE)\s*\("), "conditional"), (has(r"^('[^']*'|[0-9.]+)$"), "constant"), otherwise="derived")


def depth(text: Column) -> Column:
    """Deepest nesting of parentheses."""
    signs = F.transform(F.split(F.regexp_replace(text, r"[^()]", ""), ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(signs, state, lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))["most"].cast("long")


#: Rewriting rules to Spark SQL, in order.
REWRITES = [
    ("null_check", r"ISNULL\(([^()]*)\)", "($1 IS NULL)"), ("conditional", r"IIF\((\([^()]*\)|[^(),]*),\s*([^(),]*),\s*([^(),]*)\)", "CASE WHEN $1 THEN $2 ELSE $3 END"), ("null", r"NVL\(", "COALESCE("),
    ("locate", r"INSTR\(([^(),]*),\s*([^(),]*)\)", "LOCATE($2, $1)"), ("substring", r"SUBSTR\(", "SUBSTRING("), ("timestamp", r"TO_CHAR\(", "DATE_FORMAT("), ("parameter", r"\$\$([A-Za-z_][A-Za-z0-9_]*)", "\\${$1}"),
]


def transpile(text: Column) -> Column:
    """The expression with every rule applied once, in order."""
    for _, pattern, new in REWRITES:
        text = F.regexp_replace(text, pattern, new)
    return text


def transpile_rules(text: Column) -> Column:
    """Names of the rules that change the expression, joined by commas."""
    hits, now = [], text
    for name, pattern, new in REWRITES:
        after = F.regexp_replace(now, pattern, new)
        hits.append(F.when(after != now, F.lit(name)))
        now = after
    return F.array_join(F.array_compact(F.array(*hits)), ",")


def classify_question(text: Column) -> Column:
    """Intent of a question by its first keyword group."""
    t = F.lower(text)
    has = lambda p: F.regexp_like(t, F.lit(p))
    return first_of((has(r"impact|affect|break"), "impact"), (has(r"lineage|upstream|downstream|depend"), "lineage"), (has(r"complex|effort|hours"), "complexity"), (has(r"duplicate|similar"), "similarity"), (has(r"conflict|write"), "conflict"), (has(r"table|column|schema"), "table"), otherwise="general")


def entities(text: Column) -> Column:
    """Distinct upper-case identifiers of four characters or more, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9_]{3,})\b"), F.lit(1)))


def connection_parts(text: Column) -> tuple[Column, Column, Column]:
    """host, port, database of ``//host:port/db``, ``host:port:sid``, ``Server=..;Database=..`` and ``host/db``."""
    forms = [(r"//([A-Za-z0-9._-]+):([0-9]+)/([A-Za-z0-9_]+)", 1, 2, 3), (r"^([A-Za-z0-9._-]+):([0-9]+):([A-Za-z0-9_]+)$", 1, 2, 3), (r"(?i)server=([A-Za-z0-9._-]+);()database=([A-Za-z0-9_]+)", 1, 2, 3), (r"^([A-Za-z0-9._-]+)()/([A-Za-z0-9_]+)$", 1, 2, 3)]
    parts = []
    for k in range(3):
        out = F.lit("")
        for p, *groups in reversed(forms):
            out = F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, groups[k])).otherwise(out)
        parts.append(out)
    return tuple(parts)


def infer_system(name: Column) -> Column:
    """System that a connection or table name points to; the first pattern wins."""
    n = F.upper(name)
    has = lambda p: F.regexp_like(n, F.lit(p))
    return first_of((has("ORA"), "oracle"), (has("TERA|TD_"), "teradata"), (has("SNOW"), "snowflake"), (has("MSSQL|SQLSRV|SERVER="), "sqlserver"), (has("HIVE|HDFS|HADOOP"), "hadoop"), (has("KAFKA"), "kafka"), (has("S3|BUCKET"), "object_store"), (has("FILE|CSV|FTP"), "file"), otherwise="database")
