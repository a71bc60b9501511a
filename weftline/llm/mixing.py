"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget is handed down a tree of domain, language and source. Children share their parent's budget
by integer weights; a child that cannot use its share (it holds ``tokens * max_epochs`` at most) gives the
rest to its siblings by their weights, and only when all siblings are full does it count as a shortage of
the parent, which is then met among the parent's siblings. With each inner node's capacity known before,
one pass from the root does that: among children in order of capacity per weight, those are full whose
capacity is within their share of what the fuller ones leave. Shares are whole tokens (largest remainders).

Each leaf then takes as many whole epochs as its budget holds, and of the next epoch the prefix that fills
it up, in an order seeded by epoch; the last document of the prefix is taken in part. Running sums are made
in two steps, over hash ranges of a leaf and inside each range, so a leaf with a third of all rows is spread
over thousands of keys. Leaves are joined to rows by broadcast only within a checked bound.

Defined cases. Null text: no tokens, never selected. Null lang or source: ``''``; a source without a number
is in domain ``other``. Null ``doc_id``: ordered as ``null``. Rows with one id are taken
in the order of their tokens and of a hash of their texts, so the same texts are taken whatever the partitioning. Repeated rows: each counts. Weights default
to 1; a weight is a whole number from 1 to 10,000. Empty table or budget: no rows. Other columns are kept
where asked for, under their own names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import BROADCAST_ROWS, read, stored

QUERY = "op9_mixing"
#: Production weights of domains and languages; sources have equal weights.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
#: Share of all tokens that is the budget, how often a document may be used, and the seed of the orders.
FRACTION, MAX_EPOCHS, SEED = 0.7, 2, 17
_LEAF = ["mx_domain", "mx_lang", "mx_source"]
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Domains of the sample sources: their number modulo 4."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.when(number != "", number).cast("int") % 4)).otherwise(F.lit("other"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    found = F.lit(None).cast("long")
    for name, w in weights.get(level, {}).items():
        found = F.when(F.col(f"mx_{level}") == name, F.lit(int(w)).cast("long")).otherwise(found)
    return F.coalesce(found, F.lit(1).cast("long"))


def _share(children: DataFrame, parent: list[str], key: str, *keep: str) -> DataFrame:
    """Keys and ``keep`` of ``children`` (parent keys, key, cap, weight, budget of the parent) with ``given``."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), key)
    among = Window.partitionBy(*parent)
    smaller = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = children.withColumn("full", F.col("cap") * rest <= (F.col("budget") - smaller) * F.col("weight"))
    left = full.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(among)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(among))
    exact = F.col("left") * F.col("weight")
    cut = left.withColumn("low", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * weight) div greatest(open, 1)"))).withColumn("over", F.when(F.col("full"), F.lit(-1).cast("long")).otherwise(exact % F.greatest("open", F.lit(1))))
    spare = F.col("budget") - F.sum("low").over(among)
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("over"), key))
    given = F.col("low") + F.when(~F.col("full") & (rank <= spare), 1).otherwise(0)
    return cut.withColumn("given", given).select(*parent, key, *keep, "given")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], fraction: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, given) of every leaf; ``leaves`` has the leaf keys and tokens.

    All windows here are over nodes of the tree, not over documents.
    """
    sized = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    budget = F.floor(F.sum("tokens") * F.lit(fraction)).cast("long")
    domains = sized.groupBy("mx_domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("domain", weights)).withColumn("root", F.lit(0))
    total = sized.agg(budget.alias("budget"), F.sum("cap").alias("most")).select(F.lit(0).alias("root"), F.least("budget", "most").alias("budget"))
    by_domain = _share(domains.join(F.broadcast(total), "root"), ["root"], "mx_domain").select("mx_domain", F.col("given").alias("budget"))
    langs = sized.groupBy("mx_domain", "mx_lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("lang", weights))
    by_lang = _share(langs.join(by_domain, "mx_domain"), ["mx_domain"], "mx_lang").select("mx_domain", "mx_lang", F.col("given").alias("budget"))
    sources = sized.withColumn("weight", _weight("source", weights)).join(by_lang, ["mx_domain", "mx_lang"])
    return _share(sources, ["mx_domain", "mx_lang"], "mx_source", "tokens")


def _ranged(placed: DataFrame) -> DataFrame:
    """``placed`` with mx_start: tokens of its leaf that come before it in the order.

    The order's first three hexadecimal digits cut a leaf into ranges. Sums of ranges are summed within the
    256 ranges of one first digit, and those within the leaf, so no task holds a leaf's rows. What comes before
    each range is written, at most 4,096 rows a leaf.
    """
    keys, wide = [*_LEAF, "mx_wide", "mx_range"], [*_LEAF, "mx_wide"]
    placed = placed.withColumn("mx_range", F.substring("mx_order", 1, 3)).withColumn("mx_wide", F.substring("mx_order", 1, 1))

    def before(column: str, parts: list[str], *order: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = placed.groupBy(*keys).agg(F.sum("mx_tokens").alias("mx_sum"))
    wide_sums = sums.groupBy(*wide).agg(F.sum("mx_sum").alias("mx_all"))
    wide_before = wide_sums.select(*wide, before("mx_all", _LEAF, "mx_wide").alias("mx_far"))  # at most 16 rows a leaf
    ahead = sums.select(*keys, before("mx_sum", wide, "mx_range").alias("mx_near"))  # at most 256 rows a part
    ahead = stored(ahead.join(wide_before, wide).select(*keys, (F.col("mx_near") + F.col("mx_far")).alias("mx_ahead")), "mixing-ranges")
    inside = placed.withColumn("mx_inside", before("mx_tokens", keys, "mx_order", "mx_id", "mx_tokens", "mx_mark"))
    return inside.join(ahead, keys).withColumn("mx_start", F.col("mx_ahead") + F.col("mx_inside"))


def mix(docs: DataFrame, keep: list[str], weights: Mapping[str, Mapping[str, int]] = WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """The selected documents: ``keep`` columns, mx_domain, mx_lang, mx_source, mx_tokens, and what is taken:
    mx_epochs (whole uses) and mx_part (tokens of one more use, from its start).

    Texts are counted once; the counted rows (``keep``, leaf and tokens) are written and read again.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    rows = docs.select(*keep, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("mx_id"), (domain_of(source) if domain is None else domain).alias("mx_domain"), lang.alias("mx_lang"), source.alias("mx_source"), tokens.alias("mx_tokens"), F.xxhash64("text").alias("mx_mark"))
    rows = stored(rows, "mixing-rows").where("mx_tokens > 0")
    # stored: one pass over the rows, a row a leaf, counted for the bound below
    leaves = stored(rows.groupBy(*_LEAF).agg(F.sum("mx_tokens").alias("tokens")), "mixing-leaves")
    if few := leaves.count() <= BROADCAST_ROWS // 8:
        leaves = leaves.coalesce(1)  # sums and windows over so few nodes need no exchange, whose stages each cost the driver a new plan
    # stored: used by every row's join
    plan = stored(leaf_budgets(leaves, weights, fraction, max_epochs).select(*_LEAF, F.expr("given div tokens").alias("mx_epochs"), (F.col("given") % F.col("tokens")).alias("mx_rest")), "mixing-plan")
    joined = rows.join(F.broadcast(plan) if few else plan, _LEAF)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mx_epochs").cast("string"), "mx_id").cast("binary"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("mx_tokens"), F.col("mx_rest") - F.col("mx_start")))
    taken = _ranged(joined.withColumn("mx_order", order)).withColumn("mx_part", part)
    return taken.where("mx_epochs > 0 or mx_part > 0").select(*keep, *_LEAF, "mx_tokens", "mx_epochs", "mx_part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mix(read(spark, sf_dir, "documents"), ["doc_id"])
    names = {"mx_domain": "domain", "mx_lang": "lang", "mx_source": "source", "mx_tokens": "n_tokens", "mx_epochs": "epochs", "mx_part": "part_tokens"}
    return chosen.withColumnsRenamed(names)


def _sql_share(name: str, rows: str, parent: str, key: str) -> str:
    """Common table expressions that hand a parent's budget to its children, as ``_share`` does."""
    over = f"PARTITION BY {parent}"
    return f"""
{name}_1 AS (SELECT *, cap * sum(weight) OVER ({over} ORDER BY cap / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full FROM {rows}),
{name}_2 AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({over}) AS lft, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}) AS opn FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN is_full THEN cap ELSE (lft * weight) // greatest(opn, 1) END AS low, CASE WHEN is_full THEN -1 ELSE (lft * weight) % greatest(opn, 1) END AS ovr FROM {name}_2),
{name} AS (SELECT *, low + CASE WHEN NOT is_full AND row_number() OVER ({over} ORDER BY ovr DESC, {key}) <= budget - sum(low) OVER ({over}) THEN 1 ELSE 0 END AS given FROM {name}_3)"""


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CAST(CASE {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || CAST(CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER) % 4 AS VARCHAR) ELSE 'other' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {MAX_EPOCHS} AS cap FROM docs WHERE n_tokens > 0 GROUP BY ALL),
total AS (SELECT least(CAST(floor(sum(tokens) * CAST({FRACTION} AS DOUBLE)) AS HUGEINT), sum(cap)) AS budget FROM leaves),
d0 AS (SELECT domain, 0 AS root, sum(cap) AS cap, {_sql_weight("domain")} AS weight, any_value(budget) AS budget FROM leaves, total GROUP BY domain),
{_sql_share("d1", "d0", "root", "domain")},
l0 AS (SELECT domain, lang, sum(leaves.cap) AS cap, {_sql_weight("lang")} AS weight, any_value(given) AS budget FROM leaves JOIN d1 USING (domain) GROUP BY domain, lang),
{_sql_share("l1", "l0", "domain", "lang")},
s0 AS (SELECT leaves.*, {_sql_weight("source")} AS weight, l1.given AS budget FROM leaves JOIN l1 USING (domain, lang)),
{_sql_share("s1", "s0", "domain, lang", "source")},
placed AS (
  SELECT docs.*, given // tokens AS epochs, given % tokens AS rest, md5('{SEED}:' || CAST(given // tokens AS VARCHAR) || ':' || id) AS o
  FROM docs JOIN s1 USING (domain, lang, source) WHERE n_tokens > 0),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(greatest(0, least(n_tokens, rest - start)) AS BIGINT) AS part_tokens
FROM summed WHERE epochs > 0 OR rest > start
"""
