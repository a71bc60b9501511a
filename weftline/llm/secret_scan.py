"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found in every text by one pattern each: ``assign`` (a named value of eight or more
characters), ``access`` (cloud access key identifiers) and ``hex`` (32 or more lower-case hex digits). They
are reported as they are.

The linking method adds weaker parts, each too common to report alone: ``user`` (a named account or client
identifier), ``opaque`` (a bare value of 20 or more characters that mixes cases and digits) and ``endpoint``
(an address with a scheme, or a named host). A part is reported only where parts that complete it lie in
the same scope, ``SCOPE`` characters around it: a user needs a secret (assign, hex or opaque), an opaque
value needs an identifier (access or user), an endpoint needs both an identifier and a secret. The parts are
interval-joined: a scope is cut into cells of ``SCOPE`` characters, parts meet candidates in the same or the
next cell of their text, and the distance decides.

Offsets come from the pieces between matches: ``split`` by a pattern and ``regexp_extract_all`` take turns,
so a running sum of their lengths gives every match's place in code points. Running sums over an array and
replacements in a text are made in chunks of ``CHUNK`` matches and then over chunks, as a growing array or
string is copied at every step: the work for a text with very many matches stays near their number.

Defined cases. Null text: empty. Null ``doc_id``: scanned and returned like any other. Rows that repeat an
id with the same text share their parts; with another text they do not. Very many parts in one text spread
over its cells. Empty table: no rows. Other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import read, stored

QUERY = "op2_secret_scan"
#: Parts of one credential lie at most so many characters apart.
SCOPE = 200

#: Fixed patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Parts that are reported only with parts that complete them.
USER = r"""(?i)\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i)\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|ftp)://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:_-]{3,}"""

#: Matches of a text that are handled as one array or string.
CHUNK = 128

KINDS = ("assign", "access", "hex", "user", "opaque", "endpoint")
_SPAN = "struct<start:int,kind:int,end:int>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once: a plain column would be computed anew in every lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunked(items: Column) -> Column:
    """An array as an array of arrays of ``CHUNK`` items, in order; at least one."""
    many = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), many), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    none = F.array().cast(f"array<{_SPAN}>")
    length = lambda turn: F.length(turn["gap"]) + F.coalesce(F.length(turn["hit"]), F.lit(0))

    def step(state: Column, turn: Column) -> Column:
        begin, end = state["at"] + F.length(turn["gap"]), state["at"] + length(turn)
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["hit"].isNotNull(), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def inside(chunk: Column, start: Column) -> Column:
        return F.aggregate(chunk, F.struct(start.alias("at"), none.alias("spans")), step)["spans"]

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, turn: n + length(turn)))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), inside))

    return F.when(F.regexp_like(text, F.lit(pattern)), _with(turns, lambda t: _with(_chunked(t), over))).otherwise(none)


def _assigned(text: Column) -> Column:
    """Spans of ``ASSIGN`` whose value has eight or more characters; shorter ones still use up their text."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    both = F.arrays_zip(_spans(text, ASSIGN, 0).alias("span"), F.when(F.regexp_like(text, F.lit(ASSIGN)), values).otherwise(F.array().cast("array<string>")).alias("value"))
    return F.transform(F.filter(both, lambda x: F.length(x["value"]) >= 8), lambda x: x["span"])


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, parts) of every row: spans of the base kinds and of the weaker parts.

    ``mark`` is a hash of the text, so that equal ids with different texts stay apart.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(_assigned(text), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    parts = F.concat(*[_spans(text, p, k) for k, p in enumerate((USER, OPAQUE, ENDPOINT), 3)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), base.alias("base"), parts.alias("parts"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, mark, kept): the weaker parts of each text that parts in their scope complete."""
    hot = found.where(F.size("parts") > 0).select("doc_id", "mark", F.explode(F.concat("base", "parts")).alias("s"))
    rows = hot.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "mark", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end")).distinct()
    weak = rows.where("kind >= 3").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)))

    def within(candidates: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
        """Candidate cells that hold a part of some kind near enough; a part lies in all cells it touches."""
        near = rows.where(F.col("kind").isin(*kinds)).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
        near = near.select("id", "none", "mark", "cell", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        keys = ["id", "none", "mark", "cell"]
        met = [candidates[k] == near[k] for k in keys]
        apart = (near.p_start <= candidates["end"] + scope) & (near.p_end >= candidates.start - scope)
        # a part does not complete what it overlaps
        clear = (near.p_start >= candidates["end"]) | (near.p_end <= candidates.start)
        on = met[0]
        for c in [*met[1:], apart, clear]:
            on = on & c
        return candidates.join(near, on, "left_semi").select("id", "none", "mark", "start", "kind", "end").distinct()

    whole = ["id", "none", "mark", "start", "kind", "end"]
    with_secret = within(weak.where("kind in (3, 5)"), (0, 2, 4))
    with_identifier = within(weak.where("kind in (4, 5)"), (1, 3))
    kept = with_secret.where("kind = 3").unionByName(with_identifier.where("kind = 4")).unionByName(with_secret.where("kind = 5").join(with_identifier, whole, "left_semi"))
    grouped = kept.groupBy("id", "none", "mark").agg(F.collect_list(F.struct("start", "kind", "end")).alias("kept"))
    return grouped.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "mark", "kept")


def linked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, mark, base, kept) of every row; the text is scanned once and its spans are kept as a table."""
    found = stored(scan(docs), "secret-spans")
    links = link(found, scope).withColumnsRenamed({"doc_id": "l_id", "mark": "l_mark"})
    none = F.array().cast(f"array<{_SPAN}>")
    joined = found.join(links, found.doc_id.eqNullSafe(links.l_id) & (found.mark == links.l_mark), "left")
    return joined.select("doc_id", "mark", "base", F.coalesce("kept", none).alias("kept"))


def redact(docs: DataFrame, columns: list[str], scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in square brackets.

    Overlapping spans are one. Rows, other columns and clean texts stay as they are.
    """
    spans = linked(docs, scope).select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), F.array_sort(F.concat("base", "kept")).alias("spans")).where(F.size("spans") > 0)
    spans = spans.groupBy("s_id", "s_mark").agg(F.first("spans").alias("spans"))
    cleaned = _with(F.struct("text", "spans"), lambda x: _replaced(x["text"], x["spans"]))
    joined = docs.join(spans, docs.doc_id.cast("long").eqNullSafe(spans.s_id) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == spans.s_mark), "left")
    return joined.withColumn("text", F.when(F.col("spans").isNotNull(), cleaned).otherwise(F.col("text"))).select(*columns)


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with sorted spans replaced; of spans that overlap, the first names the kind."""
    names = F.array(*map(F.lit, KINDS))

    def inside(chunk: Column, start: Column) -> Column:
        """The text from ``start`` to the end of the chunk's spans."""

        def step(state: Column, s: Column) -> Column:
            fresh = F.concat(state["out"], F.substring(state["of"], state["at"] - start + 1, F.greatest(s["start"] - state["at"], F.lit(0))), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"), state["of"].alias("of"))

        part = F.substring(text, start + 1, F.greatest(F.array_max(F.transform(chunk, lambda s: s["end"])) - start, F.lit(0)))
        return F.aggregate(chunk, F.struct(start.alias("at"), F.lit("").alias("out"), part.alias("of")), step)["out"]

    def over(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        starts = F.aggregate(ends, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.greatest(F.element_at(out, -1), n))))
        return _with(starts, lambda at: F.concat(F.array_join(F.zip_with(chunks, F.slice(at, F.lit(1), F.size(chunks)), inside), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text))))

    return _with(_chunked(spans), over)


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, counts and digests of the base spans, and all spans, of every document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return linked(docs, scope).select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "kept")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
