"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

Texts are tokenised once into a table of word keys in ``SHARDS`` shards (pieces are separated by a zero). The shards are
scanned in a cycle, and phrases of all lengths are counted side by side: words from the first scan on; a longer phrase
from the scan on at whose start both the phrase without its last word and the phrase without its first word have
reached the threshold, and then for one full cycle, so its count is exact. The scans end when no phrase's cycle is open.

A task looks up whether a phrase is active in one table of steps for each length, indexed by ``2 ** FILTER_BITS`` slots of the
phrase's hash: the step at which a phrase of that slot reached the threshold. This table has a fixed size (and is sent
compressed); it is the only thing that is broadcast. Two phrases in a slot may activate a phrase early; it is then counted for its own cycle all the
same, so counts stay exact and a crowded table costs work, not results. Counts are summed by block in the task, then
in a shuffle; rows below the threshold are dropped when their cycle ends.

Phrases that stay get their words in one last scan. Left and right counts come from joins with the counts of their
parts; phrases inside longer ones from a join on the longer ones' parts. The best of a language are chosen in two
steps, first within salted parts of the language, so no task holds a language.

Defined cases. Null text: empty. Null lang: ``und``. Null or repeated ``doc_id``, repeated rows: each row's text counts; ids
are not used. Empty table: no rows. Other columns are ignored. Texts are never cut. Words are known by 64-bit hashes of
language and code points, phrases by 96-bit hashes of those.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import textvec
from weftline.llm.common import read, shard_count, shared_dir, stored

QUERY = "op13_collocations"
#: Occurrences that a phrase needs, its words at most, and how many of a language are returned.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one around it has so many percent of its occurrences.
INSIDE = 80
#: Shards of the cycle, tokens of a row of the token table, and bits of a slot of the table of steps.
SHARDS, BLOCK, FILTER_BITS = 3, 1 << 19, 23
#: Tokens that a block repeats from the block before: phrases of up to one word more are whole in one of the two.
SHARED = 7
#: Distinct words that a task remembers to have named.
NAMED = 1 << 20
_NEVER = 255

_BLANK = np.zeros(textvec.SEPARATOR + 1, bool)
_BLANK[[0x20, 0x09]] = True
_CUT = np.zeros(textvec.SEPARATOR + 1, bool)
_CUT[[*map(ord, ".,;:!?"), 10, 11, 12, 13, textvec.SEPARATOR]] = True


def lang_key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def word_keys(texts, langs: list[int]):
    """Keys of all words of a batch, number of each word's text and piece, and code points with the words' spans."""
    points, starts = textvec.code_points(texts)
    upper = (points >= 65) & (points <= 90)
    points[upper] += 32
    cut = _CUT[points]
    gap = cut | _BLANK[points]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    text = np.searchsorted(starts, first, "right") - 1
    own = textvec.mix(np.array(langs, np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    keys = textvec.mix(textvec.span_hashes(points, first, last) ^ own[text]) if len(first) else np.zeros(0, np.uint64)
    keys[keys == 0] = 1
    return keys, text, np.cumsum(cut)[first], points, first, last


def tokenised(docs: DataFrame, shards: int = SHARDS) -> str:
    """Folder of a table (shard, tokens) and, in shard -1, (lang, key, word, n): names of words, and a row with key null for words of a language."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "tokens")

    def run(batches):
        held, count, named, totals = {}, 0, set(), {}

        def row(shard, tokens=None, names=None):
            n = len(names[0]) if names else 1
            lang, key, word, total = names or ([None], [None], [None], [None])
            return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([tokens] * n, pa.binary()), pa.array(lang, pa.string()), pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(total, pa.int64())], ["shard", "tokens", "lang", "key", "word", "n"])

        def flush():
            for shard, parts in held.items():
                tokens = np.concatenate(parts)
                yield row(shard, tokens[:BLOCK].tobytes())
                for at in range(BLOCK, len(tokens), BLOCK):  # a byte marks blocks that begin with the last words of the one before
                    yield row(shard, b"\x01" + tokens[at - SHARED : at + BLOCK].tobytes())
            held.clear()

        for batch in batches:
            names = ["und" if x is None else x for x in batch.column("lang").to_pylist()]
            codes = {x: lang_key(x) for x in set(names)}
            keys, text, piece, points, first, last = word_keys(batch.column("text").to_pylist(), [codes[x] for x in names])
            if not len(keys):
                continue
            shard = np.array(batch.column("shard").to_pylist(), np.int32)[text]
            for k, c in zip(*np.unique(text, return_counts=True), strict=True):
                totals[names[k]] = totals.get(names[k], 0) + int(c)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                turns = np.flatnonzero(np.diff(piece[mine])) + 1
                held.setdefault(s, []).append(np.append(np.insert(keys[mine], turns, 0), np.uint64(0)))
            count += len(keys)
            fresh, at = np.unique(keys.astype(np.int64), return_index=True)
            new = [(k, i) for k, i in zip(fresh.tolist(), at.tolist(), strict=True) if k not in named]
            if len(named) + len(new) > NAMED:
                named.clear()
            named.update(k for k, _ in new)
            if new:
                words = [points[first[i] : last[i]].tobytes().decode("utf-32-le", "surrogatepass") for _, i in new]
                yield row(-1, None, ([names[text[i]] for _, i in new], [k for k, _ in new], words, [None] * len(new)))
            if count > 2 * BLOCK:
                yield from flush()
                count = 0
        yield from flush()
        if totals:
            yield row(-1, None, (list(totals), [None] * len(totals), [None] * len(totals), list(totals.values())))

    own = F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int") if "doc_id" not in docs.columns else F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang", own.alias("shard"))
    rows.mapInArrow(run, "shard int, tokens binary, lang string, key long, word string, n long").write.partitionBy("shard").parquet(path)
    return path


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tokens binary, lang string, key long, word string, n long, shard int").parquet(path)


def opened(raw: bytes) -> tuple[np.ndarray, int]:
    """Tokens of a block, and the number of leading ones that the block before has counted."""
    over = len(raw) % 8
    return np.frombuffer(raw, np.uint64, offset=over), SHARED if over else 0


def grow(hashes: np.ndarray, tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words, from those of k - 1 words that begin at the same places."""
    return textvec.mix(hashes[: len(tokens) - k + 1] * np.uint64(0x9FB21C651E98DF25) + tokens[k - 1 :]) if len(tokens) >= k else tokens[:0]


def second(words: np.ndarray) -> np.ndarray:
    """Another 32 bits of phrases, from their word keys (one row a phrase)."""
    out = np.full(len(words), 0x51ED270B7A1C3A5F, np.uint64)
    for k in range(words.shape[1]):
        out = textvec.mix(out * np.uint64(0xE7037ED1A0B428DB) + words[:, k])
    return (out >> np.uint64(33)).astype(np.int32)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def phrases(tokens: np.ndarray, longest: int):
    """For each length: hashes of the phrases at all places, and whether a phrase (no zero, so no end of a piece) is there."""
    whole, hashes = tokens != 0, textvec.mix(tokens * np.uint64(0xA0761D6478BD642F) + np.uint64(7))
    inside = whole
    for k in range(1, longest + 1):
        if k > 1:
            hashes = grow(hashes, tokens, k)
            inside = inside[: len(hashes)] & whole[k - 1 :]
        yield k, hashes, inside


def _marked(rows: DataFrame, bits: int) -> pa.Table:
    """Slots of ``rows`` (k, h) as bits of 32-bit words: at most ``2 ** bits / 32`` rows for each length come to the driver."""
    slot = f"(h & {(1 << bits) - 1})"
    return rows.groupBy("k", F.expr(f"shiftright({slot}, 5)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 32 as int))")).alias("bits")).toArrow()


def _counted(tokens: DataFrame, steps, t: int, shards: int, longest: int, bits: int) -> DataFrame:
    """k, h, g, act, c of the active phrases of a shard."""

    def run(batches):
        reached = [np.frombuffer(decompress(r), np.uint8) for r in steps.value]
        for batch in batches:
            for raw in batch.column("tokens"):
                block, known = opened(raw.as_buffer().to_pybytes())
                before = None
                for k, hashes, inside in phrases(block, longest):
                    if k == 1:
                        act = np.where(inside & (t < shards), np.uint8(0), np.uint8(_NEVER))
                    else:
                        at = reached[k - 2][slots(before, bits)]
                        act = np.where(inside, np.maximum(at[:-1], at[1:]), np.uint8(_NEVER)) if len(hashes) else np.zeros(0, np.uint8)
                    before = hashes
                    live = np.flatnonzero((act <= t) & (t < act.astype(np.int32) + shards))
                    live = live[live + k > known]  # phrases of the shared words alone were counted before
                    if not len(live):
                        continue
                    h, one, c = np.unique(hashes[live], return_index=True, return_counts=True)
                    one = live[one]
                    g = second(np.stack([block[one + j] for j in range(k)], 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.astype(np.int64)), pa.array(g), pa.array(act[one].astype(np.int32)), pa.array(c)], ["k", "h", "g", "act", "c"])

    return tokens.mapInArrow(run, "k int, h long, g int, act int, c long")


def frequent(spark: SparkSession, path: str, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = FILTER_BITS) -> DataFrame:
    """k, h, g and f (exact count) of all phrases with at least ``least`` occurrences."""
    table, live, done = _table(spark, path), None, []
    reached = [np.full(1 << bits, _NEVER, np.uint8) for _ in range(longest - 1)]
    t, until = 0, shards
    while t < until:
        steps = spark.sparkContext.broadcast([compress(r.tobytes(), 1) for r in reached])
        seen = _counted(table.where(F.col("shard") == t % shards).select("tokens"), steps, t, shards, longest, bits)
        rows = seen.withColumn("known", F.lit(False))
        rows = rows if live is None else rows.unionByName(live)
        sums = rows.groupBy("k", "h", "g").agg(F.min("act").alias("act"), F.sum("c").alias("c"), F.max("known").alias("known"))
        sums = stored(sums.where((F.col("act") + shards - 1 > t) | (F.col("c") >= least)), "phrases")
        ended = F.col("act") + shards - 1 <= t
        done.append(sums.where(ended).select("k", "h", "g", F.col("c").alias("f")))
        live = sums.where(~ended).withColumn("known", F.col("c") >= least)
        fresh = sums.where((F.col("c") >= least) & ~F.col("known") & (F.col("k") < longest))
        found = _marked(fresh, bits)
        words = found.column("word").to_numpy() * 32
        sizes, masks = found.column("k").to_numpy(), found.column("bits").to_numpy()
        for k in range(1, longest):
            mine = sizes == k
            for j in range(32):
                at = words[mine][(masks[mine] >> j) & 1 == 1] + j
                reached[k - 1][at] = np.minimum(reached[k - 1][at], t + 1)
        t += 1
        if len(words):
            until = max(until, t + shards)
        steps.destroy()
    return reduce(DataFrame.unionByName, done)


def _worded(spark: SparkSession, path: str, kept: DataFrame, longest: int, bits: int) -> DataFrame:
    """``kept`` (k > 1) with w1, w2, ...: the word keys; one more scan, filtered by slots of the kept phrases."""
    found = _marked(kept, bits)
    marks = np.zeros((longest + 1, 1 << bits >> 5), np.uint32)
    marks[found.column("k").to_numpy(), found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(compress(marks.tobytes(), 1))
    names = [f"w{j + 1}" for j in range(longest)]

    def run(batches):
        marks = np.frombuffer(decompress(shared.value), np.uint32).reshape(longest + 1, -1)
        for batch in batches:
            for raw in batch.column("tokens"):
                block, _ = opened(raw.as_buffer().to_pybytes())
                for k, hashes, inside in phrases(block, longest):
                    if k == 1 or not len(hashes):
                        continue
                    at = slots(hashes, bits)
                    live = np.flatnonzero(inside & ((marks[k][at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1))
                    if not len(live):
                        continue
                    h, one = np.unique(hashes[live], return_index=True)
                    words = np.stack([block[live[one] + j] for j in range(k)], 1)
                    columns = [pa.array(words[:, j].astype(np.int64)) if j < k else pa.nulls(len(h), pa.int64()) for j in range(longest)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.astype(np.int64)), pa.array(second(words)), *columns], ["k", "h", "g", *names])

    rows = _table(spark, path).where("shard >= 0").select("tokens").mapInArrow(run, "k int, h long, g int, " + ", ".join(f"{w} long" for w in names))
    return kept.join(rows.groupBy("k", "h", "g").agg(*[F.min(w).alias(w) for w in names]), ["k", "h", "g"])


def _parts(rows: DataFrame, longest: int) -> DataFrame:
    """For each phrase its contiguous parts: from the word ``at`` on, ``pk`` words, with the hashes ph and pg."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("k").to_numpy()
            words = np.stack([batch.column(f"w{j + 1}").fill_null(0).to_numpy(zero_copy_only=False) for j in range(longest)], 1).astype(np.uint64)
            for k in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == k)
                own = batch.take(pa.array(mine))
                for at in range(k):
                    for pk in range(1, k - at + (at > 0)):
                        part = words[mine, at : at + pk]
                        h = textvec.mix(part[:, 0] * np.uint64(0xA0761D6478BD642F) + np.uint64(7))
                        for j in range(1, pk):
                            h = textvec.mix(h * np.uint64(0x9FB21C651E98DF25) + part[:, j])
                        fill = lambda v: pa.array(np.full(len(mine), v, np.int32))
                        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("k", "h", "g", "f")), fill(at), fill(pk), pa.array(h.astype(np.int64)), pa.array(second(part))], ["k", "h", "g", "f", "at", "pk", "ph", "pg"])

    return rows.mapInArrow(run, "k int, h long, g int, f long, at int, pk int, ph long, pg int")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, shards: int = SHARDS, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of ``docs`` (text, lang)."""
    if not 2 <= longest <= SHARED + 1:
        raise ValueError(f"phrases have 2 to {SHARED + 1} words at most")
    spark = docs.sparkSession
    path = tokenised(docs, shards)
    counts = stored(frequent(spark, path, least, longest, shards, bits), "frequent")
    worded = stored(_worded(spark, path, counts.where("k > 1"), longest, bits), "worded")
    parts = stored(_parts(worded, longest), "parts")
    of_part = counts.select(F.col("k").alias("pk"), F.col("h").alias("ph"), F.col("g").alias("pg"), F.col("f").alias("pf"))
    cuts = parts.where("at = 0 or at + pk = k").join(of_part, ["pk", "ph", "pg"])
    cut = F.when(F.col("at") == 0, F.col("pk")).otherwise(F.col("at"))
    sides = cuts.groupBy("k", "h", "g", "f", cut.alias("cut")).agg(F.max(F.when(F.col("at") == 0, F.col("pf"))).alias("l"), F.max(F.when(F.col("at") > 0, F.col("pf"))).alias("r"))
    wide = lambda c: c.cast("decimal(19,0)")
    sides = sides.withColumn("doubled", (wide(F.col("f")) * F.lit(2_000_000).cast("decimal(10,0)")).cast("decimal(38,0)")).withColumn("both", (wide(F.col("l")) + wide(F.col("r"))).cast("decimal(38,0)"))
    scored = sides.withColumn("score", F.expr("doubled div both")).groupBy("k", "h", "g", "f").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    around = parts.where("pk > 1").groupBy(F.col("pk").alias("k"), F.col("ph").alias("h"), F.col("pg").alias("g")).agg(F.max("f").alias("longer"))
    kept = scored.join(around, ["k", "h", "g"], "left").where(F.expr(f"longer is null or cast(100 as decimal(10,0)) * longer < cast({inside} as decimal(10,0)) * f"))
    names = _table(spark, path).where("shard = -1 and key is not null").groupBy("key").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))
    totals = _table(spark, path).where("shard = -1 and key is null").groupBy("lang").agg(F.sum("n").alias("n"))
    rows = kept.join(worded.select("k", "h", "g", *[f"w{j + 1}" for j in range(longest)]), ["k", "h", "g"])
    rows = stored(rows.join(names.select(F.col("key").alias("w1"), "lang"), "w1"), "scored")
    # the best by score and count, ties included, without their names; then their names, and the ties' order
    salted = Window.partitionBy("lang", "salt").orderBy(F.desc("low.score"), F.desc("f"))
    near = rows.withColumn("salt", F.pmod("h", F.lit(64))).withColumn("place", F.rank().over(salted)).where(F.col("place") <= top)
    words = near.select("lang", "k", "h", "g", "f", "low", F.posexplode(F.array(*[f"w{j + 1}" for j in range(longest)])).alias("place", "key")).where("key is not null")
    told = words.join(names.select("key", "word"), "key").groupBy("lang", "k", "h", "g", "f", "low").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("low.score"), F.desc("f"), F.asc("phrase")]
    first = told.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy(*order))).where(F.col("place") <= top)
    # at most 64 * top rows a language
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang HAVING sum(len(w)) > 0),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, {LONGEST + 1}) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, CAST(k AS INTEGER) AS k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, c, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp AND l.k = c JOIN f r ON r.lang = cuts.lang AND r.phrase = rp AND r.k = cuts.k - c),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, m AS k, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inner_parts p ON p.lang = low.lang AND p.k = low.k AND p.phrase = low.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {INSIDE} * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
