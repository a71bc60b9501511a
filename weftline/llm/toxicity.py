"""Toxicity: class-conditional Kneser-Ney character models of toxic and ordinary labelled text.

Both classes have an interpolated Kneser-Ney model of characters given the ``ORDER - 1`` before. What a class
has not seen backs off to one distribution that both share: continuation counts of both classes' grams, by
Kneser-Ney recursion over all lower orders down to single characters. So rare expressions weigh alike on both
sides; a character that neither class has seen in its context still has the ratio of the two backoff weights
of that context. ``SHARED_MASS`` pseudo-counts of the shared distribution in every context damp what few texts
have shown, and ordinary counts are scaled to the toxic class's size, as the larger class would otherwise back
off less and make all that is new look toxic. Every character of a text then has a log-likelihood ratio, and a
word their sum. A text is described by its ratio a character, by what its words have above a bound, a word, and
by its most toxic word and the mean of its three most toxic; a logistic function turns these into a score.

Labelled rows are split by ``crc32(doc_id as text) % 5``: 0 is held out and never read, 1 to 3 give the
counts, 4 fits the logistic function on at most ``CALIBRATION_ROWS`` rows (chosen by hash). Counts cover
every labelled text of folds 1 to 3 whole. A gram is packed into one integer of ``ORDER`` characters of 12
bits (code points from 4096 on are folded), so contexts and suffixes are bit shifts and the whole estimate
is group-bys and joins on integers. Scoring looks ratios up by whole keys: in sorted arrays that are broadcast
where a count shows at most ``BROADCAST_GRAMS`` of them, else by a shuffled join of the grams of each chunk of
texts (about ``CHUNK_CHARS`` characters, dealt by a hash of the row) with the ratios. Both give the same scores.

Defined cases. Null or empty text: the score of a text without words. Null ``doc_id``: scored, never
learned from, not held out. A document with several label rows counts as toxic if any says 1. No toxic
or no ordinary labelled text: all ratios are 0 and scores come from the prior. Long texts are cut into
windows for the arrays only; no character is skipped. Empty table: no rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textvec
from weftline.llm.common import join_bounded, read, stored

QUERY = "op8_toxicity"
#: Characters in a gram, and bits of a character.
ORDER, BITS = 5, 12
#: Ratios (12 bytes each) are broadcast up to so many; beyond, chunks of about so many characters meet theirs in a join.
BROADCAST_GRAMS, CHUNK_CHARS = 1 << 22, 1 << 25
#: At most so many labelled rows fit the logistic function.
CALIBRATION_ROWS = 20_000
#: Pseudo-counts of the shared distribution in each context of a class.
SHARED_MASS = 30.0
#: Discount of continuation counts in the lower orders.
LOWER_DISCOUNT = 0.75
#: Set in the keys of contexts, whose ratio is that of the classes' backoff weights.
CONTEXT = 1 << (ORDER * BITS)
#: A word's ratio counts towards the excess between these bounds.
WORD_LOW, WORD_HIGH = 1.5, 6.5
#: Logistic weights before any label is seen (bias, mean, excess, top word, top three), and how firmly they hold.
PRIOR, PRIOR_STRENGTH = (-5.0, 1.0, 1.0, 0.3, 0.5), 0.3
FEATURES = 4
#: Texts that are turned into arrays at once when counting.
PART_TEXTS = 128
#: Grams that a counting task holds before it adds them up, and gives out sums if more than half are left.
HELD_GRAMS = 1 << 20
_PAD = "\n" * (ORDER - 1)
_LOW = (1 << BITS) - 1


def fold(doc_id):
    """0 to 4 for a column of ids; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed gram ending at each character, its text, and the number of its word (texts in order)."""
    padded = [_PAD + " " + ("" if t is None else t.lower()) + " " for t in texts]
    points, starts = textvec.code_points(padded)
    points[(points == 9) | (points == 10) | (points == 13)] = 32
    folded = np.where(points < 4096, points, 2048 + points % 2048).astype(np.int64)
    keys = folded.copy()
    for k in range(1, ORDER):
        keys[k:] |= folded[:-k] << (BITS * k)
    text = np.repeat(np.arange(len(padded)), np.diff(starts))
    inside = np.ones(len(points), bool)
    for k in range(ORDER):
        inside[starts[:-1] + k] = False  # padding and the first space
    inside[starts[1:] - 1] = False
    # a word is its characters with the space after it; blank runs add to the word before
    fresh = (points != 32) & (np.concatenate(([32], points[:-1])) == 32)
    fresh[starts[:-1]] = True
    return keys[inside], text[inside], np.cumsum(fresh)[inside]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(key, tox, ord): counts of every gram in toxic and in ordinary texts; ``docs`` has text, toxic."""

    def emit(keys, tox, both):
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(tox[part]), pa.array(both[part] - tox[part])], ["key", "tox", "ord"])

    def merged(held):
        """Sums by key of lists of (keys, tox, both)."""
        keys, of = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = [np.bincount(of, np.concatenate([h[k] for h in held]), len(keys)).astype(np.int64) for k in (1, 2)]
        return keys, *sums

    def count(batches):
        held, size = [], 0
        for batch in batches:
            texts, bad = batch.column("text").to_pylist(), [x == 1 for x in batch.column("toxic").to_pylist()]
            for at in range(0, len(texts), PART_TEXTS):
                part = slice(at, at + PART_TEXTS)
                found, text, _ = _grams(texts[part])
                marked = np.array(bad[part], np.int64)[text] if len(found) else np.zeros(0, np.int64)
                held.append(merged([(found, marked, np.ones(len(found), np.int64))]))
                size += len(held[-1][0])
                if size > HELD_GRAMS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD_GRAMS:  # partial sums: the shuffle adds them up
                        yield from emit(*held[0])
                        held, size = [], 0
        if held:
            yield from emit(*merged(held))

    parts = docs.select("text", "toxic").mapInArrow(count, "key long, tox long, ord long")
    return parts.groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


def _discount(ones: int, twos: int) -> float:
    """Absolute discount from counts of counts, kept inside (0, 1)."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def _last(n: int):
    """The last ``n`` characters of the key."""
    return F.expr(f"key & {(1 << n * BITS) - 1}L")


def lower_orders(grams: DataFrame) -> DataFrame:
    """(key, p) of every suffix of ``ORDER - 1`` characters of the distinct ``grams``: the chance of its last
    character after the others, from the number of different characters that come before each suffix."""
    levels = []
    for n in range(ORDER - 1, 0, -1):
        grams = stored(grams.groupBy(_last(n).alias("key")).agg(F.count("*").alias("cont")), "toxicity-suffixes")
        levels.append((n, grams))
    _, single = levels.pop()
    total = single.agg(F.sum("cont").alias("all"))
    found = single.crossJoin(F.broadcast(total)).select("key", (F.col("cont") / F.col("all")).alias("p"))
    for n, level in reversed(levels):
        contexts = level.groupBy(F.shiftright("key", BITS).alias("ctx")).agg(F.sum("cont").alias("all"), F.count("*").alias("kinds"))
        placed = level.withColumn("ctx", F.shiftright("key", BITS)).withColumn("low", _last(n - 1)).join(contexts, "ctx")
        both = placed.join(found.select(F.col("key").alias("low"), F.col("p").alias("p_low")), "low")
        p = (F.greatest(F.col("cont") - LOWER_DISCOUNT, F.lit(0.0)) + LOWER_DISCOUNT * F.col("kinds") * F.col("p_low")) / F.col("all")
        found = both.select("key", p.alias("p"))
    return found


def log_ratios(counts: DataFrame) -> DataFrame:
    """(key, llr): log P(toxic model) - log P(ordinary model) of every gram that either class has, and of every
    context (``CONTEXT`` is set in its key) log of the ratio of the classes' backoff weights.

    Empty where a class has no text at all.
    """
    counts = stored(counts, "toxicity-grams")
    totals = counts.agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"), *[F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in ("tox", "ord") for n in (1, 2)]).first()
    balance = totals.tox / totals.ord if totals.tox and totals.ord else 0.0
    scale = {"tox": 1.0, "ord": balance}
    discounts = {c: scale[c] * _discount(totals[f"{c}1"], totals[f"{c}2"]) for c in scale}
    grams = counts.where(F.lit(bool(balance))).select("key", "tox", "ord", F.shiftright("key", BITS).alias("ctx"), _last(ORDER - 1).alias("suf"))
    # whole counts are summed before they are scaled, so sums do not depend on the order of rows
    context = grams.groupBy("ctx").agg(*[f for c in scale for f in ((F.sum(c) * scale[c]).alias(f"{c}_all"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))])
    weight = {c: (d * F.col(f"{c}_kinds") + SHARED_MASS) / (F.col(f"{c}_all") + SHARED_MASS) for c, d in discounts.items()}
    context = stored(context.select("ctx", "tox_all", "ord_all", weight["tox"].alias("tox_back"), weight["ord"].alias("ord_back")), "toxicity-contexts")

    def p(c: str):
        return F.greatest(F.col(c) * scale[c] - discounts[c], F.lit(0.0)) / (F.col(f"{c}_all") + SHARED_MASS) + F.col(f"{c}_back") * F.col("p")

    shared = lower_orders(grams.select("key")).withColumnRenamed("key", "suf")
    seen = grams.join(context, "ctx").join(shared, "suf").select("key", (F.log(p("tox")) - F.log(p("ord"))).alias("llr"))
    return seen.unionByName(context.select(F.col("ctx").bitwiseOR(F.lit(CONTEXT)).alias("key"), (F.log("tox_back") - F.log("ord_back")).alias("llr")))


def ratio_table(ratios: DataFrame) -> DataFrame | tuple[np.ndarray, np.ndarray]:
    """The ratios as sorted keys and values where a count shows that they may be broadcast, else as a table."""
    ratios = stored(ratios.select("key", F.col("llr").cast("float").alias("llr")), "toxicity-ratios")
    return _arrays(ratios.toArrow()) if ratios.count() <= BROADCAST_GRAMS else ratios


def _arrays(found) -> tuple[np.ndarray, np.ndarray]:
    keys, values = found.column("key").to_numpy(), found.column("llr").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, missing) -> np.ndarray:
    """The value of each key among the sorted ``known``, else ``missing``."""
    if not len(known):
        return np.full(len(keys), missing, float)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at].astype(float), missing)


def _ratios(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each gram: its own, else its context's, else 0 (both classes back off)."""
    found = _look_up(keys, known, values, np.nan)
    new = np.flatnonzero(np.isnan(found))
    found[new] = _look_up(CONTEXT | keys[new] >> BITS, known, values, 0.0)
    return found


def _features(texts, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per text: ratio a character, excess a word (times 20), most toxic word, mean of the three most toxic."""
    keys, text, word = _grams(texts)
    n = len(texts)
    out = np.zeros((n, FEATURES))
    if not len(keys):
        return out
    ratio = _ratios(keys, *table)
    out[:, 0] = np.bincount(text, ratio, n) / np.maximum(1, np.bincount(text, minlength=n))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    total, of = np.add.reduceat(ratio, first), text[first]
    out[:, 1] = 20 * np.bincount(of, np.clip(total - WORD_LOW, 0, WORD_HIGH - WORD_LOW), n) / np.maximum(1, np.bincount(of, minlength=n))
    order = np.lexsort((-total, of))
    total, of = total[order], of[order]
    start, end = np.searchsorted(of, np.arange(n)), np.searchsorted(of, np.arange(n), "right")
    for k in range(3):
        has = end - start > k
        out[has, 3] += total[start[has] + k] / 3
        if k == 0:
            out[has, 2] = total[start[has]]
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, held to the prior."""
    prior = np.array(PRIOR)
    x, w = np.column_stack((np.ones(len(x)), x)), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - PRIOR_STRENGTH * (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + PRIOR_STRENGTH * np.eye(len(w)), slope)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scored(docs: DataFrame, extra: list[str], schema: str, table, finish) -> DataFrame:
    """``extra`` columns and what ``finish`` makes of the features of text."""
    docs = docs.select("text", *[c for c in extra if c != "text"])
    names = [f.partition(" ")[0].strip() for f in schema.split(", ")]

    def rows(batch, known):
        return pa.RecordBatch.from_arrays([batch.column(c) for c in extra] + finish(_features(batch.column("text").to_pylist(), known)), names)

    if isinstance(table, DataFrame):
        return _scored_by_chunk(docs, schema, table, rows)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return docs.mapInArrow(lambda batches: (rows(batch, shared.value) for batch in batches), schema)


def _chunk_grams(docs: DataFrame) -> DataFrame:
    """(tx_chunk, key): the distinct grams and contexts of each chunk; ``docs`` has tx_chunk, text."""

    def distinct(batches):
        for batch in batches:
            texts, chunks = batch.column("text").to_pylist(), batch.column("tx_chunk").to_numpy()
            for start in range(0, len(texts), PART_TEXTS):
                keys, text, _ = _grams(texts[start : start + PART_TEXTS])
                of = np.tile(chunks[start:][text], 2)
                keys = np.concatenate((keys, CONTEXT | keys >> BITS))
                order = np.lexsort((keys, of))
                keys, of = keys[order], of[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
                keys, of = keys[fresh], of[fresh]
                for at in range(0, len(keys), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(of[at : at + 50_000]), pa.array(keys[at : at + 50_000])], ["tx_chunk", "key"])

    return docs.select("tx_chunk", "text").mapInArrow(distinct, "tx_chunk long, key long").distinct()


def _found(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(tx_chunk, key, llr) of the wanted grams that have a ratio."""
    return wanted.join(table, "key").select("tx_chunk", "key", "llr")


def _scored_by_chunk(docs: DataFrame, schema: str, table: DataFrame, rows) -> DataFrame:
    """Each chunk's ratios go before its texts, in one stream a task; no more than one chunk's are held."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunked = docs.withColumn("tx_chunk", F.pmod(F.xxhash64(*docs.columns), F.lit(1 + chars // CHUNK_CHARS)))
    ratios = _found(_chunk_grams(chunked), table).select("tx_chunk", F.col("key").alias("tx_key"), F.col("llr").alias("tx_llr"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    texts = chunked.select("tx_chunk", F.lit(None).cast("long").alias("tx_key"), F.lit(None).cast("float").alias("tx_llr"), *docs.columns)
    dealt = ratios.unionByName(texts).repartition("tx_chunk").sortWithinPartitions("tx_chunk", F.col("tx_key").isNull(), "tx_key")

    def score(batches):
        chunk, keys, values, known = None, [], [], None
        for batch in batches:
            at, is_key = batch.column("tx_chunk").to_numpy(), batch.column("tx_key").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (is_key[1:] != is_key[:-1])) + 1
            for a, b in pairwise([0, *cuts.tolist(), len(at)]):
                part = batch.slice(a, b - a)
                if b > a and at[a] != chunk:
                    chunk, keys, values, known = at[a], [], [], None
                if b > a and is_key[a]:
                    keys.append(part.column("tx_key").to_numpy())
                    values.append(part.column("tx_llr").to_numpy())
                elif b > a:
                    if known is None:
                        known = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.float32), *values])
                        keys, values = [], []
                    yield rows(part, known)

    return dealt.mapInArrow(score, schema)


class Model:
    """A fitted model: the ratios and the logistic weights."""

    def __init__(self, table, weights: np.ndarray):
        self.table, self.weights = table, weights

    def score(self, docs: DataFrame, keep: list[tuple[str, str]], text: bool = False) -> DataFrame:
        """``keep`` columns (name, type) of every row of ``docs``, with score, and with text if asked for."""
        w = self.weights
        keep = [*keep, ("text", "string")] if text else keep

        def finish(x):
            total = w[0]
            for k in range(FEATURES):  # in this order whatever the batch, so a text's score is always the same
                total = total + x[:, k] * w[k + 1]
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))]

        return _scored(docs, [c for c, _ in keep], ", ".join([f"{c} {t}" for c, t in keep] + ["score double"]), self.table, finish)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents of folds 1 to 4."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("fold", fold(F.col("doc_id"))).where("fold > 0")
    marked = join_bounded(docs.select("doc_id", "text"), marks, "doc_id", "inner")
    table = ratio_table(log_ratios(gram_counts(marked.where("fold < 4"))))
    # described before they are chosen, so that what meets in one task is numbers, not texts
    described = _scored(marked.where("fold = 4"), ["doc_id", "toxic"], "doc_id long, toxic int, a double, b double, c double, d double", table, lambda x: [pa.array(x[:, k]) for k in range(FEATURES)])
    rows = described.orderBy(F.xxhash64("doc_id"), "doc_id", "a", "b", "c", "d").limit(CALIBRATION_ROWS).toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in "abcd"]) if rows.num_rows else np.zeros((0, FEATURES))
    return Model(table, _fit(x, rows.column("toxic").to_numpy().astype(float)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return fit(rows, labels).score(rows, [("doc_id", "long")]).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
