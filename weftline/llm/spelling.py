"""Spelling variants by a variable-length gram index.

1. Words. A narrow pass counts each document's words in the task; only sums of words are shuffled.
2. Gram dictionary. Words are padded by two marks on each side. Grams have ``SHORT`` to ``LONG`` code points; a gram is
   extended only while it begins more than ``FREQUENT`` places in the words (or so many that the extended grams stay
   within the broadcast bound). So frequent short grams give way to longer, rarer ones.
3. Decomposition. From each place of a word the longest gram is taken, unless an earlier one covers it. Where a gram ends
   depends on its own code points alone, so an edit touches a gram only if it lies in it, or before it and so near that a
   longer gram might come to cover it. The greatest number of grams that any one edit touches is the word's bound;
   what is left is the least number of grams that a near word shares. With two marks, four code points in a gram and
   words of five, the first or the last gram always outlives an edit, so this number is 1 at least.
4. List merging. Words meet in lists keyed by gram, place and length: a shared gram has the same place, or is one
   place further in the longer word. Of the rarest grams a word enters as many as its bound asks for (prefix filter), so
   that near words meet ``SHARED`` times, or as often as their grams allow. Meetings are counted; a mask of letters drops most others at
   the list. What is left is verified by edit distance.
5. Forms and roots. A form has at least twice the occurrences, so forms lead upwards; roots are found by doubling.

Defined cases. Null text: no words. Null ``doc_id``: ``null`` in the hash. Repeated rows: each counts. Texts and runs of any
length are whole. No near word: form null, the root is the word itself. Ties of forms: the smallest by code points.
Empty table: no rows. Other columns are ignored. Lists are spread by Spark's join; no word is left out of one.
"""

from __future__ import annotations

import re
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import BROADCAST_ROWS, read, stored

QUERY = "op11_spelling"
#: Code points of a word and its occurrences, at least; a run whose hash this number divides loses a code point.
LENGTH, LEAST, SLIP = 5, 3, 97
#: Code points of a gram; places of a gram that is not extended; grams by which near words meet.
SHORT, LONG, FREQUENT, SHARED = 2, 4, 64, 1
#: Words that a task counts before it hands on its sums.
HELD = 1 << 19
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_HEAD, _TAIL = "\x01\x02", "\x03\x04"


def count_words(docs: DataFrame, slip: int = SLIP, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n of the words of ``docs`` (doc_id, text)."""

    def run(batches):
        sums: dict[str, int] = {}

        def rows():
            words = list(sums)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([sums[w] for w in words], pa.int64())], ["word", "n"])
            sums.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own: dict[str, int] = {}
                for found in _RUN.findall(text):
                    own[found] = own.get(found, 0) + 1
                before = crc32(f"{doc}:".encode())
                for found, n in own.items():
                    raw = found.encode().lower()  # of bytes only A to Z change
                    h = crc32(raw, before)
                    word = raw.decode()
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= length:
                        sums[word] = sums.get(word, 0) + n
                if len(sums) > HELD:
                    yield rows()
        yield rows()

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def extended_grams(words: DataFrame, frequent: int = FREQUENT, bound: int = BROADCAST_ROWS) -> frozenset[str]:
    """Grams of SHORT to LONG - 1 code points that begin more than ``frequent`` places of the padded words.

    At most ``bound`` come to the driver: beyond, the threshold doubles, and lists get longer instead.
    """
    padded = F.concat(F.lit(_HEAD), "word", F.lit(_TAIL))
    sized = words.select(padded.alias("w")).select("w", F.explode(F.sequence(F.lit(SHORT), F.lit(LONG - 1))).alias("q"))
    grams = sized.select(F.explode(F.expr("transform(sequence(1, length(w) - q), i -> substring(w, i, q))")).alias("g"))
    counts = stored(grams.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > frequent), "grams")
    while counts.where(F.col("n") > frequent).count() > bound:
        frequent *= 2
    return frozenset(r.g for r in counts.where(F.col("n") > frequent).select("g").collect())


def decompose(padded: str, extended) -> list[tuple[int, int]]:
    """(start, end) of the word's grams, in order."""
    out, reach, m = [], 0, len(padded)
    for at in range(m - SHORT + 1):
        end = at + SHORT
        while end < m and end - at < LONG and padded[at:end] in extended:
            end += 1
        if end > reach:
            out.append((at, end))
            reach = end
    return out


def touched(padded: str, grams: list[tuple[int, int]], endings) -> int:
    """The most grams that one edit of the word can take away; ``endings``: proper endings of extended grams."""
    most = 0
    for i in range(len(_HEAD), len(padded) - len(_TAIL) + 1):
        inserted = replaced = 0
        for a, b in grams:
            # an earlier gram that reaches over the edit must be extended up to the one before the last code point
            if a < i < b or (a >= i and b - i + 1 <= LONG and padded[i : b - 1] in endings):
                inserted += 1
            if a <= i < b or (a > i and b - i <= LONG and padded[i + 1 : b - 1] in endings):
                replaced += 1
        most = max(most, inserted, replaced if i < len(padded) - len(_TAIL) else 0)
    return most


def gram_index(words: DataFrame, extended: frozenset[str]) -> DataFrame:
    """word, n, mask, gram, place, length, bound and need: a row for each gram of each word."""
    spark = words.sparkSession
    endings = frozenset(g[k:] for g in extended for k in range(1, len(g)))
    shared = spark.sparkContext.broadcast((extended, endings))

    def run(batches):
        extended, endings = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                padded = _HEAD + word + _TAIL
                grams = decompose(padded, extended)
                bound = touched(padded, grams, endings)
                mask = 0
                for c in word:
                    mask |= 1 << ord(c) % 63
                rows += [(word, n, mask, padded[a:b], a, len(word), bound, len(grams) - bound) for a, b in grams]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "mask", "gram", "place", "length", "bound", "need"])

    return words.mapInArrow(run, "word string, n long, mask long, gram string, place int, length int, bound int, need int")


def near_pairs(words: DataFrame, frequent: int = FREQUENT, shared: int = SHARED) -> DataFrame:
    """a, an, b, bn: each pair of ``words`` (word, n) that differ by one code point, once. Words have LENGTH code points at least."""
    index = stored(gram_index(words, extended_grams(words, frequent)), "index")
    sizes = index.groupBy("gram").agg(F.count("*").alias("size"))
    # rank() gives all places of a gram the same number, so a word enters a gram with all its places
    rarest = F.rank().over(Window.partitionBy("word").orderBy("size", "gram"))
    entered = index.join(sizes, "gram").withColumn("order", rarest).where(F.col("order") <= F.col("bound") + shared)
    entered = stored(entered.select("word", "n", "mask", "gram", "place", "length", "need"), "entered")
    short = entered.select(
        F.col("word").alias("a"), F.col("n").alias("an"), F.col("mask").alias("am"), F.col("need").alias("ad"), "gram", F.col("length").alias("own"),
        F.explode(F.expr("array(named_struct('place', place, 'length', length), named_struct('place', place, 'length', length + 1), named_struct('place', place + 1, 'length', length + 1))")).alias("to"))
    short = short.select("a", "an", "am", "ad", "gram", "own", F.col("to.place").alias("place"), F.col("to.length").alias("length"))
    long = entered.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.col("mask").alias("bm"), F.col("need").alias("bd"), "gram", "place", "length")
    once = (F.col("own") < F.col("length")) | (F.col("a") < F.col("b"))
    alike = F.bit_count(F.col("am").bitwiseXOR(F.col("bm"))) <= F.when(F.col("own") < F.col("length"), 1).otherwise(2)
    met = short.join(long, ["gram", "place", "length"]).where(alike & once).groupBy("a", "b").agg(F.first("an").alias("an"), F.first("bn").alias("bn"), F.first("ad").alias("ad"), F.first("bd").alias("bd"), F.count("*").alias("met"))
    merged = met.where(F.col("met") >= F.least(F.lit(shared), F.greatest("ad", "bd")))
    return merged.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn")


def variants(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """word, n, form, form_n, n_near and root of ``words`` (word, n; distinct)."""
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words, frequent), "pairs")
    ends = pairs.select("a", "an", "b", "bn").unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = ends.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    held = -F.col("best.less") >= 2 * F.col("n")
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("best.form")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n")), "formed")
    # word -> a word further up, doubled until no word moves: occurrences at least double with each form
    up = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stored(up.join(above, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(read(spark, sf_dir, "documents")))
