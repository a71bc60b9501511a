"""Toxicity: the language model against dictionaries, held-out accuracy, edge cases."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftline.llm import toxicity as t


def grams(text):
    padded = "     " + text.lower() + " "
    return [padded[k - 4 : k + 1] for k in range(5, len(padded))]


def key(g):
    out = 0
    for ch in g:
        out = out << t.BITS | ord(ch)
    return out


class Plain:
    """Both models as dictionaries, straight from their definition."""

    def __init__(self, bad, fine):
        self.counts = [Counter(g for x in texts for g in grams(x)) for texts in (bad, fine)]
        self.every = set(self.counts[0]) | set(self.counts[1])
        scale = sum(self.counts[0].values()) / sum(self.counts[1].values())
        self.scales, self.discounts = (1.0, scale), []
        for c, r in zip(self.counts, self.scales, strict=True):
            ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            self.discounts.append(r * min(0.95, max(0.1, ones / (ones + 2 * twos))))
        self.levels, above = {}, self.every
        for n in (4, 3, 2, 1):
            self.levels[n] = Counter(g[-n:] for g in above)
            above = set(self.levels[n])

    def lower(self, s):
        level = self.levels[len(s)]
        if len(s) == 1:
            return level[s] / sum(level.values())
        same = [x for x in level if x[:-1] == s[:-1]]
        d = t.LOWER_DISCOUNT
        return (max(level[s] - d, 0) + d * len(same) * self.lower(s[1:])) / sum(level[x] for x in same)

    def back(self, k, ctx):
        same = [x for x in self.counts[k] if x[:4] == ctx]
        n = self.scales[k] * sum(self.counts[k][x] for x in same)
        return (self.discounts[k] * len(same) + t.SHARED_MASS) / (n + t.SHARED_MASS), n

    def ratio(self, g):
        """Of a gram that either class has; of another the shared factor cancels."""
        (a, na), (b, nb) = self.back(0, g[:4]), self.back(1, g[:4])
        if g not in self.every:
            return math.log(a) - math.log(b)
        p = [max(self.scales[k] * self.counts[k][g] - self.discounts[k], 0) / (n + t.SHARED_MASS) + w * self.lower(g[1:]) for k, (w, n) in enumerate(((a, na), (b, nb)))]
        return math.log(p[0]) - math.log(p[1])


BAD, FINE = ["you idiot go", "idiot twice idiot", "go you"], ["you are fine", "we go there", "are you there", "fine fine we are fine"]


def table_of(spark):
    docs = spark.createDataFrame([(x, 1) for x in BAD] + [(x, 0) for x in FINE], "text string, toxic int")
    return t.log_ratios(t.gram_counts(docs))


def test_ratios_against_dictionaries(spark):
    got = {r.key: r.llr for r in table_of(spark).collect()}
    plain = Plain(BAD, FINE)
    contexts = {g[:4] for g in plain.every}
    assert set(got) == {key(g) for g in plain.every} | {t.CONTEXT | key(c) for c in contexts}
    for g in plain.every:
        assert got[key(g)] == pytest.approx(plain.ratio(g), abs=1e-9)
    for c in contexts:
        assert got[t.CONTEXT | key(c)] == pytest.approx(math.log(plain.back(0, c)[0]) - math.log(plain.back(1, c)[0]), abs=1e-9)


def test_lower_orders_sum_to_one(spark):
    plain = Plain(BAD, FINE)
    for n in (1, 2, 3, 4):
        for ctx in {s[:-1] for s in plain.levels[n]}:
            assert sum(plain.lower(ctx + c) for c in plain.levels[1] if n == 1 or ctx + c in plain.levels[n]) <= 1 + 1e-9


def test_features_against_dictionaries(spark):
    """Texts with grams and contexts that no labelled text has, scored word by word."""
    plain = Plain(BAD, FINE)
    texts = ["you idiots go", "zzz unseen words", "we are fine idiot", "", "Idiot"]
    got = t._features(texts, t.ratio_table(table_of(spark)))
    for k, text in enumerate(texts):
        each = [plain.ratio(g) for g in grams(text)]
        words, at = [], 0
        for w in text.split():
            words.append(sum(each[at : at + len(w) + 1]))
            at += len(w) + 1
        words = words or [sum(each)]  # a text without words is one blank
        top = sorted(words, reverse=True)[:3]
        extra = 20 * sum(min(max(w - t.WORD_LOW, 0), t.WORD_HIGH - t.WORD_LOW) for w in words) / len(words)
        assert got[k] == pytest.approx([sum(each) / len(each), extra, top[0], sum(top) / 3], abs=1e-5)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abab abba", 1), ("baab", 0)], "text string, toxic int")
    counts = {r.key: (r.tox, r.ord) for r in t.gram_counts(docs).collect()}
    assert sum(x for x, _ in counts.values()) == 10 and sum(x for _, x in counts.values()) == 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = t.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    english = [r.predicted for r in rows if r.toxic == 1 and r.lang == "en"]
    toxic, fine = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) > 20
    assert sum(english) >= 0.85 * len(english) and sum(toxic) >= 0.6 * len(toxic) and sum(fine) <= 0.02 * len(fine)


def test_cases(spark):
    labels = [(k, k % 2) for k in range(40)] + [(3, 0), (None, 1), (7, None)]
    docs = [(k, "what an utter moron" if k % 2 else "what a lovely day", "x") for k in range(40)] + [(None, "moron", "x"), (50, None, "x"), (51, "", "x"), (3, "again", "x"), (52, "Ä\n moron " * 3000, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    out = t.toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0)
    empty = t.toxicity(frame.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.count() == 0
    flat = t.toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(flat) == len(docs) and all(np.isfinite(r.score) for r in flat)


def test_ratios_are_looked_up_by_whole_keys(spark):
    """Four million ordinary grams take no slot from others; in a table of 2 ** 23 slots many would meet."""
    n = 1 << 22
    ratios = spark.range(n).select((F.col("id") * 3).alias("key"), (F.col("id") % 1000).cast("double").alias("llr"), F.lit(1).cast("long").alias("seen"))
    table = t.ratio_table(ratios)
    asked = np.arange(0, 3 * n, 7919)
    assert (t._look_up(asked, *table, 0.0) == np.where(asked % 3 == 0, asked // 3 % 1000, 0)).all()


def test_same_scores_by_broadcast_and_by_join(spark, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    docs = [(k, f"what an utter moron {k}" if k % 2 else f"what a lovely day {k * 77}") for k in range(60)] + [(None, "moron"), (None, "moron"), (61, None), (62, ""), (3, "again"), (63, "Ä\n moron " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda: sorted(map(repr, t.toxicity(frame, labels).collect()))
    whole = rows()
    monkeypatch.setattr(t, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(t, "CHUNK_CHARS", 500)
    assert rows() == whole and len(whole) == len(docs)
