"""Quality rules against a plain reading of the contract, and the method against dictionaries."""

import math
import random
import re
from collections import Counter

import pytest

from tests.llm.oracle import thue_morse
from weftline.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def texts():
    rng = random.Random(1)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "日本", "#x", "a|b", "<p>", "🙂"]
    made = [rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    return [*made, "", None, " \n\t", "one", "same line\nsame line\n \n \nsame line", "a b c " * 40, "x " * 20000, "a\xa0b c\x1cd", "\n".join(thue_morse(8192)), " b c ".join(thue_morse(1024)) + " b c"]


def test_rules_against_plain_reading(spark):
    rows = [(k, t, "c") for k, t in enumerate(texts())] + [(None, "a b", "c"), (0, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = q.quality(docs, labels).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute(t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= q.THRESHOLD)


def test_method_against_dictionaries(spark):
    """Without collisions the score is the mean of log ratios of smoothed multinomials."""
    good, bad = "the river ran past the old mill " * 3, "zz qq zz ## qq zz vv "
    rows = [(k, good + f"day {k % 7}") for k in range(40)] + [(100 + k, bad * 3 + f"n{k % 5}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(10)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in q.quality(docs, labels).collect()}

    def grams(text):
        w = text.split()
        return [(x,) for x in w] + list(zip(w, w[1:], strict=False))

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i < 30:
            target.update(grams(t))
    total_raw, total = sum(raw.values()) + q.RAW_SMOOTHING * q.BUCKETS, sum(target.values())
    share = {g: (n + q.RAW_SMOOTHING) / total_raw for g, n in raw.items()}
    ratio = {g: math.log((target[g] + q.TARGET_SMOOTHING * p) / (total + q.TARGET_SMOOTHING)) - math.log(p) for g, p in share.items()}
    for i, t in rows:
        assert got[i] == pytest.approx(sum(ratio[g] for g in grams(t)) / len(grams(t)), abs=1e-9)


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) == len(good) and sum(junk) <= 0.2 * len(junk)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
