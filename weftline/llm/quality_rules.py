"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every word and every pair of neighbouring words of a text is hashed to one of ``BUCKETS`` buckets. Two
multinomials over the buckets are counted over all documents: the raw corpus, and the trusted target
(documents labelled ``quality`` 1). A document's score is the mean over its n-grams of
``log(target / raw)``; it is kept if that reaches a fixed threshold and no base rule failed.

Counting and scoring are narrow passes over the text; only ``BUCKETS`` sums per task are shuffled, and
the summed table (``BUCKETS`` rows, a fixed bound) comes to the driver.

Defined cases. Null or empty text: no words, all counts 0, ``base_failed`` true, score 0. Null
``doc_id``: scored, never trusted. Repeated rows: counted and returned each. Repeated labels: trusted if
any row says 1. No label or no trusted document: both multinomials are smoothed alike and the target is
flat. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textvec
from weftline.llm.common import join_bounded, read

QUERY = "op10_quality_rules"
#: n-grams are hashed to so many buckets.
BUCKETS = 1 << 14
#: Documents with a lower mean log-likelihood ratio go.
THRESHOLD = -0.1
#: Pseudo-counts: of the raw multinomial (one a bucket), and of the target, dealt out as the raw corpus is,
#: so a bucket that the target can't be expected to hold yet says little.
RAW_SMOOTHING, TARGET_SMOOTHING = 1.0, 8 * BUCKETS
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(textvec.SEPARATOR + 1, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class _Batch:
    """Words of a batch of texts, with each text's first word."""

    def __init__(self, texts):
        self.points, self.starts = textvec.code_points(texts)
        self.word_starts, self.word_ends = textvec.words(self.points)
        self.hashes = textvec.span_hashes(self.points, self.word_starts, self.word_ends)
        self.first = np.searchsorted(self.word_starts, self.starts)
        self.n_words = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(texts)), self.n_words)

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of every word and word pair."""
        same = self.text_of[1:] == self.text_of[:-1]
        pairs = textvec.mix(self.hashes[:-1] * np.uint64(3) + self.hashes[1:])[same]
        found = np.concatenate((self.hashes, pairs)) % np.uint64(buckets)
        return found.astype(np.int64), np.concatenate((self.text_of, self.text_of[1:][same]))

    def per_text(self, flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def rules(self) -> dict[str, np.ndarray]:
        chars = np.bincount(self.text_of, self.word_ends - self.word_starts, len(self.n_words)).astype(np.int64)
        return {
            "n_words": self.n_words,
            "word_chars": chars,
            "n_symbols": self.per_text(_SYMBOL[self.points], self.starts),
            "n_dup_lines": self._dup_lines(),
            "n_repeat_words": self._repeat_words(),
        }

    def _dup_lines(self) -> np.ndarray:
        """Lines holding a word that equal an earlier line of the text."""
        ends = np.flatnonzero((self.points == 10) | (self.points == textvec.SEPARATOR))
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        full = np.searchsorted(self.word_starts, ends) > np.searchsorted(self.word_starts, starts)
        starts, ends = starts[full], ends[full]
        text = np.searchsorted(self.starts, starts, "right") - 1
        keys = textvec.mix(textvec.span_hashes(self.points, starts, ends) + text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        _, firsts = np.unique(keys, return_index=True)
        n = len(self.n_words)
        return np.bincount(text, minlength=n) - np.bincount(text[firsts], minlength=n)

    def _repeat_words(self) -> np.ndarray:
        """Words inside 3-word windows that the text holds twice or more."""
        h, marked = self.hashes, np.zeros(len(self.hashes), bool)
        if len(h) > 2:
            whole = self.text_of[2:] == self.text_of[:-2]
            mixed = textvec.mix(h[:-2] * np.uint64(5) + h[1:-1] * np.uint64(3) + h[2:])
            keys = textvec.mix(mixed + self.text_of[2:].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            at = np.flatnonzero(whole)
            ordered = np.sort(keys[at])
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(twice):
                near = np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)
                at = at[twice[near] == keys[at]]
                for k in range(3):
                    marked[at + k] = True
        return self.per_text(marked, self.first)


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents, and of those with ``trusted`` 1.

    ``docs`` has text and trusted. Each task sums its own documents before anything is shuffled.
    """

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            found, text = _Batch(batch.column("text").to_pylist()).grams(buckets)
            trusted = np.array([x == 1 for x in batch.column("trusted").to_pylist()], bool)
            raw += np.bincount(found, minlength=buckets)
            target += np.bincount(found[trusted[text]] if len(text) else found, minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    parts = docs.select("text", "trusted").mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket log(target share / raw share); at most ``buckets`` rows come to the driver."""
    raw, target = np.full(buckets, RAW_SMOOTHING), np.zeros(buckets)
    for r in counts.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    raw /= raw.sum()
    return np.log((target + TARGET_SMOOTHING * raw) / (target.sum() + TARGET_SMOOTHING)) - np.log(raw)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the rule counts, score, base_failed and kept of every document."""
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("trusted"))
    table = log_ratios(ngram_counts(join_bounded(docs.select("doc_id", "text"), trusted, "doc_id"), buckets), buckets)

    def score(batches):
        for batch in batches:
            texts = _Batch(batch.column("text").to_pylist())
            found, text = texts.grams(buckets)
            n = np.bincount(text, minlength=batch.num_rows)
            mean = np.bincount(text, table[found], batch.num_rows) / np.maximum(n, 1)
            rules = texts.rules()
            failed = (rules["n_words"] < MIN_WORDS) | (100 * rules["n_repeat_words"] > MAX_REPEAT_PERCENT * rules["n_words"])
            out = rules | {"score": mean, "base_failed": failed, "kept": ~failed & (mean >= threshold)}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, out.values())], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
