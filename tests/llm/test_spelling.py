"""Spelling variants against a plain count and all pairs; the affected-gram bound against all edits."""

import random
import re
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def plain_counts(rows, slip):
    sums = {}
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                sums[run] = sums.get(run, 0) + 1
    return {w: n for w, n in sums.items() if n >= 3}


def plain_variants(counts):
    letters = {c for w in counts for c in w}
    near = {w: [x for x in edits(w, letters) if x in counts] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def vocabulary(seed, letters):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(150)}
    for w in list(words)[:60]:
        words |= set(rnd.sample(sorted(x for x in edits(w, letters) if len(x) >= 5), 6))
    return {w: rnd.choice([3, 4, 6, 8, 16, 32, 70]) for w in words}


@pytest.mark.parametrize("letters, frequent", [("ab", 0), ("ab", 40), ("abcdefgh", 3), ("abcé÷ÿ", 0), ("abcdefgh", 10**6)])
def test_variants_against_all_pairs(spark, letters, frequent):
    counts = vocabulary(len(letters) + frequent % 7, letters)
    counts |= {"aaaaa": 5, "aaaaaa": 5, "aaaaaaa": 20, "a" * 300: 3, "a" * 299 + "b": 6}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    assert got(spelling.variants(df, frequent)) == plain_variants(counts)


def test_words_and_variants_of_texts(spark):
    rnd = random.Random(5)
    words = ["Straße", "strasse", "colour", "color", "COLOUR", "naïve", "naive", "weather", "whether", "a", "É", "ÉCOLE", "école", "x" * 40]
    rows = [(k if k % 9 else None, " ".join(rnd.choice(words) + rnd.choice([" ", ",", "1", "_"]) for _ in range(rnd.randint(0, 30))), "w", 1) for k in range(200)]
    rows += [(3, None, None, None), (None, None, None, None), (4, "", None, 0), rows[5], rows[5], (8, "colour " * 5000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = plain_counts(rows, 7)
    assert {r.word: r.n for r in spelling.count_words(df, slip=7).collect()} == counts
    assert got(spelling.variants(spelling.count_words(df, slip=7))) == plain_variants(counts)


def test_empty(spark):
    assert spelling.variants(spelling.count_words(spark.createDataFrame([], SCHEMA))).count() == 0


@given(st.text("abc", min_size=5, max_size=9), st.lists(st.text("abc\x01\x02\x03\x04", min_size=2, max_size=3), max_size=40))
@settings(max_examples=150, deadline=None)
def test_bound_holds_for_every_edit(word, grams):
    """A word shares at least as many grams with each word one edit away as both words' bounds say, and one at least."""
    extended = frozenset(grams)
    endings = frozenset(g[k:] for g in extended for k in range(1, len(g)))

    def profile(w):
        padded = "\x01\x02" + w + "\x03\x04"
        found = spelling.decompose(padded, extended)
        need = len(found) - spelling.touched(padded, found, endings)
        return {(padded[a:b], a) for a, b in found}, need

    own, need = profile(word)
    assert need >= 1
    for other in edits(word, "abcd"):
        if len(other) < 5:
            continue
        theirs, least = profile(other)
        short, long, shift = (own, theirs, len(other) - len(word)) if len(other) >= len(word) else (theirs, own, 1)
        met = sum((g, a) in long or (shift and (g, a + 1) in long) for g, a in short)
        assert met >= max(need, least)
