"""Near duplicates against all pairs, and the SQL oracle."""

import random

import numpy as np

from tests.llm.oracle import rows_of_frame, rows_of_sql, thue_morse
from weftline.llm import near_dedup as n


def labels(rows, size, percent):
    """The component of each row as a number; rows without words have their own, once for each id and text."""
    sets, root = linked(rows, size, percent)
    return [root(k) if sets[k] else repr(rows[k]) for k in range(len(rows))]


def linked(rows, size, percent):
    def shingles(text):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                parent[root(a)] = root(b)
    return sets, root


def brute(rows, size, percent):
    sets, root = linked(rows, size, percent)
    groups = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[root(k)] = min(i, groups.get(root(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = groups.get(root(k)) if sets[k] else i
        out.append((str(i), len(sets[k]), c, i == c if i is not None else c is None))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 160))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k, words in enumerate(base):
        for _ in range(14 if k == 0 else 5):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
        texts.append(" ".join(passage + words[:30]))
        texts.append(" ".join(words).upper())
    rows = [(k + 3 if k % 6 else None, t) for k, t in enumerate(texts)]  # null ids among near and exact copies
    rng.shuffle(rows)
    return [*rows, (900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one\ttwo"), (907, "a b c"), (None, "one two"), (None, "only here words"), (907, "a b c"), (908, "é ü x y z"), (909, "É ü x y z")]


def test_against_all_pairs(spark):
    for seed, size, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
        got = [(str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in n.near_duplicates(docs, size, percent).collect()]
        assert sorted(got, key=str) == brute(rows, size, percent)


def test_family_of_edited_copies(spark):
    """Copies with up to ten edits of one base: similar near the base, less so to each other."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(220):
        own = list(base)
        for _ in range(k % 11):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [], [own[at], f"y{rng.randrange(40)}"]])
        rows.append((k * 7 % 223, " ".join(own)))
        if k % 9 == 0:  # a near copy of a far member
            rows.append((1000 + k, " ".join(own[:-1] + ["tail"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, percent in ((3, 85), (5, 80)):
        got = [(str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in n.near_duplicates(docs, size, percent).collect()]
        assert sorted(got, key=str) == brute(rows, size, percent)


def test_deduplicated(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other", "z"), (3, "other", "z"), (3, "second text", "z"), (None, "no id", "q"), (None, "no id", "q"), (None, "other", "q"), (5, None, "e"), (6, "", "e")]
    out = n.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "text", "lang"]).collect()
    # unrelated texts under one id are documents of their own, and clean ones stay
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", rows[0][1]), ("3", "other"), ("3", "second text"), ("5", None), ("6", ""), ("None", "no id")], key=str)


def test_deduplicated_against_all_pairs(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text) for r in n.deduplicated(docs, ["doc_id", "text"]).collect()]
    parts = {}
    for (i, t), c in zip(rows, labels(rows, 5, 80), strict=True):
        parts.setdefault(c, []).append((i is None, i or 0, i, t))
    least = [min(p, key=lambda x: x[:2]) for p in parts.values()]
    assert sorted(map(str, (i for i, _ in out))) == sorted(str(x[2]) for x in least)
    of = {(i, t): c for (i, t), c in zip(rows, labels(rows, 5, 80), strict=True)}
    assert len({of[r] for r in out}) == len(out) == len(parts)


def test_words_that_polynomials_confuse(spark):
    rows = [(k, " ".join([w] * 2 + ["a", "b"])) for n_ in (1024, 4096) for k, w in enumerate(thue_morse(n_), n_)]
    out = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(i, i) for i, _ in rows]


def test_empty(spark):
    assert n.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of_frame(n.query(spark, sf)) == rows_of_sql(n.ORACLE_SQL, sf)


def test_bayes_keeps_similar_and_drops_others():
    rng = np.random.default_rng(3)
    needed = n.least_matches(85)
    assert all(a < b for a, b in zip(needed, needed[1:], strict=False)) and needed[-1] < 0.85 * n.VALUES
    for similar, bound in ((0.85, 0), (0.3, 5)):
        hits = (rng.random((20000, n.VALUES)) < similar).reshape(20000, -1, n.BATCH).sum(2).cumsum(1)
        kept = (hits >= np.array(needed)).all(1).sum()
        assert kept >= 19999 if similar > 0.8 else kept <= bound


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = n.signature(x[:2000]), n.signature(x[1000:])
    assert abs((a == b).mean() - 1 / 3) < 0.12
