"""Collocations against plain counting, with crowded filter tables and different numbers of shards, and against SQL."""

import random
import re

import pytest

from tests.llm.oracle import rows_of_frame, rows_of_sql
from weftline.llm import collocations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, h long, phrase string"


def brute(rows, least, longest=4, inside=80, top=2000):
    f, totals = {}, {}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    out, dropped = {}, set()
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1:
            for m in range(2, len(p)):
                dropped |= {(lang, p[i : i + m]) for i in range(len(p) - m + 1) if 100 * a >= inside * f[lang, p[i : i + m]]}
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1 and (lang, p) not in dropped:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def sample(seed):
    rnd = random.Random(seed)
    words = ["der", "Rote", "hund", "ist", "é", "x" * 50, "a", "b"]
    rows = [(k, " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "\n"]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None, ""]), 1, "p") for k in range(60)]
    rows += [(None, "new york city is. New York city was", "en", None, None)] * 6 + [(7, "new york city is", "de", 0, "")] * 4
    return rows + [(None, None, None, None, None), (8, "", "en", 0, ""), (9, " ,.;\t", "fr", 0, ""), (10, "a b " * 3000, "en", 0, "")]


@pytest.mark.parametrize("seed, shards, bits, top", [(1, 3, 23, 2000), (2, 2, 5, 2000), (3, 1, 12, 7)])
def test_against_brute_force(spark, monkeypatch, seed, shards, bits, top):
    """With few bits many phrases share a slot; with small blocks phrases lie across blocks."""
    monkeypatch.setattr(collocations, "BLOCK", 50 if seed < 3 else 1 << 19)
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(collocations.collocations(df, least=5, shards=shards, bits=bits, top=top)) == brute(rows, 5, top=top)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    assert rows_of_frame(collocations.query(spark, SF)) == rows_of_sql(collocations.ORACLE_SQL, SF)
