"""Exact copies against grouping of whole texts, also with fingerprints that collide and texts cut into many pieces."""

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.oracle import rows_of_frame, rows_of_sql
from weftline.llm import exact_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept int, xd_row string"


def brute(rows):
    groups, out = {}, []
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, digest = min(known) if known else None, sha256(t.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), first, digest))
            first = False
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def sample():
    rows = [(k, f"text  {k % 7}\t\n{'é' * (k % 5)} end" + " " * (k % 3), k, "x") for k in range(120)]
    rows += [(None, "text 1 end", 0, None), (None, None, None, None), (None, "", 1, "y"), (500, None, 1, "z"), (3, "same", 1, ""), (3, "same", 1, ""), (3, "other", 1, ""), (7, "a b", 1, ""), (7, "a\x0bb", 1, "")]
    rows += [(900 + k, "word " * 5000 + str(k % 2), k, "") for k in range(6)] + [(950, " \n" * 4000 + "x", 0, ""), (951, " x", 0, ""), (952, "x  y", 0, ""), (953, "x y", 0, "")]
    return rows


@pytest.mark.parametrize("bases, prime, huge, piece", [(exact_dedup.BASES, exact_dedup.PRIME, exact_dedup.HUGE, exact_dedup.PIECE), (exact_dedup.BASES, exact_dedup.PRIME, 37, 11), ((3,), 5, 64, 50)])
def test_against_brute_force(spark, bases, prime, huge, piece):
    """With the last parameters nearly all texts of one length collide, so classes come from comparison alone."""
    rows = sample()
    poly = exact_dedup.Polynomials(bases, prime, 16)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(exact_dedup.classes(df, poly, huge, piece)) == brute(rows)


def test_empty(spark):
    assert exact_dedup.classes(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.lists(st.binary(max_size=60), max_size=8), st.integers(1, 17))
@settings(max_examples=60, deadline=None)
def test_polynomials_compose(texts, chunk):
    poly = exact_dedup.Polynomials(chunk=chunk)
    plain = np.array([[sum((c + 1) * pow(b, i, poly.prime) for i, c in enumerate(t)) % poly.prime for b in poly.bases] for t in texts], np.int64).reshape(len(texts), len(poly.bases))
    assert (poly.of(texts) == plain).all()
    joined, length = [0] * len(poly.bases), 0
    for t, own in zip(texts, plain.tolist(), strict=True):
        joined = [(h + poly.shift(k, length) * own[k]) % poly.prime for k, h in enumerate(joined)]
        length += len(t)
    assert poly.of([b"".join(texts)])[0].tolist() == joined


@given(st.text("a \t\n\x0b", max_size=40), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_pieces_normalise_like_the_whole(text, size):
    raw, out, blank = text.encode(), b"", False
    for at in range(0, len(raw), size):
        piece = raw[at : at + size]
        out += exact_dedup.normalised(piece, blank)
        blank = piece[-1:].isspace()
    assert out == re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()


def test_oracle(spark):
    assert rows_of_frame(exact_dedup.query(spark, SF)) == rows_of_sql(exact_dedup.ORACLE_SQL, SF)
