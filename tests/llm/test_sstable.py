"""Sorted-string tables: ids as the library gives them, round trips, lookups."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.oracle import thue_morse
from weftline.llm import sstable, textvec
from weftline.llm.common import range_cuts, shared_dir

PATH = public_tokenizers.path(sstable.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "  ", "a  b   c\n\nd \n e", "don't 'tis !'s we'll 's", "tail  ", "\n", "Éç 12 34.5  --- x", "a<|endoftext|>b", "日本 語　x  \t y", "a b  c", "x" * 3000, None]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids(text):
    assert sstable.encoder(PATH, textvec.kind_runs()).encode([text])[0].tolist() == want(text)


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_that_polynomials_confuse(n):
    enc = sstable.encoder(PATH, textvec.kind_runs())
    for text in (*thue_morse(n), " ".join(thue_morse(n))):
        assert enc.encode([text])[0].tolist() == want(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" \n\t.'aé1 ", max_size=30)), max_size=4))
def test_any_ids(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert [x.tolist() for x in sstable.encoder(PATH, textvec.kind_runs()).encode(texts)] == [want(t) for t in texts]


def test_table_lookup_and_order():
    out = io.BytesIO()
    w = sstable.Writer(out, block_bytes=200)
    ids = [None, *sorted({(k * 7919) % 5000 - 900 for k in range(400)})]
    for i in ids:
        w.add(sstable.key_bytes(i), f"v{i}".encode(), 1)
    w.finish()
    t = sstable.Table(out.getvalue())
    assert [sstable.key_id(k) for k, _ in t] == ids
    assert len(t.blocks) > 5
    assert all(t.get(sstable.key_bytes(i)) == f"v{i}".encode() for i in ids)
    assert all(t.get(sstable.key_bytes(i)) is None for i in range(10_000, 10_300))


@pytest.mark.parametrize("n", [0, 1, 60])
def test_query_against_brute_force(spark, n):
    rows = [(k * 3 - 20, TEXTS[k % len(TEXTS)] if k % 7 else f"long {k} " * 999, "z") for k in range(n)]
    rows += [(None, "null id", "z"), (1, "repeated", "z"), (1, "repeated", "z")] if n > 1 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    folder = shared_dir(spark, "test")
    manifest = sstable.write(docs.repartition(3), PATH, folder)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_back(spark, folder, manifest).collect()), key=lambda r: r[0])
    pack = zstandard.ZstdCompressor(level=1)
    entries = [(i is not None, i or 0, sstable.pack_ids(ids, pack), i, ids) for i, text, _ in rows for ids in [np.array([*want(text), 0], "<u4")]]
    start, expect = 0, []
    for *_, i, ids in sorted(entries, key=lambda e: e[:3]):
        expect.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expect
    if n > 1:
        found = {r.doc_id: r.ids for r in sstable.lookup(spark, folder, manifest, [-20, 4, 999]).collect()}
        assert set(found) == {-20, 4} and found[4] == [*want(TEXTS[8]), 0]


def test_cuts_depend_on_rows_only(spark):
    rows = [(k if k < 500 else 10**15 + k, 10) for k in range(1000)]
    a = range_cuts(spark.createDataFrame(rows, "k long, w long").repartition(2), "k", "w", 8)
    b = range_cuts(spark.createDataFrame(rows[::-1], "k long, w long").repartition(7), "k", "w", 8)
    assert a == b and 6 <= len(a) <= 12
    sizes = np.bincount([sstable.shard_of(a, k) for k, _ in rows])
    assert sizes.max() <= 2 * 1000 / 8
