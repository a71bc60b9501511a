"""BPE against the tokenizers library."""

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.oracle import thue_morse
from weftline.llm import bpe, textvec

PATH = public_tokenizers.path(bpe.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "", " ", "a", "Hello   World\n\tagain", "don't we'll they've I'm he'd it's 'tis 'S !'s", "aaaaaaaaaaaaaaaaaaaaaaaa", "abababababab",
    "Éçmentelle les übergrößenträger ñandú", "x" * 5000, "12 345 ٣٤ ½", "🙂🙃 日本語テキスト", "ΟΔΟΣ Σ İstanbul ẞ ſtraße", "a<|endoftext|>b <|startoftext|>",
    "é café", "  wide　space\x85next\x1cfs", "mail@example.com,,, --- ***!!! ###", "\x00\x01control", ":\U00013460 \u0558a",
]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH, textvec.kind_runs())


def same(enc, text):
    ids, decoded = enc.encode([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, text
    assert decoded.decode() == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_texts(enc, text):
    same(enc, text)


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_that_polynomials_confuse(enc, n):
    for text in thue_morse(n):
        same(enc, text)
    both = " ".join(thue_morse(n))
    same(enc, both)


def test_characters_that_python_lacks(enc):
    """Capitals that the library lower-cases, and all other characters without a category in Python."""
    lacking = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    near = [c for c in lacking if ord(c) < 0x20000]
    for at in range(0, len(near), 2000):
        same(enc, " ".join(near[at : at + 2000]))
    for c in "\ua7ce\ua7d2\ua7d4\U00016ea0\U00016eb8":
        same(enc, f"a{c}b {c}")


def test_long_and_many_words(enc):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghij"))
    same(enc, " ".join("".join(rng.choice(letters, int(k))) for k in rng.integers(1, 200, 400)))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(enc, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    same(enc, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrstth", max_size=40))
def test_merging_words(enc, text):
    same(enc, text)


def test_batch_and_query(spark, enc):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*TEXTS, None])] + [(None, "the", "y"), (0, "", "z")], "doc_id long, text string, ids string")
    rows = bpe.digests(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = "the" if r.doc_id is None else (TEXTS[r.doc_id] if r.doc_id < len(TEXTS) else "")
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0
