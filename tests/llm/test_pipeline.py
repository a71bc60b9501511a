"""The pipeline's stages on a small corpus, each against what its own input calls for."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_dedup import brute
from tests.llm.test_secret_scan import base, redacted, weak_fast
from weftline.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in p.STAGES:
        after = stage(spark, docs, SF)
        out.append((docs, [r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], after.columns))
        docs = spark.createDataFrame(after.collect(), after.schema)
    return out


def test_columns(stages):
    assert all(s[3] == p.COLUMNS for s in stages[:-1])
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "secret_scan", "mixing", "bpe"]


def test_toxic_documents_go_and_others_are_unchanged(spark, stages):
    _, before, after, _ = stages[0]
    kept = {r["doc_id"]: r for r in after}
    assert all(kept[r["doc_id"]] == r for r in before if r["doc_id"] in kept)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(kept) >= 0.85 * len(before) and len(toxic & set(kept)) <= 0.4 * len(toxic)


def test_one_of_each_group_stays(stages):
    _, before, after, _ = stages[1]
    want = sorted(int(i) for i, _, _, keep in brute([(r["doc_id"], r["text"]) for r in before], 5, 80) if keep)
    assert sorted(r["doc_id"] for r in after) == want


def test_secrets_are_replaced(stages):
    _, before, after, _ = stages[2]
    want = sorted((r["doc_id"], redacted(t, (found := base(t)) + weak_fast(t, found))) for r in before for t in [r["text"] or ""])
    assert sorted((r["doc_id"], r["text"] or "") for r in after) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)


def test_mixing_delivers_the_budgets(stages):
    """Whole uses, and of the last use as many words as the budget asks for."""
    _, before, after, _ = stages[3]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before]
    want = []
    for i, _, _, _, n, full, part in mixed(rows, mixing.WEIGHTS, mixing.FRACTION, mixing.MAX_EPOCHS, mixing.SEED):
        want += [(i, n)] * full + ([(i, part)] if part else [])
    assert sorted((str(r["doc_id"]), len((r["text"] or "").split())) for r in after) == sorted(want)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)


def test_tokens(stages):
    _, before, after, _ = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    want = []
    for r in before:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in after) == sorted(want)


def test_cases_of_every_stage(spark):
    """Nulls, empty and repeated rows, and extra columns with names that stages use."""
    text = "the cat sat on the mat with token=abcdefgh12 " * 3
    rows = [(1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (2, None, None, None, None), (None, "no id here at all", "en", None, 3), (3, "", "de", "src0", 0)]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, mx_part int, node int")
    for name, stage in p.STAGES:
        after = stage(spark, docs, SF)
        got = after.collect()
        if name == "bpe":
            assert len(got) == len(rows)
        else:
            assert after.columns == p.COLUMNS
            assert {r.doc_id for r in got} <= {1, 2, 3, None} and any(r.doc_id == 1 for r in got)
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "None"]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
