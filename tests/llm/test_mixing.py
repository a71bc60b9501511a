"""Hierarchical budgets against plain recursion and SQL."""

from hashlib import md5

import pytest

from tests.llm.oracle import rows_of_frame, rows_of_sql
from weftline.llm import mixing

SF = "/root/testdata/sf0.001"


def share(budget, children):
    """children: {key: (cap, weight)} -> {key: given}, by filling up one full child after another."""
    given, left, open_ = {}, budget, dict(children)
    while True:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * total <= left * w]
        if not full:
            break
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        given[k] = open_.pop(k)[0]
        left -= given[k]
        if not open_:
            return given
    total = sum(w for _, w in open_.values())
    low = {k: left * w // total for k, (_, w) in open_.items()}
    for k in sorted(open_, key=lambda k: (-(left * open_[k][1] % total), k))[: left - sum(low.values())]:
        low[k] += 1
    return given | low


def brute(rows, weights, fraction, epochs, seed):
    docs = [(i, s, la, so, len((t or "").split())) for i, t, la, so in rows for s in ["d" + str(int(so[3:]) % 4) if so else "other"]]
    docs = [(i, (d, la or "", so or ""), n) for i, d, la, so, n in docs if n]
    tokens = {}
    for _, leaf, n in docs:
        tokens[leaf] = tokens.get(leaf, 0) + n

    def cap(prefix):
        return epochs * sum(n for leaf, n in tokens.items() if leaf[: len(prefix)] == prefix)

    budgets, budget = {}, int(sum(tokens.values()) * fraction)
    nodes = {(): min(budget, cap(()))}
    for depth, level in enumerate(("domain", "lang", "source")):
        for prefix, b in [x for x in nodes.items() if len(x[0]) == depth]:
            keys = {leaf[: depth + 1] for leaf in tokens if leaf[:depth] == prefix}
            nodes |= share(b, {k: (cap(k), weights[level].get(k[-1], 1)) for k in keys})
    out = []
    for leaf, t in tokens.items():
        full, rest = divmod(nodes[leaf], t)
        own = sorted((md5(f"{seed}:{full}:{'null' if i is None else i}".encode()).hexdigest(), str(i), n, i) for i, x, n in docs if x == leaf)
        for _, _, n, i in own:
            part = max(0, min(n, rest))
            rest -= part
            if full or part:
                out.append((str(i), *leaf, n, full, part))
    return sorted(out)


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.7, 1.4, 5.0])
def test_against_recursion(spark, fraction):
    rows = [(k, "w " * (k * 7 % 23), ["en", "de", None][k % 3 if k % 5 else 0], f"src{k % 6 if k % 4 else 0}" if k % 17 else None) for k in range(200)] + [(None, "a b c", "en", "src1"), (3, "x y", "en", "src3"), (3, "x y", "en", "src3"), (9, None, "en", "src1")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, mx int")
    got = mixing.mix(docs, ["doc_id"], fraction=fraction).collect()
    assert sorted((str(r.doc_id), r.mx_domain, r.mx_lang, r.mx_source, r.mx_tokens, r.mx_epochs, r.mx_part) for r in got) == brute(rows, mixing.WEIGHTS, fraction, mixing.MAX_EPOCHS, mixing.SEED)


def test_ties_are_settled_by_text(spark):
    """Rows without id, or with one id, and equal lengths: the same texts are taken however rows are dealt out."""
    rows = [(None if k % 2 else 4, f"t{k} a b c", "en", "src1") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = [sorted((r.text, r.mx_epochs, r.mx_part) for r in mixing.mix(d, ["text"], fraction=0.4).collect()) for d in (docs, docs.repartition(7), docs.orderBy("text").coalesce(1))]
    assert taken[0] == taken[1] == taken[2]


def test_budgets_of_few_leaves_need_no_shuffle(spark, monkeypatch):
    """The tree over few leaves is one plan without a shuffle; with more leaves than the bound the same is taken."""
    rows = [(k, "w " * (k * 5 % 17), ["en", "de", "fr"][k % 3], f"src{k % 7}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plans, write = {}, mixing.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(mixing, "stored", noted)
    few = sorted(map(repr, mixing.mix(docs, ["doc_id"]).collect()))
    assert "Window" in plans["mixing-plan"] and "Exchange hashpartitioning" not in plans["mixing-plan"] and "Exchange SinglePartition" not in plans["mixing-plan"]
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixing.mix(docs, ["doc_id"]).collect())) == few and few
    assert "Exchange hashpartitioning" in plans["mixing-plan"]


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), ["doc_id"]).count() == 0


def test_oracle(spark):
    assert rows_of_frame(mixing.query(spark, SF)) == rows_of_sql(mixing.ORACLE_SQL, SF)
