"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Sketch. Each text gives the 64-bit hashes of its distinct word shingles, a fingerprint of that set, a
   MinHash signature and its ``BANDS`` band keys. Documents with equal sets are one class.
2. Candidates. Classes that share a band key are candidates. A pair at the threshold shares none with
   probability ``(1 - 0.85 ** ROWS) ** BANDS``, about 3e-7.
3. Verification. Signatures are compared in batches of 32 values; after each, the posterior of the
   similarity (uniform prior) is asked how likely it still reaches the threshold, and the pair is dropped
   where that is under ``MISS``. Survivors are verified exactly on their full shingle sets.
4. Components. Links are joined to components by label spreading with pointer jumping.

Groups of thousands of near copies share many band keys, so pairs are not made within a key. First each
member is compared with its key's hub (the most central class of the key), and of the hubs of a class the
most similar one is verified: a number of pairs linear in the classes, which joins the core of a large group.
Then the keys that still hold two components or more are finished. Each has an anchor, the most central hub
that its members know, which nearly all keys of a large group share. Members are compared by their exact
differences from their keys' anchors, with a prefix filter on these small sets. Tokens that many members of an
anchor differ by come last in the filter's order, so what meets in it are rare edits, not the common text or
the anchor's own. A pair that meets also needs difference parities (``PARITY`` words of 64 bits) that are as near as
a link asks for. So each pair that shares a key is verified, shown to be impossible, or already in one
component, and no link between different components is lost.

Shingle sets are only made for classes that share a key, and pairs carry them only for survivors. Every
table that is used twice is written to the shared folder.

Defined cases. Null or empty text, or no words: 0 shingles, linked with nothing. Fewer words than a
shingle: the whole sequence is one shingle. Repeated rows: each is returned; they share their result. A
``doc_id`` with several texts: each text counts, under that id. Null ``doc_id``: linked like any other, never
a component's id; a component of such rows alone has a null id, and its rows are kept. Empty table: no rows. Other columns are ignored. Texts are
never cut. 64-bit hashes stand for shingles and 64-bit fingerprints for classes.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textvec
from weftline.llm.common import read, stored

QUERY = "op7_near_dedup"
#: Band keys of a signature, and signature values in each.
BANDS, ROWS = 32, 6
#: Signature values compared by Bayesian verification, in batches; chance at which a pair is let go.
VALUES, BATCH, MISS = 128, 32, 1e-6
#: Contract of the query: words of a shingle, and the least similarity in percent.
SHINGLE_WORDS, PERCENT = 3, 85
#: A token is common if one in so many of an anchor's members (in a batch) differ by it.
COMMON = 50
#: 64-bit words of parities: each bit says whether an odd number of a difference's tokens fall on it, so two
#: sets differ by at least as many tokens as their parities by bits.
PARITY = 8

_random = np.random.default_rng(20240607)
_FACTOR = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_SHIFT = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    points, starts = textvec.code_points(texts)
    upper = (points >= 65) & (points <= 90)
    points[upper] += 32
    word_starts, word_ends = textvec.words(points)
    hashes = textvec.span_hashes(points, word_starts, word_ends)
    first = np.searchsorted(word_starts, starts)
    joined = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        part = hashes[k:] if k else hashes
        joined[: len(part)] = textvec.mix(joined[: len(part)] * np.uint64(0x9FB21C651E98DF25) + part)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = textvec.mix(whole * np.uint64(0xE7037ED1A0B428DB) + hashes[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, ``BANDS * ROWS`` of 32 bits."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, (x[at : at + 1024, None] * _FACTOR + _SHIFT).min(0))
    return least


def node_of(values: np.ndarray) -> int:
    """Fingerprint of a set: the class of all documents that have it."""
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, mark, node, bands, values) of every document; null node: no shingles."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            signatures = [signature(s) if len(s) else None for s in sets]
            full = np.array([s for s in signatures if s is not None]).reshape(-1, BANDS, ROWS)
            keys = np.zeros(full.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                keys = textvec.mix(keys * np.uint64(0xA0761D6478BD642F) + full[:, :, r].astype(np.uint64))
            keys, k = keys.astype(np.int64), 0
            bands = []
            for s in signatures:
                bands.append(None if s is None else keys[k])
                k += s is not None
            values = [None if s is None else (s[:VALUES] ^ (s[:VALUES] >> 16)).astype(np.uint16).tobytes() for s in signatures]
            columns = [
                batch.column("doc_id").cast(pa.int64()), pa.array(map(len, sets), pa.int64()),
                batch.column("mark"), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "mark", "node", "bands", "values"])

    marked = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return marked.mapInArrow(run, "doc_id long, n_shingles long, mark long, node long, bands array<long>, values binary")


@cache
def least_matches(percent: int) -> tuple[int, ...]:
    """Matches needed after each batch for the posterior to reach the threshold with probability ``MISS``.

    With a uniform prior, the chance that the similarity is t or more after m matches of n is that of at
    most m successes in n + 1 trials with chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < MISS:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, matches) of the pairs (a, b, a_values, b_values) that no batch rules out."""
    needed = least_matches(percent)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, VALUES) for c in ("a_values", "b_values"))
            live, matches = np.arange(n), np.zeros(n, np.int64)
            for k, least in enumerate(needed):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[live] += (a[live, part] == b[live, part]).sum(1)
                live = live[matches[live] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(live)), batch.column("b").take(pa.array(live)), pa.array(matches[live])], ["a", "b", "matches"])

    return pairs.select("a", "b", "a_values", "b_values").mapInArrow(run, "a long, b long, matches long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets (node, items) are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_items"), batch.column("b_items"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], ["a", "b"])

    # b may be the hub of a large group: its narrow pairs are joined first, and a's join is even
    with_b = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("items").alias("b_items")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("items").alias("a_items")), "a")
    return both.select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the least node of its component.

    Each round a node takes the least label among itself and its neighbours, and then the label of its
    label; rounds grow with the logarithm of a component's width. One count per round comes to the driver.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        met = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("m_node")).agg(F.min("label").alias("m_label"))
        spread = labels.join(met, labels.node == met.m_node, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m_label", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        fresh = stored(spread.join(jump, spread.label == jump.j_node, "left").select("node", "old", F.least("label", F.coalesce("j_label", "label")).alias("label")), "labels")
        moved = fresh.where("label <> old").limit(1).count()
        labels = fresh.select("node", "label")
        if not moved:
            return labels


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, anchor, size, d, linked, tokens) of pairs (node, anchor).

    Tokens are the symmetric difference of the two sets, ``d`` their number, and ``linked`` whether the two are
    similar enough.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("x_items"), batch.column("y_items"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True)
                same = (len(x) + len(y) - len(apart)) // 2
                rows.append((len(x), len(apart), 100 * same >= percent * (len(x) + len(y) - same), apart.tobytes()))
            columns = [batch.column("node"), batch.column("anchor"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "anchor", "size", "d", "linked", "tokens"])

    with_anchor = pairs.join(sets.select(F.col("node").alias("anchor"), F.col("items").alias("y_items")), "anchor")
    both = with_anchor.join(sets.select("node", F.col("items").alias("x_items")), "node")
    return both.select("node", "anchor", "x_items", "y_items").mapInArrow(run, "node long, anchor long, size long, d long, linked boolean, tokens binary")


def common_tokens(apart: DataFrame) -> DataFrame:
    """(anchor, common): of each anchor, the tokens that at least one in ``COMMON`` of its members in a batch
    differ by, and one in ``COMMON`` of all its members (as far as batches have counted them), as packed tokens
    from the least to the most frequent.

    They only set an order, so counts of batches do. An anchor's list has at most ``COMMON`` times as many tokens
    as its members differ by in the mean, however many members it has.
    """

    def run(batches):
        for batch in batches:
            anchors = np.array(batch.column("anchor").to_pylist(), np.int64)
            found = [np.frombuffer(t.as_buffer(), np.int64) for t in batch.column("tokens")]
            for anchor in np.unique(anchors).tolist():
                own = np.flatnonzero(anchors == anchor)
                if len(own) > 1:
                    tokens, n = np.unique(np.concatenate([found[k] for k in own.tolist()]), return_counts=True)
                    keep = (n > 1) & (n * COMMON >= len(own))
                    tokens, n = tokens[keep], n[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), anchor)), pa.array(tokens), pa.array(n, pa.int64())], ["anchor", "token", "n"])

    counted = apart.select("anchor", "tokens").mapInArrow(run, "anchor long, token long, n long").groupBy("anchor", "token").agg(F.sum("n").alias("n"))
    members = apart.groupBy("anchor").agg(F.count("*").alias("members"))
    counted = counted.join(members, "anchor").where(F.col("n") * COMMON >= F.col("members"))
    ordered = F.sort_array(F.collect_list(F.struct("n", "token")))
    return counted.groupBy("anchor").agg(F.transform(ordered, lambda x: x.token).alias("common"))


def rarest_first(apart: DataFrame, percent: int) -> DataFrame:
    """``apart`` with the tokens ordered, those that are not common first, and cut to at most one more than
    the largest difference that a linked pair of this size can have: no more are in any prefix."""

    def run(batches):
        for batch in batches:
            cut, parities = [], []
            for size, tokens, common in zip(batch.column("size").to_pylist(), batch.column("tokens"), batch.column("common"), strict=True):
                tokens = np.frombuffer(tokens.as_buffer(), np.int64)
                odd = np.bincount(tokens & (64 * PARITY - 1), minlength=64 * PARITY) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                if common.is_valid:
                    # places in the common order; a token that is not in it comes before all
                    common = common.values.to_numpy()
                    order = np.argsort(common, kind="stable")
                    at = order[np.minimum(np.searchsorted(common, tokens, sorter=order), len(common) - 1)]
                    tokens = tokens[np.argsort(np.where(common[at] == tokens, at, -1), kind="stable")]
                cut.append(tokens[: (100 - percent) * size // percent + 1])
            columns = [batch.column(c) for c in ("node", "anchor", "size", "d")]
            words = [pa.array(w) for w in np.array(parities, np.int64).reshape(-1, PARITY).T]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.list_(pa.int64())), *words], ["node", "anchor", "size", "d", "tokens", *odd_words])

    odd_words = [f"odd{k}" for k in range(PARITY)]
    both = apart.join(common_tokens(apart), "anchor", "left").select("node", "anchor", "size", "d", "tokens", "common")
    return both.mapInArrow(run, "node long, anchor long, size long, d long, tokens array<long>, " + ", ".join(f"{w} long" for w in odd_words))


def _same_anchor(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes with a common anchor and different labels that can be similar enough.

    Two sets differ by ``d1 + d2`` less twice what their differences from the anchor share, so similar ones
    share at least ``alpha`` of it, and so one of the first ``d - alpha + 1`` elements of either in any common
    order. If ``d1 + d2`` alone is small enough, both are linked to the anchor and have one label.
    """
    words = [f"odd{k}" for k in range(PARITY)]
    tokens = found.select("node", "anchor", "label", "size", "d", *words, F.posexplode("tokens").alias("pos", "token"))
    right = tokens.select(*[F.col(c).alias(f"r_{c}") for c in tokens.columns])
    together = F.col("d") + F.col("r_d")
    apart = F.expr(f"({100 - percent} * (size + r_size)) div {100 + percent}")
    alpha = F.ceil((together - apart) / 2)
    met = (tokens.anchor == right.r_anchor) & (tokens.token == right.r_token) & (tokens.node < right.r_node) & (tokens.label != right.r_label)
    met = met & (together > apart) & (F.col("pos") <= F.col("d") - alpha) & (F.col("r_pos") <= F.col("r_d") - alpha)
    met = met & (sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"r_{w}"))) for w in words) <= apart)
    return tokens.join(right, met).select(F.col("node").alias("a"), F.col("r_node").alias("b")).distinct()


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, mark (hash of the text), node, label (least node of the component; of unlinked nodes their
    own), n_shingles, component_id and kept of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(sketch(rows, size), "sketches")
    # rows of a class have one signature; the row of least id (null: last) and mark stands for it
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("m")
    classes = sketches.where("node is not null").groupBy("node").agg(least, F.first("bands").alias("bands"), F.first("values").alias("values"))
    classes = stored(classes.select("node", F.col("m.doc_id").alias("rep"), F.col("m.mark").alias("mark"), "bands", "values"), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stored(keyed.join(shared, "key"), "band-members")  # (key, node, n)
    # the hub of a key is its most central class: the one whose keys hold most members
    central = stored(crowded.groupBy("node").agg(F.sum("n").alias("weight")), "band-nodes")
    weighed = crowded.join(central, "node").select("key", "node", "weight")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("h"))
    members = stored(crowded.select("key", "node").join(hubs, "key").select("key", "node", F.col("h.node").alias("hub"), F.col("h.weight").alias("weight")), "hub-members")
    signatures = stored(classes.join(central, "node").select("node", "rep", "mark", "values"), "signatures")
    marked = rows.withColumn("t_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = marked.join(signatures.select(F.col("node").alias("want"), "rep", "mark"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t_mark") == F.col("mark")))
    sets = stored(_sets(texts, size).dropDuplicates(["node"]), "shingle-sets")

    def with_values(pairs: DataFrame) -> DataFrame:
        for side in "ba":
            pairs = pairs.join(signatures.select(F.col("node").alias(side), F.col("values").alias(f"{side}_values")), side)
        return pairs

    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    best = plausible(with_values(stars), percent).groupBy("a").agg(F.max(F.struct("matches", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = stored(verified(best, sets, percent), "hub-links")
    labels = components(links)

    placed = members.join(labels, "node", "left").select("key", "node", "hub", "weight", F.coalesce("label", "node").alias("label"))
    in_key = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    parted = in_key.groupBy("key").agg(F.count("*").alias("labels")).where("labels > 1").select("key")
    open_ = stored(placed.join(parted, "key"), "open-keys")
    # a key's anchor: the most central hub of all keys that its members are in
    first = open_.groupBy("node").agg(F.max(F.struct("weight", "hub")).alias("anchor"))
    of_key = open_.select("key", "node").join(first, "node").groupBy("key").agg(F.max("anchor").alias("anchor"))
    anchors = stored(open_.select("key", "node", "label").join(of_key, "key").select("node", "label", F.col("anchor.hub").alias("anchor")).distinct(), "anchors")
    apart = stored(differences(anchors.where("node <> anchor").select("node", "anchor"), sets, percent), "differences")
    ordered = rarest_first(apart, percent)
    rest = stored(_same_anchor(ordered.join(anchors, ["node", "anchor"]), percent), "near-pairs")
    more = verified(plausible(with_values(rest), percent), sets, percent).unionByName(apart.where("linked").select(F.col("node").alias("a"), F.col("anchor").alias("b")))
    more = stored(more, "more-links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    named = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = named.join(ids, "label").select("node", "label", "component_id")
    out = sketches.select("doc_id", "mark", "n_shingles", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "mark", "node", "label", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, columns: list[str], size: int = 5, percent: int = 80) -> DataFrame:
    """``columns`` of one document of each component: the one of least id (null: last), then least hash of
    its text; of its repeated rows one.

    Several texts under one id are documents of their own. Rows without words stay, once for each id and text.
    """
    found = _grouped(docs, size, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("m")
    linked = found.where("node is not null").groupBy("label").agg(least).select(F.col("m.doc_id").alias("k_id"), F.col("m.mark").alias("k_mark"))
    wordless = found.where("node is null").select(F.col("doc_id").alias("k_id"), F.col("mark").alias("k_mark"))
    chosen = stored(linked.unionByName(wordless).groupBy("k_id", "k_mark").agg(F.count("*").alias("n")), "kept-ids")
    rows = docs.select(*columns).withColumn("k_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(chosen, rows.doc_id.cast("long").eqNullSafe(chosen.k_id) & (rows.k_text == chosen.k_mark), "left_semi")
    repeated = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "k_text"])
    return kept.select(*columns)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, items) of the wanted classes; ``texts`` has want and text. Another text of the id is left out."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            found = [(w, s.tobytes()) for w, s in zip(batch.column("want").to_pylist(), sets, strict=True) if len(s) and node_of(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "items"])

    return texts.select("want", "text").mapInArrow(run, "node long, items binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), SHINGLE_WORDS, PERCENT)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d
), items AS (SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS same FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT p, q FROM pairs JOIN sets a ON a.doc_id = p JOIN sets b ON b.doc_id = q WHERE 100 * same >= 85 * (len(a.s) + len(b.s) - same)
), edges AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.q FROM reach r JOIN edges e ON r.b = e.p
), least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ids ON a = doc_id
"""
