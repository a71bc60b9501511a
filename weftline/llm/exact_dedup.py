"""Exact deduplication by composable polynomial fingerprints, confirmed by chunkwise comparison.

1. Fingerprints. A text is normalised (each run of white space becomes one space) and read as UTF-8 bytes. Its
   fingerprint is its length and, for ``LANES`` bases, ``sum((byte + 1) * base ** place)`` modulo ``PRIME``. Chunks are
   hashed on their own and joined by length-shifted arithmetic: ``f(A + B) = f(A) + base ** len(A) * f(B)``. Texts of
   more than ``HUGE`` bytes are cut into pieces that are dealt to other tasks, hashed there, and joined the same way in
   DataFrame functions; a piece knows whether white space ends the one before it, so runs across pieces are right.
2. Comparison. Texts that share a fingerprint are compared piece by piece with the group's first row, in a join on
   (group, piece, slot): a group of many copies is spread over slots, each with its own copy of the first row's pieces,
   so no task holds a group. Rows that differ from the first row form groups anew until none is left (equal
   fingerprints of different texts; they cost rounds, never rows).

Fingerprints are written to the shared folder once. Only texts whose fingerprint is shared are read again.

Defined cases. Null text: empty. Empty texts equal each other. Leading and trailing white space counts as one space.
Null ``doc_id``: after all others, so it stays only where all ids of its group are null (``keep_id`` is null then).
Repeated rows, and rows with one id and equal texts: one of them stays. Empty table: no rows. Other columns are
ignored. Texts are never cut short. Rows of one id are told apart by a 64-bit hash of the text as it stands.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textvec
from weftline.llm.common import BROADCAST_ROWS, read, shard_count, stored

QUERY = "op12_exact_dedup"
#: Modulus of the polynomials; products of two residues fit 62 bits. Fixed bases, one a lane.
PRIME = (1 << 31) - 1
BASES = (1_103_527_591, 1_664_525_777, 69_069_133)
#: Bytes of a chunk that is hashed at a time, of a text that is hashed in one task, and of a piece of comparison.
CHUNK, HUGE, PIECE = 4096, 1 << 22, 1 << 16
#: Rows of a group that share a slot of the comparison, and slots of a group at most.
SLOT_ROWS, SLOTS = 64, 4096

_BLANK = b"\t\n\x0b\x0c\r"
_TO_SPACE = bytes.maketrans(_BLANK, b" " * len(_BLANK))
_RUN = re.compile(b"  +")
_HANDLE = ["xd_id", "xd_mark"]


def normalised(raw: bytes, after_blank: bool = False) -> bytes:
    """Runs of white space as one space; ``after_blank``: the bytes go on after white space."""
    text = raw.translate(_TO_SPACE)
    if b"  " in text:
        text = _RUN.sub(b" ", text)
    return text[1:] if after_blank and text[:1] == b" " else text


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    for k in range(1, len(out)):
        out[k] = int(out[k - 1]) * base % prime
    return out


class Polynomials:
    """Fingerprints of many texts at a time."""

    def __init__(self, bases=BASES, prime: int = PRIME, chunk: int = CHUNK):
        self.bases, self.prime, self.chunk = bases, prime, chunk
        self.places = [_powers(b, chunk, prime) for b in bases]
        self.shifts = [np.ones(1, np.uint64) for _ in bases]

    def shift(self, lane: int, length: int) -> int:
        """``base ** length``: what a following part is multiplied with."""
        return pow(self.bases[lane], length, self.prime)

    def of(self, texts: list[bytes]) -> np.ndarray:
        """One row of residues for each text."""
        out = np.zeros((len(texts), len(self.bases)), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = -(-sizes // self.chunk)  # chunks of each text
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        values = np.frombuffer(b"".join(texts), np.uint8)
        nth = textvec.ragged(np.zeros(len(full), np.int64), counts[full])  # number of each chunk in its text
        starts = np.repeat(np.cumsum(sizes)[full] - sizes[full], counts[full]) + nth * self.chunk
        lengths = np.minimum(np.repeat(sizes[full], counts[full]) - nth * self.chunk, self.chunk)
        firsts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        most, prime = int(nth.max()) + 1, np.uint64(self.prime)
        for lane, base in enumerate(self.bases):
            if len(self.shifts[lane]) < most:
                self.shifts[lane] = _powers(pow(base, self.chunk, self.prime), 2 * most, self.prime)
            hashes, at = np.empty(len(starts), np.uint64), 0
            while at < len(starts):  # some chunks at a time
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 19))))
                place = textvec.ragged(np.zeros(to - at, np.int64), lengths[at:to])
                part = self.places[lane][place] * (values[starts[at] : starts[to - 1] + lengths[to - 1]].astype(np.uint64) + np.uint64(1))
                hashes[at:to] = np.add.reduceat(part, np.concatenate(([0], np.cumsum(lengths[at:to])[:-1]))) % prime
                at = to
            out[full, lane] = (np.add.reduceat(hashes * self.shifts[lane][nth] % prime, firsts) % prime).astype(np.int64)
        return out


def _raw(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("xd_id"), F.xxhash64(text).alias("xd_mark"), text.cast("binary").alias("xd_raw"))


def _lanes(poly: Polynomials) -> list[str]:
    return [f"xd_f{k}" for k in range(len(poly.bases))]


def fingerprints(docs: DataFrame, poly: Polynomials | None = None, huge: int = HUGE) -> DataFrame:
    """xd_id, xd_mark, xd_row (unique), xd_len, one xd_f column for each base, and xd_sha: SHA-256 of the normalised text."""
    poly = poly or Polynomials()
    lanes, kind = _lanes(poly), docs.schema["doc_id"].dataType.simpleString()
    handle = f"xd_id {kind}, xd_mark long, xd_row long"
    raw = _raw(docs)

    def hashed(batches):
        for batch in batches:
            texts = [normalised(t) for t in batch.column("xd_raw").to_pylist()]
            prints = poly.of(texts)
            data = [*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()), *(pa.array(prints[:, k]) for k in range(len(lanes))), pa.array([sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, ["xd_id", "xd_mark", "xd_row", "xd_len", *lanes, "xd_sha"])

    def cut(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                text, digest, blank = batch.column("xd_raw")[j].as_buffer().to_pybytes(), sha256(), False
                for k, at in enumerate(range(0, len(text), huge)):
                    piece = text[at : at + huge]
                    digest.update(normalised(piece, blank))
                    last = at + huge >= len(text)
                    own = batch.slice(j, 1)
                    data = [*own.columns[:3], pa.array([k], pa.int32()), pa.array([blank]), pa.array([piece], pa.binary()), pa.array([digest.digest() if last else None], pa.binary())]
                    yield pa.RecordBatch.from_arrays(data, ["xd_id", "xd_mark", "xd_row", "k", "blank", "piece", "xd_sha"])
                    blank = piece[-1:] in (b" ", *(_BLANK[i : i + 1] for i in range(len(_BLANK))))

    shifts = [f"p{k}" for k in range(len(lanes))]

    def parts(batches):
        for batch in batches:
            texts = [normalised(t, b) for t, b in zip(batch.column("piece").to_pylist(), batch.column("blank").to_pylist(), strict=True)]
            prints = poly.of(texts)
            data = [*batch.columns[:4], batch.column("xd_sha"), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(prints[:, k]) for k in range(len(lanes)))]
            data += [pa.array([poly.shift(k, len(t)) for t in texts], pa.int64()) for k in range(len(lanes))]
            yield pa.RecordBatch.from_arrays(data, ["xd_id", "xd_mark", "xd_row", "k", "xd_sha", "len", *lanes, *shifts])

    row = F.monotonically_increasing_id() * 2
    longs = ", ".join(f"{c} long" for c in lanes)
    small = raw.where(F.octet_length("xd_raw") <= huge).select("xd_id", "xd_mark", row.alias("xd_row"), "xd_raw").mapInArrow(hashed, f"{handle}, xd_len long, {longs}, xd_sha binary")
    pieces = raw.where(F.octet_length("xd_raw") > huge).select("xd_id", "xd_mark", (row + 1).alias("xd_row"), "xd_raw").mapInArrow(cut, f"{handle}, k int, blank boolean, piece binary, xd_sha binary")
    dealt = pieces.repartition(shard_count(docs.sparkSession), "xd_row", "k").mapInArrow(parts, f"{handle}, k int, xd_sha binary, len long, {longs}, {', '.join(f'{c} long' for c in shifts)}")
    listed = dealt.groupBy("xd_id", "xd_mark", "xd_row").agg(F.sort_array(F.collect_list(F.struct("k", "len", *lanes, *shifts))).alias("parts"), F.max("xd_sha").alias("xd_sha"))

    def joined(lane: int):
        start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).cast("long").alias("s"))
        step = lambda done, part: F.struct(((done["h"] + done["s"] * part[lanes[lane]]) % poly.prime).alias("h"), (done["s"] * part[shifts[lane]] % poly.prime).alias("s"))
        return F.aggregate("parts", start, step)["h"].alias(lanes[lane])

    length = F.aggregate("parts", F.lit(0).cast("long"), lambda done, part: done + part["len"])
    whole = listed.select("xd_id", "xd_mark", "xd_row", length.alias("xd_len"), *map(joined, range(len(lanes))), "xd_sha")
    return small.unionByName(whole)


def _pieces(texts: DataFrame, names: list[str], size: int) -> DataFrame:
    """``texts`` with xd_raw as rows (names, k, piece): bytes of the normalised text."""
    kinds = dict(texts.dtypes)

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                text, own = normalised(batch.column("xd_raw")[j].as_buffer().to_pybytes()), batch.slice(j, 1)
                for k, at in enumerate(range(0, max(1, len(text)), size)):
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array([k], pa.int32()), pa.array([text[at : at + size]], pa.binary())], [*names, "k", "piece"])

    return texts.select(*names, "xd_raw").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", k int, piece binary")


def _differing(raw: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """xd_id, xd_mark, xd_group of members (with xd_first, their group's first row, and xd_n) whose text is another than the first row's."""
    own, asked = raw.alias("r"), members.alias("m")
    same = F.col("r.xd_id").eqNullSafe(F.col("m.xd_id")) & (F.col("r.xd_mark") == F.col("m.xd_mark"))
    asked = F.broadcast(asked) if members.count() <= BROADCAST_ROWS // 8 else asked
    slots = F.least(F.lit(SLOTS), F.ceil(F.col("xd_n") / SLOT_ROWS)).cast("int")
    slot = F.pmod(F.xxhash64("r.xd_id", "r.xd_mark", F.spark_partition_id()), slots).cast("int")
    texts = own.join(asked, same).select("r.xd_id", "r.xd_mark", "xd_raw", "xd_group", "xd_leads", slots.alias("slots"), slot.alias("slot"))
    leads = _pieces(texts.where("xd_leads"), ["xd_group", "slots"], size).dropDuplicates(["xd_group", "k"])
    leads = leads.select("xd_group", "k", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("piece").alias("lead"))
    held = _pieces(texts.where("not xd_leads"), ["xd_id", "xd_mark", "xd_group", "slot"], size)
    met = held.join(leads, ["xd_group", "k", "slot"], "left")
    return met.where(F.coalesce(F.col("piece") != F.col("lead"), F.lit(True))).select(*_HANDLE, "xd_group").distinct()


def classes(docs: DataFrame, poly: Polynomials | None = None, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text)."""
    poly = poly or Polynomials()
    key = ["xd_len", *_lanes(poly)]
    raw, rows, found = _raw(docs), stored(fingerprints(docs, poly, huge), "prints"), None
    while True:
        first = F.min(F.struct(F.col("xd_id").isNull().alias("none"), F.col("xd_id").alias("id"), F.col("xd_mark").alias("mark"), F.col("xd_row").alias("row"))).alias("first")
        groups = rows.groupBy(*key).agg(first, F.count("*").alias("xd_n"))
        shared = groups.where("xd_n > 1").withColumn("xd_group", F.col("first.row"))
        leads = F.col("xd_id").eqNullSafe(F.col("first.id")) & (F.col("xd_mark") == F.col("first.mark"))
        members = rows.join(shared, key).select(*_HANDLE, "xd_group", "xd_n", leads.alias("xd_leads")).distinct()
        other = stored(_differing(raw, stored(members, "members"), piece), "differing")
        rest = other.limit(1).count()
        alike = rows.join(groups, key)
        if rest:
            odd = other.select(F.col("xd_id").alias("o_id"), F.col("xd_mark").alias("o_mark"), F.col("xd_group").alias("o_group"))
            match = F.col("xd_id").eqNullSafe(F.col("o_id")) & (F.col("xd_mark") == F.col("o_mark")) & (F.col("first.row") == F.col("o_group"))
            alike, rows = alike.join(odd, match, "left_anti"), stored(alike.join(odd, match, "left_semi").select(*rows.columns), "prints")
            sizes = alike.groupBy(F.col("first.row").alias("lead")).agg(F.count("*").alias("size"))
            alike = alike.join(sizes, F.col("first.row") == F.col("lead")).withColumn("xd_n", F.col("size"))
        out = alike.select(F.col("xd_id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("xd_n").alias("group_size"), (F.col("xd_row") == F.col("first.row")).alias("kept"), F.lower(F.hex("xd_sha")).alias("text_sha256"))
        found = out if found is None else found.unionByName(out)
        if not rest:
            return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM plain
"""
