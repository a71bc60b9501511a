"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are turned into integers ``floor(scale * x)`` and packed, inside the partitions they lie in, into
blocks of at most ``BLOCK_ROWS`` candidates: one posting list (rows, weights) for each dimension. Queries
are packed the same way into sparse blocks. Each block of queries meets each block of candidates once, in a grid
of groups: a block of candidates goes to one column of the grid, a block of queries to one row, and they meet where
these cross. Queries are fewer, so there are more columns than rows. Where two blocks meet, each term of the query rows scatters its weighted postings into dense score arrays; then partition
selection picks each query's best of the block, and these few are merged.

No candidate row is shuffled on its own, a hot vector is just a row, and blocks bound a task's memory. The
work is queries times candidates, as the exact search needs.

Defined cases. Vectors that are null, or hold a null, NaN or infinite component, take no part; nor do null
ids. Empty vectors score 0. Vectors of different lengths: missing components are 0. A query row's own
candidates are all rows with its id. Repeated query rows with the same vector are asked once, and different
vectors with one id each have a list (a 128-bit hash of the vector tells them apart); each repeated candidate row
counts. Scores are exact: 64-bit sums wrap, so they are right wherever the result fits; pairs that may pass 63 bits
are summed again in whole numbers of any size, and a score beyond a long becomes the long's nearest limit. Ties go
to the smaller id. Fewer candidates than k: all. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import read, shard_count

QUERY = "op4_exact_topk"
#: Rows in a block of candidates and in a block of queries at most.
BLOCK_ROWS, QUERY_ROWS = 8192, 256
#: Candidates for each query: the shape of the grid.
SHARE = 50
_LIMIT = float(1 << 63)


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # from 2**52 on doubles are whole numbers, and floor() gives a long
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < float(1 << 52), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") > 0, whole).otherwise(F.array().cast("array<double>")).alias("vector"))


def _sparse(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and row, term, weight of the non-zero components of a batch."""
    column = batch.column("vector")
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    weight = np.nan_to_num(values)  # whole numbers
    full = weight != 0
    return batch.column("vec_id").to_numpy(), row[full], term[full], weight[full]


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows: ids, marks (16 bytes a row, where ``rows`` has a column mark of 32 hexadecimal digits),
    and row, term, weight of the components, sorted by term."""
    marked = "mark" in rows.columns

    def pack(batches):
        held: list[tuple] = []
        count = 0

        def block(parts, n):
            ids = np.concatenate([p[0] for p in parts])
            shift = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
            row = np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=False)])
            term, weight = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            order = np.argsort(term, kind="stable")
            small = np.int32 if not len(weight) or np.abs(weight).max() < 1 << 31 else np.float64  # doubles hold them exactly
            data = [ids, row[order].astype(np.int32), term[order].astype(np.int32), weight[order].astype(small)]
            found = [d.tobytes() for d in data] + [b"".join(p[4] for p in parts)]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in found] + [pa.array([small().itemsize], pa.int32())], ["ids", "row", "term", "weight", "marks", "width"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if count + piece.num_rows > size:
                    yield block(held, count)
                    held, count = [], 0
                held.append((*_sparse(piece), bytes.fromhex("".join(piece.column("mark").to_pylist())) if marked else b""))
                count += piece.num_rows
        if held:
            yield block(held, count)

    return rows.mapInArrow(pack, "ids binary, row binary, term binary, weight binary, marks binary, width int")


def _open(batch, prefix: str, k: int):
    get = lambda name, kind: np.frombuffer(batch.column(prefix + name)[k].as_buffer(), kind)
    return get("ids", np.int64), get("row", np.int32), get("term", np.int32), get("weight", np.int32 if batch.column(prefix + "width")[k].as_py() == 4 else np.float64)


def wrapped(weight: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64, as signed 64-bit integers."""
    if weight.dtype != np.float64:
        return weight.astype(np.int64)
    low = np.fmod(weight, 2 * _LIMIT)  # exact
    low[low >= _LIMIT] -= 2 * _LIMIT
    low[low < -_LIMIT] += 2 * _LIMIT
    return low.astype(np.int64)


def _settle(scores: np.ndarray, queries, candidates) -> None:
    """Sum pairs that may pass 63 bits again, in Python's integers, and hold them to the limits of a long."""
    q_ids, q_row, q_term, q_weight = queries
    c_ids, c_row, c_term, c_weight = candidates
    if not len(q_weight) or not len(c_weight):
        return
    sums, most = np.zeros(len(q_ids)), np.zeros(len(c_ids))
    np.add.at(sums, q_row, np.abs(q_weight.astype(np.float64)))
    np.maximum.at(most, c_row, np.abs(c_weight.astype(np.float64)))
    if sums.max() * most.max() < _LIMIT / 2:
        return
    rows = lambda row, term, weight, which: {r: {int(t): int(w) for t, w in zip(term[row == r], weight[row == r], strict=True)} for r in which}
    large, limit = np.argwhere(sums[:, None] * most[None, :] >= _LIMIT / 2), int(_LIMIT)
    asked, held = rows(q_row, q_term, q_weight, set(large[:, 0].tolist())), rows(c_row, c_term, c_weight, set(large[:, 1].tolist()))
    for r, c in large.tolist():
        score = sum(w * held[c].get(t, 0) for t, w in asked[r].items())
        scores[r, c] = min(max(score, -limit), limit - 1)


def accumulate(queries, candidates) -> np.ndarray:
    """Scores of all queries of a block against all candidates of a block, term at a time."""
    q_ids, q_row, q_term, q_weight = queries
    c_ids, c_row, c_term, c_weight = candidates
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    terms, starts = np.unique(q_term, return_index=True)
    ends = np.append(starts[1:], len(q_term))
    lists, heads = np.unique(c_term, return_index=True)
    tails = dict(zip(lists.tolist(), zip(heads.tolist(), np.append(heads[1:], len(c_term)).tolist(), strict=True), strict=True))
    for t, a, b in zip(terms.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if t not in tails:
            continue
        c, d = tails[t]
        docs, weights = c_row[c:d], wrapped(c_weight[c:d])
        whole = d - c == len(c_ids)  # every candidate has the term, in row order
        for r, w in zip(q_row[a:b].tolist(), wrapped(q_weight[a:b]), strict=True):
            if whole:
                scores[r] += w * weights
            else:
                scores[r, docs] += w * weights
    _settle(scores, queries, candidates)
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of one query's k best candidates, ties to smaller ids."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        held = scores[at]
        least = np.partition(held, len(held) - k)[len(held) - k]
        at = at[held >= least]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query (vec_id, vector)."""
    groups = shard_count(queries.sparkSession)
    down = max(1, int((groups / SHARE) ** 0.5))
    across = -(-groups // down)
    marked = queries.select("vec_id", "vector", F.md5(F.to_json("vector").cast("binary")).alias("mark"))
    asked = blocks(marked.dropDuplicates(["vec_id", "mark"]), QUERY_ROWS)
    names = ("ids", "row", "term", "weight", "marks", "width")
    # a block's place in the grid depends on its content, so a task that runs again deals it alike
    row, column = (F.pmod(F.xxhash64("ids", "weight"), F.lit(n)).cast("int") for n in (down, across))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in names], F.explode(F.sequence(row * across, row * across + across - 1)).alias("group"))
    held = blocks(candidates.select("vec_id", "vector"), BLOCK_ROWS)
    held = held.select(*names, F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: r * across + column)).alias("group"))

    def meet(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                q, c = _open(batch, "q_", j), _open(batch, "", j)
                scores = accumulate(q, c)
                best = [select(scores[r], c[0], own, k) for r, own in enumerate(q[0].tolist())]
                sizes = [len(b) for b in best]
                rows, cols = np.repeat(np.arange(len(best)), sizes), np.concatenate(best) if best else np.zeros(0, np.int64)
                marks = batch.column("q_marks")[j].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(q[0][rows]), pa.array([marks[16 * r : 16 * r + 16] for r in rows.tolist()], pa.binary()), pa.array(c[0][cols]), pa.array(scores[rows, cols])], ["query_id", "mark", "vec_id", "score"])

    found = held.join(asked, "group").mapInArrow(meet, "query_id long, mark binary, vec_id long, score long")
    # a query's rows: k from each block of candidates; mark tells apart different vectors with one id
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"), 256)
    return search(vectors.where("vec_id % 50 = 0"), vectors)


ORACLE_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
