"""What the operators share: reading tables, shared folders, Arrow batch bounds, deterministic shards."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import shared_dir, stored

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_ROWS", "bound_batches", "join_bounded", "range_cuts", "read", "shard_count", "shard_of", "shared_dir", "stored"]

#: Bounds of one Arrow batch: rows, and bytes (a longer row makes a batch of its own).
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A side is broadcast only up to so many rows of a few integers each (about 32 MB).
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: rows here are whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def join_bounded(df: DataFrame, side: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a narrow ``side``; it is broadcast only if a count shows that it is within the bound.

    Beyond the bound it is an ordinary shuffled join, with the same rows.
    """
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, key, how)


def shard_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_cuts(df: DataFrame, key: str, weight: str, shards: int) -> list[int]:
    """Upper bounds (inclusive) of key ranges of about equal summed weight; the last range is open.

    Integer sums over equal-width key buckets are exact, so unlike sampled range boundaries the cuts
    depend on the rows alone, not on how they are spread over files and tasks. A bucket that holds
    far more than a share (ids in dense clumps) is divided again until it is small or one key wide.
    At most ``8 * shards`` sums come to the driver in each step. Null keys sort before all.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(weight).cast("long").alias("w"))
    low, high, total = rows.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None or shards < 2:
        return []
    share, fan = max(1, -(-total // shards)), max(4096, 8 * shards)

    def sums(lo: int, hi: int) -> list[tuple[int, int]]:
        """(upper bound, weight) of the buckets between two keys, in order."""
        width = max(1, -(-(hi - lo + 1) // fan))
        at = F.expr(f"(k - ({lo})) div {width}")
        found = rows.where(F.col("k").between(lo, hi)).groupBy(at.alias("b")).agg(F.sum("w").alias("w")).collect()
        out = []
        for b, w in sorted((r.b, r.w) for r in found):
            first, last = lo + b * width, min(hi, lo + (b + 1) * width - 1)
            out += sums(first, last) if w > 2 * share and last > first else [(last, w)]
        return out

    cuts, filled = [], 0
    for upper, w in sums(low, high):
        if filled and filled + w > share:
            cuts.append(before)
            filled = 0
        filled, before = filled + w, upper
    return cuts


def shard_of(cuts: list[int], key: int | None) -> int:
    """Number of the shard that holds ``key``; nulls go to the first."""
    return 0 if key is None else bisect_left(cuts, key)
