"""Helpers against skew and against broadcasts of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 64
#: Below this number of rows no key is worth special treatment.
HOT_ROWS = 100_000
#: Counters of the frequent-items sketch. Its error is below 4 / TRACKED of the rows, far under HOT_SHARE.
TRACKED = 4096
#: A side of a join is broadcast up to this many rows, and only if it is counted first.
BROADCAST_ROWS = 200_000


def key_hash(keys: Sequence[str]) -> Column:
    """64-bit hash of a key. Nulls are told apart from each other's places by a marker."""
    parts: list[Column] = []
    for k in keys:
        parts += [F.col(k), F.col(k).isNull()]
    return F.xxhash64(*parts)


def hot_key_hashes(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, min_rows: int = HOT_ROWS, *also: Column) -> tuple[list[int], Row]:
    """Hashes of the keys that hold at least ``share`` of the rows (and ``min_rows``), and further aggregates of the same scan.

    One scan of the key columns fills a mergeable frequent-items sketch; no row is shuffled. What reaches
    the driver is bounded by ``1 / share`` numbers. A sketch may name a key that is a little too small, or a
    hash two keys share; callers treat the named keys another way, never with another result.
    """
    top = int(1 / share)
    found = df.withColumn("_h", key_hash(keys)).agg(F.count(F.lit(1)).alias("_n"), F.expr(f"approx_top_k(_h, {top}, {TRACKED})").alias("_top"), *also).head()
    least = max(min_rows, found["_n"] * share * 0.9)
    return [x["item"] for x in found["_top"] or [] if x["count"] >= least], found


def split_hot(df: DataFrame, keys: Sequence[str], hot: Sequence[int]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of the hot ones (None where there are none)."""
    if not hot:
        return df, None
    inside = key_hash(keys).isin(list(hot))
    return df.filter(~inside), df.filter(inside)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``limit`` rows, else as it is.

    The count stops at ``limit`` + 1 rows. Beyond it the join is left to a shuffle and adaptive execution.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
