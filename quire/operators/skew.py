"""Joins whose large side has hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the large side, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.01
#: Keys with fewer rows than this are never split.
HOT_LEAST = 20_000


def hot_keys(counts: DataFrame, key: str, n: str, share: float = HOT_SHARE, least: int = HOT_LEAST) -> list:
    """The keys whose count exceeds both limits, from a table (key, n); at most 1 / share of them reach the driver."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(least, int(total * share))
    return [] if total <= least else [r[0] for r in counts.where(F.col(n) > limit).select(key).collect()]


def hot_join(big: DataFrame, small: DataFrame, key: str, hot: list, spread: Column, how: str = "inner", fan: int = 16) -> DataFrame:
    """big joined with small (unique by key) on key.

    Rows of the hot keys are dealt over `fan` partitions by the hash of `spread`, the single matching row of small is
    repeated for each of them. Null keys of big match nothing and stay for how="left".
    """
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(fan)).cast("int")).otherwise(0))
    deal = F.when(is_hot, F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("__salt", F.explode(deal))
    return left.join(right, [key, "__salt"], how).drop("__salt")
