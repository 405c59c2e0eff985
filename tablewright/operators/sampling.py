"""Repeatable samples and splits that depend on a row key only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted


def hash_percent(key: Column, seed: int = 42, buckets: int = 100) -> Column:
    """0 … buckets − 1 from the first eight hex digits of md5(seed:key)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those of smallest md5, kept by TakeOrdered (no full sort)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), quoted(key).cast("string")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): about ``test_fraction`` of the keys go to test; a key never changes side."""
    h = hash_percent(quoted(key), seed, 10_000)
    cut = int(round(test_fraction * 10_000))
    return df.where(h >= cut), df.where(h < cut)


def nested_fractions(df: DataFrame, key: str, fractions: list[float], seed: int = 7) -> dict[float, DataFrame]:
    """Growing subsets, each contained in the next."""
    h = hash_percent(quoted(key), seed, 10_000)
    return {f: df.where(h < int(round(f * 10_000))) for f in fractions}
