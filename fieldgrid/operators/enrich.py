"""Readings joined to station metadata, and the key checks around the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_left(readings: DataFrame, meta: DataFrame, key: str, meta_key: str, columns: list[str]) -> DataFrame:
    """Left join that keeps ``columns`` of the metadata; its key goes. A repeated metadata key
    multiplies rows, and null keys match null keys. Spark broadcasts the metadata by its own size check."""
    small = meta.select(meta_key, *columns)
    return readings.join(small, readings[key].eqNullSafe(small[meta_key]), "left").drop(small[meta_key])


def keys_only_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(F.col(key).alias("key")).subtract(right.select(F.col(other).alias("key")))


def key_coverage(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """One row: distinct keys on the left, on the right, on both and on one side only; null is a key."""
    one = lambda df, c, side: df.select(F.col(c).alias("key"), F.lit(side).alias("side"))
    sides = one(left, key, 1).unionByName(one(right, other, 2)).groupBy("key").agg(F.bit_or("side").alias("sides"))
    count = lambda *v: F.count_if(F.col("sides").isin(*v))
    return sides.agg(count(1, 3).alias("n_left"), count(2, 3).alias("n_right"), count(3).alias("n_matched"), count(1).alias("n_left_only"), count(2).alias("n_right_only"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat a key that stands before them; nulls are equal."""
    distinct = F.countDistinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))
    return df.agg((F.count(F.lit(1)) - distinct).alias("n_duplicates"))
