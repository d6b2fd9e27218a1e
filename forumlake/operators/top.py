"""Limits, top-k and samples with a total order, so that ties are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """First ``k`` rows per key; every map task passes on at most ``k`` of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def sample_one(df: DataFrame, key: str, seed) -> DataFrame:
    """One row, the same on every use: the smallest hash of key and seed."""
    mixed = F.md5(F.concat(F.col(key), F.lit(str(seed))))
    return df.orderBy(mixed.asc_nulls_last(), F.col(key).asc_nulls_last()).limit(1)


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)
