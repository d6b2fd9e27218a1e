"""Row numbers within a key, batches and quotas, exact also when one key holds much of the data.

There is one way for all keys. Range partitions cut the rows anywhere, also inside a key.
Each piece numbers its own rows, and a key that began in an earlier piece goes on from the
number of its rows there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.session import durable


def _columns(order: str | Column | Sequence[str | Column]) -> list[Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _rows_before(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_p, _o_key …, _before): rows of a piece's first key in earlier pieces, where there are any.

    Only the first and the last key of a piece can lie in another piece too, so two counts a
    piece are enough, and at most one row a piece comes out.
    """
    key = F.struct(*[F.col(k).alias(f"_o_{k}") for k in keys])
    edges = pieces.groupBy(F.col("_part").alias("_p")).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    shared = pieces.join(F.broadcast(edges), F.col("_part") == F.col("_p")).where(
        key.eqNullSafe(F.col("_low")) | key.eqNullSafe(F.col("_high")))
    counted = shared.groupBy("_p", key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.sum("_rows").over(earlier)).where("_before IS NOT NULL").select(
        "_p", "_key.*", "_before")


def running_number(
    df: DataFrame, keys: str | Sequence[str], order: str | Column | Sequence[str | Column],
    out: str = "n",
) -> DataFrame:
    """1-based position of each row within its key. ``order`` must be total. NULL is a key
    like any other.

    The rows are written once, in pieces that follow the shuffle partitions. The broadcast
    has at most one row a piece.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = _columns(order)
    pieces = durable(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    before = F.broadcast(_rows_before(pieces, keys))
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = pieces.withColumn(out, F.row_number().over(within).cast("bigint"))
    same = [numbered[k].eqNullSafe(before[f"_o_{k}"]) for k in keys]
    return (
        numbered.join(before, [F.col("_part") == F.col("_p"), *same], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_p", "_before", *[f"_o_{k}" for k in keys])
    )


def batch_numbers(df: DataFrame, keys, order, size: int = 25, out: str = "batch_no") -> DataFrame:
    """Split each key's rows, in order, into batches of ``size``; batches count from 0."""
    return running_number(df, keys, order, "_n").withColumn(
        out, F.floor((F.col("_n") - 1) / size).cast("bigint")
    ).drop("_n")


QUOTA = 10  # fixed value: calls that pass before one is refused


def quota_state(prior: Column, calls: Column, quota: int = QUOTA) -> Column:
    """Counter after ``calls`` more calls: it returns to 0 on each refusal.

    A stored value above the quota never changes.
    """
    total = prior + calls
    return F.when((prior > quota) | (total <= 0), F.when(prior > quota, prior).otherwise(total)
                  ).otherwise(total % (quota + 1))


def quota_flags(
    calls: DataFrame,
    key: str,
    order,
    counters: DataFrame | None = None,
    quota: int = QUOTA,
    out: str = "allowed",
) -> DataFrame:
    """``quota`` calls per key pass, the next is refused and starts the count again.

    ``counters`` (key, value) holds the counts before the first call here; a
    stored value above the quota refuses every call. Its join keeps both sides directly
    behind a shuffle, where the adaptive skew join can split a heavy key.
    """
    numbered = running_number(calls, key, order, "_n")
    zero = F.lit(0).cast("bigint")
    if counters is None:
        started = numbered.withColumn("_v", zero)
    else:
        before = counters.select(
            F.col(key).alias("_k"), F.col("value").cast("bigint").alias("_v")
        )
        started = numbered.join(before, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(
            "_v", F.coalesce("_v", zero))
    total = F.col("_v") + F.col("_n")
    refused = (F.col("_v") > quota) | ((total > 0) & (total % (quota + 1) == 0))
    return started.withColumn(out, ~refused).drop("_n", "_v")


def quota_counters(
    calls: DataFrame, key: str, counters: DataFrame | None = None, quota: int = QUOTA
) -> DataFrame:
    """Counters (key, value) after ``calls``, keys without a call included."""
    counts = calls.groupBy(key).agg(F.count(F.lit(1)).alias("_calls"))
    if counters is None:
        return counts.select(
            key, quota_state(F.lit(0).cast("bigint"), F.col("_calls"), quota).alias("value")
        )
    before = counters.select(F.col(key), F.col("value").cast("bigint").alias("_v"))
    both = before.select(key, "_v", F.lit(0).cast("bigint").alias("_calls")).unionByName(
        counts.select(key, F.lit(None).cast("bigint").alias("_v"), "_calls")
    )
    merged = both.groupBy(key).agg(
        F.coalesce(F.max("_v"), F.lit(0).cast("bigint")).alias("_v"), F.sum("_calls").alias("_c")
    )
    return merged.select(
        key,
        F.when(F.col("_c") == 0, F.col("_v"))
        .otherwise(quota_state(F.col("_v"), F.col("_c"), quota)).alias("value"),
    )
