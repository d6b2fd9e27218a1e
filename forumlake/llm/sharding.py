"""Shards by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forumlake.session import durable

HALF_ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Sides a and b of the Feistel domain: a * b is at least n, by less than a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """A permutation of 0 … a * b - 1: halves take turns in adding a hash of the other."""
    a, b = domain(n)
    left = F.pmod(x, F.lit(a))
    right = ((x - left) / a).cast("long")
    for i in range(HALF_ROUNDS):
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed + i).cast("long")), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed + i).cast("long")), F.lit(b)), F.lit(b))
    return right * F.lit(a) + left


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row number ``x`` in a reproducible shuffle of 0 … n - 1.

    A value of n or more is permuted again until it is below n. Fewer than a (about the
    square root of n) values lie outside, and a walk meets none twice, so that many steps
    always suffice; only the few rows that start outside make any.
    """
    a, b = domain(n)
    first = feistel(x, n, seed)
    outside = a * b - n
    if outside == 0:
        return first
    steps = F.when(first >= n, F.sequence(F.lit(1), F.lit(outside))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(
        steps, first, lambda at, _: F.when(at < n, at).otherwise(feistel(at, n, seed)))


def row_numbers(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with gapless numbers from 0 in the given total order, and their count.

    Range partitions are sorted and stored with places inside each; the numbers of the
    partitions (one row each) are summed and sent back to them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(starts), part == F.col("part")).withColumn(
        name, F.col("rows_before") + inside)
    return numbered.drop("place", "part", "rows_before"), placed.count()


def shuffle_shards(
    df: DataFrame, n_shards: int = 24, seed: int = 20_24, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shard and slot of every row under the law ``rows``.

    Rows are numbered by id (null last), then by size, checksum and place in the input,
    so equal texts and repeated rows are dealt out like all others. The permuted number p
    gives shard ``p % n_shards`` and slot ``p // n_shards``: counts differ by one at most
    and slots have no gaps. Null text has size 8 and the checksum of the empty text.
    An empty table gives no rows; columns other than the two named are not read.
    """
    text = F.col(text_col)
    sized = durable(df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("read_at")))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("read_at")]
    numbered, n = row_numbers(sized, order, "row_number")
    place = numbered.withColumn("p", permuted(F.col("row_number"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("p") % n_shards).cast("int").alias("shard"),
        ((F.col("p") - F.col("p") % n_shards) / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
