"""Exact dedup: frequent digests found by Misra-Gries leave the shuffle, the rest uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forumlake.llm.common import all_columns, free_name
from forumlake.session import durable

#: A digest on more than this share of the rows is certain to be among the frequent ones.
#: At most 1 / SUPPORT digests are, which bounds what is broadcast (about 100 kB).
SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    one_space = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(one_space, 256)


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digest, best row and exact number of rows of each frequent digest.

    ``freqItems`` is the Misra-Gries summary: each task keeps 1 / support counters and the
    summaries are merged. Its candidates are then counted exactly, each task sending one
    row per candidate, and only those with copies are returned, stored.
    """
    candidates = digests.stat.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest"))
    counted = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.min("row").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return durable(counted.where("group_size > 1"))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> tuple[DataFrame, DataFrame]:
    """Each row's id, digest, group and whether it stays; and the frequent digests.

    Columns of the first: id, digest, keep (of the row that stays), group_size, kept.
    The row with the smallest id stays; a null id is larger than all others, and of
    rows that repeat an id one stays. The digests are stored first, so the whole texts
    are read and hashed once and everything after moves some 80 bytes a row.
    """
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                   F.monotonically_increasing_id().alias("n"))
    digests = durable(df.select(row.alias("row"), text_digest(F.col(text_col)).alias("digest")))
    hot = frequent_digests(digests, support)
    by_map = digests.join(F.broadcast(hot), "digest").select("digest", "row", "keep", "group_size")
    same = Window.partitionBy("digest")
    by_shuffle = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(
        "digest", "row", F.min("row").over(same).alias("keep"),
        F.count(F.lit(1)).over(same).alias("group_size"))
    groups = by_map.union(by_shuffle).select(
        F.col("row.id").alias("id"), "digest", "keep", "group_size",
        (F.col("row.n") == F.col("keep.n")).alias("kept"))
    return groups, hot


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Empty, blank and null texts are compared like any other (null as empty). An empty
    table gives no rows; columns other than the two named are not read.
    """
    groups, _ = exact_groups(df, id_col, text_col)
    return groups.select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", "kept",
        F.col("digest").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all its columns.

    Copies of frequent digests leave in the map tasks. The others meet their winners by
    digest and id; rows that repeat both are reduced to one on the same partitioning.
    """
    groups, hot = exact_groups(df, id_col, text_col)
    key, digest = free_name(df.columns, "copy_key"), free_name(df.columns, "copy_digest")

    def keyed(d: Column, i: Column) -> Column:
        return F.concat_ws(":", d, F.coalesce(i.cast("string"), F.lit("null")))

    winners = hot.select(F.col("digest").alias("hot_digest"), F.col("keep.id").alias("hot_id"))
    rows = df.withColumn(digest, text_digest(F.col(text_col)))
    rows = rows.withColumn(key, keyed(F.col(digest), F.col(id_col))).alias("rows")
    left = rows.join(F.broadcast(winners.alias("hot")), F.col(f"rows.{digest}") == F.col("hot.hot_digest"), "left")
    left = left.where(F.col("hot.hot_digest").isNull()
                      | F.col(f"rows.{id_col}").eqNullSafe(F.col("hot.hot_id")))
    left = left.select("rows.*")
    stay = groups.where("kept").select(keyed(F.col("digest"), F.col("id")).alias(key))
    return left.join(stay, key, "left_semi").dropDuplicates([key]).select(*all_columns(df))
