"""Reply trees and page bundles: grouped text, on request in pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.functions.documents import sha256_hex
from forumlake.functions.text import parent_comment_id
from forumlake.operators.numbering import running_number


def _pieces(df: DataFrame, keys: list[str], order: list[str], size: int | None) -> DataFrame:
    """``df`` with ``_n``, which has the order within the key, and ``piece``. Only pieces need numbers."""
    if size is None:
        return df.withColumn("_n", F.struct(*order)).withColumn("piece", F.lit(0))
    return running_number(df, keys, order, "_n").withColumn("piece", piece_of("_n", size))


def piece_of(number: str, size: int | None) -> Column:
    """The piece of an item by its number from 1; without a ``size`` all are in piece 0."""
    return F.lit(0) if size is None else F.floor((F.col(number) - 1) / size).cast("int")


def ordered_array(value: Column, order: Column) -> Column:
    """Array aggregate in a fixed order that keeps NULLs.

    A group must fit into memory; ``collect_in_pieces`` can cut larger ones.
    """
    return F.transform(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))),
        lambda x: x["v"],
    )


def collect_in_pieces(
    df: DataFrame, keys: list[str], value: str, order: list[str], out: str,
    size: int | None = None,
) -> DataFrame:
    """Per key the values in ``order``, NULLs kept, in one array or in arrays of at most ``size``.

    ``piece`` counts from 0.
    """
    cut = _pieces(df, keys, order, size)
    return cut.groupBy(*keys, "piece").agg(
        ordered_array(F.col(value), F.col("_n")).alias(out)
    )


def reply_edges(comments: DataFrame) -> DataFrame:
    """(post_id, parent, child, created): replies whose parent is a comment of the same post.

    Comments without a parent among them drop out.
    """
    edges = comments.select(
        "post_id", parent_comment_id("parent_id").alias("parent"),
        F.col("comment_id").alias("child"), F.col("comment_created_utc").alias("created"),
    )
    ids = comments.select(
        F.col("post_id").alias("_p"), F.col("comment_id").alias("_c")
    )
    return edges.join(
        ids, (F.col("post_id") == F.col("_p")) & (F.col("parent") == F.col("_c")), "left_semi"
    )


def comment_trees(comments: DataFrame, size: int | None = None) -> DataFrame:
    """(post_id, piece, parent_child_tree, shasum256): parent → children, in feed order.

    Feed order is (creation time, id). A post is one tree document, whatever its
    size. With ``size``, each piece holds at most so many edges and is a document of
    its own; together they hold every edge once. A post without replies among
    its comments gives ``{}``.
    """
    edges = _pieces(reply_edges(comments), ["post_id"], ["created", "child"], size)
    lists = edges.groupBy("post_id", "piece", "parent").agg(
        F.min("_n").alias("first"), ordered_array(F.col("child"), F.col("_n")).alias("children")
    )
    # One row without a parent per post, so that posts without edges appear too.
    posts = comments.select("post_id").distinct().select(
        "post_id", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast(lists.schema["first"].dataType).alias("first"),
        F.lit(None).cast("array<string>").alias("children"),
    )
    entry = F.when(F.col("parent").isNotNull(), F.struct("first", "parent", "children"))
    return lists.unionByName(posts).groupBy("post_id", "piece").agg(
        F.to_json(F.map_from_entries(F.transform(
            F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["parent"], e["children"])
        ))).alias("parent_child_tree")
    ).withColumn("shasum256", sha256_hex("parent_child_tree"))


def tree_rows(trees: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows for the tree table; its unique key is the hash, so empty trees share one row."""
    from forumlake.functions.times import epoch_text

    return trees.select(
        epoch_text(as_of).alias("timestamp"), "shasum256", "post_id", "parent_child_tree"
    )
