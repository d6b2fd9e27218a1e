"""The queries behind the service and its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.functions.documents import fields
from forumlake.functions.predicates import is_answer, not_profile_page, not_removed_by_site
from forumlake.functions.text import title_and_body
from forumlake.operators import joins
from forumlake.operators.joins import not_in
from forumlake.operators.numbering import running_number
from forumlake.operators.top import sample_one
from forumlake.operators.trees import piece_of
from forumlake.session import durable


def new_subreddits(posts: DataFrame, subscription: DataFrame) -> DataFrame:
    """Subreddits seen but not subscribed to. A NULL subscription leaves nothing."""
    seen = posts.filter(not_profile_page("subreddit")).select("subreddit").distinct()
    return not_in(seen, "subreddit", subscription, "subreddit")


def known_authors(authors: DataFrame) -> DataFrame:
    return authors.select("author_name").distinct()


def answered_posts(documents: DataFrame, post_id: str | None = None) -> DataFrame:
    """(post_id, analysis) of documents that name a post and hold an answer."""
    rows = fields(documents.select("analysis_document"), "analysis_document",
                  "post_id", "analysis")
    wanted = F.col("post_id").isNotNull() if post_id is None else F.col("post_id") == post_id
    return rows.filter(wanted & is_answer("analysis")).select("post_id", "analysis")


def bundles(
    posts: DataFrame, comments: DataFrame, documents: DataFrame, post_id: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """Posts that have documents and comments, each with both, or one such post.

    Columns: post_id, subreddit, post, piece, analysis_docs, comment_bodies. A post
    is one row, whatever its size. With ``size``, one with more items gives several
    rows, its documents first, so that no row grows without bound. NULL bodies are kept.
    Documents come by id, comments by time and id.

    The ids come first: which posts have both is found from id columns alone (of the
    documents their stored ones, see ``joins.with_id_columns``; the JSON text is parsed where
    they are missing). Texts are fetched for these posts only. Where these are few, the
    others' texts are not even shuffled.
    """
    named = joins.with_named(documents, ["reference_id"]).where("reference_id IS NOT NULL")
    # Stored id columns may hold a post_id of their own, which is not the one meant here.
    docs = named.select(F.col("reference_id").alias("post_id"), "id", "analysis_document")
    heads = posts.filter(not_removed_by_site("post_body"))
    bodies = comments
    if post_id is not None:
        docs, bodies, heads = (d.filter(F.col("post_id") == post_id) for d in (docs, bodies, heads))
    else:
        both = heads.select("post_id")
        for other in (docs, bodies):
            both = both.join(other.select("post_id"), "post_id", "left_semi")
        both = joins.broadcast_if_small(durable(both))
        docs, bodies, heads = (d.join(both, "post_id", "left_semi") for d in (docs, bodies, heads))
    items = docs.select(
        "post_id", F.lit(0).alias("kind"), F.col("id").cast("bigint").alias("at"), F.lit("").alias("tie"),
        F.col("analysis_document").alias("text"),
    ).unionByName(bodies.select(
        "post_id", F.lit(1).alias("kind"), F.col("comment_created_utc").cast("bigint").alias("at"),
        F.col("comment_id").alias("tie"), F.col("comment_body").alias("text"),
    ))
    order = ["kind", "at", "tie", "text"]
    if size is None:
        numbered = items.select("post_id", F.lit(0).alias("piece"), "kind", F.struct("at", "tie").alias("n"), "text")
    else:
        numbered = running_number(items, "post_id", order, "n").withColumn("piece", piece_of("n", size))
    entry = F.struct("n", "text")
    pieces = numbered.groupBy("post_id", "piece").agg(*[
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry))), lambda e: e["text"],
        ).alias(name)
        for kind, name in enumerate(("docs", "comment_bodies"))
    ])
    if post_id is not None:
        pieces = pieces.join(_of_both_kinds(items), "post_id", "left_semi")
    return heads.select(
        "post_id", "subreddit", title_and_body("post_title", "post_body", "  -  ").alias("post")
    ).join(pieces, "post_id").select(
        "post_id", "subreddit", "post", "piece",
        F.array_join("docs", ", ").alias("analysis_docs"), "comment_bodies",
    )


def _of_both_kinds(items: DataFrame) -> DataFrame:
    return items.groupBy("post_id").agg(F.min("kind").alias("_a"), F.max("kind").alias("_b")).where(
        "_a = 0 AND _b = 1").select("post_id")


def post_bundle(
    posts: DataFrame, comments: DataFrame, documents: DataFrame, seed=0, llm: str = "phi4",
    size: int | None = None,
) -> DataFrame:
    """The bundle of one sampled post that a document of ``llm`` names.

    The id is picked first, by a job that reads the documents' id columns, so that every use
    of it sees the same post and all scans look for one value. A post without comments
    gives no row.
    """
    names = ["reference_id", "category", "llm"]
    named = joins.with_named(documents, names).filter((F.col("category") == "post") & (F.col("llm") == llm))
    picked = sample_one(named.select(F.col("reference_id").alias("pid")), "pid", seed).first()
    pid = picked["pid"] if picked else None
    found = posts.limit(0) if pid is None else posts
    return bundles(found, comments, documents, pid or "", size).drop("post_id")


def bundle_groups(found: DataFrame) -> DataFrame:
    """Posts of one subreddit that carry the same comments, as one row: the array of
    bodies is part of the group key, the largest post text stands for the group.

    Where ``bundles`` cut a post, its pieces are put together first, so that the place of
    the cuts does not matter."""
    in_order = F.sort_array(F.collect_list(F.struct("piece", "comment_bodies")))
    whole = found.groupBy("post_id", "subreddit", "post").agg(
        F.flatten(F.transform(in_order, lambda p: p["comment_bodies"])).alias("comment_bodies")
    )
    return whole.groupBy("subreddit", "comment_bodies").agg(
        F.max("post").alias("post"), F.count(F.lit(1)).alias("posts")
    )
