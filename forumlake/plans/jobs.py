"""The recurring jobs, from landing folders to the Parquet tables below one folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.operators import dml, enrichment, registry, trees
from forumlake.schemas import UNIQUE_KEYS
from forumlake.session import durable, path_exists
from forumlake.sources import feeds
from forumlake.sources.tables import read_table

REGISTRY = "registry"  # table of seen keys: key, claimed_at


def _table(spark: SparkSession, base: str, name: str) -> DataFrame:
    from forumlake.schemas import TABLES

    if path_exists(spark, f"{base}/{name}"):
        return read_table(spark, name, base)
    return spark.createDataFrame([], TABLES[name])


def _registry(spark: SparkSession, base: str) -> DataFrame:
    schema = "key string, claimed_at timestamp"
    if path_exists(spark, f"{base}/{REGISTRY}"):
        return spark.read.schema(schema).parquet(f"{base}/{REGISTRY}")
    return spark.createDataFrame([], schema)


def collect(
    spark: SparkSession, base: str, posts: DataFrame | None = None,
    comments: DataFrame | None = None, authors: DataFrame | None = None,
    as_of: Column | None = None,
) -> None:
    """Store feed records: unseen posts, comments, authors, and the reply trees of the
    comment records. The moderation bot's rows are kept here; the purge removes them."""

    def put(name: str, rows: DataFrame, order: Sequence) -> None:
        whole = F.md5(F.to_json(F.struct(*rows.columns)))  # rows that tie on it are equal
        dml.append_ignore(spark, f"{base}/{name}", rows, UNIQUE_KEYS[name], [*order, whole])

    if posts is not None:
        put("posts", feeds.post_rows(posts), ["post_created_utc", F.md5("post_body")])
    if authors is not None:
        put("authors", feeds.author_rows(authors), ["author_created_utc", "author_name"])
    if comments is not None:
        rows = feeds.comment_rows(comments, "parent_id")
        put("comments", rows.drop("parent_id"), ["comment_created_utc", F.md5("comment_body")])
        found = trees.tree_rows(trees.comment_trees(rows), as_of)
        put("parent_child_tree_data", found, ["post_id"])


def claim_and_prompt(
    spark: SparkSession, base: str, category: str, llms: Sequence[str], as_of: Column,
    languages: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Prompts for items that are readable, not analysed and not claimed.

    The items are claimed first; one in a foreign language stays claimed and gets
    no prompt. ``languages`` takes (id, text) and gives (id, lang).
    """
    documents = _table(spark, base, "analysis_documents")
    seen = registry.live(_registry(spark, base), as_of)
    if category == "post":
        posts = _table(spark, base, "posts")
        ids = enrichment.post_candidates(posts, documents, seen)
        texts = enrichment.post_text(posts)
    else:
        comments = _table(spark, base, "comments")
        ids = enrichment.comment_candidates(comments, documents, seen)
        texts = enrichment.comment_text(comments)
    key = f"{category}_id"
    # Stored before the claim, which changes what the candidates are.
    chosen = durable(texts.join(ids, key, "left_semi").filter(F.col("text").isNotNull()))
    chosen.select(
        F.concat(F.lit(f"{key}_"), F.col(key)).alias("key"), as_of.alias("claimed_at")
    ).write.mode("append").parquet(f"{base}/{REGISTRY}")
    if languages is not None:
        named = languages(chosen.select(F.col(key).alias("id"), "text"))
        chosen = enrichment.language_gate(
            chosen, named.withColumnRenamed("id", key), key, "lang"
        )
    return enrichment.prompt_table(chosen, key, category, llms)


def store_answers(
    spark: SparkSession, base: str, answers: DataFrame, models: DataFrame,
    key: Column | str | bytes | None = None, created_at: Column | None = None,
) -> None:
    """Answer records to document rows and performance rows, with ids that go on from the stored ones.

    One writer at a time: ids are counted on from the largest one stored."""
    finished = durable(enrichment.finish_answers(enrichment.stored_answers(answers), key))
    order = ["timestamp", "reference_id", "llm_pos"]
    unique = UNIQUE_KEYS["analysis_documents"]
    path = f"{base}/analysis_documents"
    if path_exists(spark, path):
        held = spark.read.schema("shasum_512 string").parquet(path)
        target = dml.conflicting_rows(held, finished, unique)
    else:
        target = finished.select("shasum_512").limit(0)
    new = dml.rows_to_insert(target, finished, unique, order)
    before = spark.read.schema("id int").parquet(path) if path_exists(spark, path) else None
    enrichment.document_rows(dml.with_ids(before, new, [*order, "shasum_512"])).write.mode(
        "append").parquet(path)

    # Behind the documents, and only of answers without one, so that a repeat adds nothing.
    path = f"{base}/prompt_completion_details"
    rows = enrichment.performance_rows(finished, models, created_at)
    before = None
    if path_exists(spark, path):
        before = spark.read.schema("id int, doc_shasum_512 string").parquet(path)
        rows = rows.join(before.select("doc_shasum_512"), "doc_shasum_512", "left_anti")
    order = ["doc_shasum_512", "name", "prompt_completion_time", "tokens_per_second", "ollama_ver"]
    dml.with_ids(before, rows, order).write.mode("append").parquet(path)


def purge(spark: SparkSession, base: str, out: str) -> None:
    """Posts and comments without the moderation bot's rows, as new tables below ``out``."""
    for name, author in (("posts", "post_author"), ("comments", "comment_author")):
        table = _table(spark, base, name)
        dml.purge_bot(table, author).write.mode("errorifexists").parquet(f"{out}/{name}")


def refresh_upvotes(
    spark: SparkSession, base: str, updates: DataFrame, out: str, order: Sequence
) -> None:
    """Posts with new upvote counts (post_id, post_upvote_count) as a new table. Of several
    counts of a post the last by ``order`` holds."""
    posts = _table(spark, base, "posts")
    dml.update_by_key(posts, updates, "post_id", "post_upvote_count", order).write.mode(
        "errorifexists").parquet(f"{out}/posts")


def subscribe_new(spark: SparkSession, base: str, as_of: Column) -> DataFrame:
    """Subreddits to join, as rows of the subscription table."""
    from forumlake.functions.times import epoch_text
    from forumlake.plans.service import new_subreddits

    found = new_subreddits(_table(spark, base, "posts"), _table(spark, base, "subscription"))
    return found.select(epoch_text(as_of).alias("datetimesubscribed"), "subreddit")
