"""Landing records to table rows. All functions work on batch and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.functions.documents import is_json
from forumlake.functions.text import edited_text
from forumlake.schemas import (
    ANSWER_RECORD,
    AUTHOR_RECORD,
    COMMENT_RECORD,
    MODEL_RECORD,
    POST_RECORD,
    PRICE_LIST,
    WEBSEARCH_RECORD,
)

RECORDS: dict[str, str] = {
    "posts": POST_RECORD,
    "comments": COMMENT_RECORD,
    "authors": AUTHOR_RECORD,
    "answers": ANSWER_RECORD,
    "models": MODEL_RECORD,
    "websearch": WEBSEARCH_RECORD,
}


def read_records(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(RECORDS[kind]).json(path)


def stream_records(
    spark: SparkSession, kind: str, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(RECORDS[kind])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def parse_records(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """JSON text in a column to records."""
    return lines.select(F.from_json(column, RECORDS[kind]).alias("r")).select("r.*")


def rejected_records(
    lines: DataFrame, kind: str, created_at: Column, column: str = "value"
) -> DataFrame:
    """Lines that are no JSON or carry no id, as rows of the ``errors`` table."""
    found = lines.select(F.col(column).alias("line"), F.from_json(column, RECORDS[kind]).alias("r"))
    bad_json = ~is_json("line")
    return found.filter(bad_json | F.col("r.id").isNull()).select(
        F.lit(None).cast("string").alias("item_id"), F.lit(kind).alias("item_type"),
        F.concat(F.when(bad_json, "malformed record: ").otherwise("record without id: "), "line")
        .alias("error"),
        created_at.alias("created_at"),
    )


def _identified(records: DataFrame) -> DataFrame:
    """The id columns are NOT NULL: a record without one is no row (see
    ``rejected_records``)."""
    return records.filter(F.col("id").isNotNull())


def post_rows(records: DataFrame) -> DataFrame:
    return _identified(records).select(
        F.col("id").alias("post_id"),
        F.col("subreddit.display_name").alias("subreddit"),
        F.col("author.name").alias("post_author"),
        F.col("title").alias("post_title"),
        F.col("selftext").alias("post_body"),
        F.col("created_utc").try_cast("int").alias("post_created_utc"),
        F.col("is_original_content").alias("is_post_oc"),
        F.col("is_video").alias("is_post_video"),
        F.col("ups").alias("post_upvote_count"),
        F.col("downs").alias("post_downvote_count"),
        F.col("subreddit_subscribers").alias("subreddit_members"),
    )


def comment_rows(records: DataFrame, *extra: str) -> DataFrame:
    """``extra`` names record columns to carry along (``parent_id`` for the tree)."""
    return _identified(records).select(
        F.col("id").alias("comment_id"),
        F.col("author.name").alias("comment_author"),
        F.col("is_submitter").alias("is_comment_submitter"),
        edited_text("edited").alias("is_comment_edited"),
        F.col("created_utc").try_cast("int").alias("comment_created_utc"),
        F.col("body").alias("comment_body"),
        F.col("submission.id").alias("post_id"),
        F.col("subreddit.display_name").alias("subreddit"),
        F.col("ups").alias("comment_upvote_count"),
        F.col("downs").alias("comment_downvote_count"),
        *extra,
    )


def author_rows(records: DataFrame) -> DataFrame:
    return _identified(records).select(
        F.col("id").alias("author_id"),
        F.col("name").alias("author_name"),
        F.col("created_utc").try_cast("int").alias("author_created_utc"),
    )


def websearch_rows(records: DataFrame, ts: Column | None = None) -> DataFrame:
    """One row per result of a lookup, in result order; ``result_no`` counts from 1. A result keeps
    its numbers, nested values and all its keys (in the order of their names)."""
    stamp = F.current_timestamp() if ts is None else ts
    return records.select(
        stamp.alias("ts"), "source", "post_id", "lookup_text", F.posexplode("results")
    ).select(
        "ts", "source", "post_id", "lookup_text",
        (F.col("pos") + 1).alias("result_no"),
        F.to_json("col").alias("websearch_result"),
    )


def model_rows(records: DataFrame) -> DataFrame:
    """The model inventory; ``details`` is JSON text with all its keys (in the order of their names)."""
    return records.filter(F.col("name").isNotNull()).select(
        "name", "model", "size", "digest", F.to_json("details").alias("details"), "expires_at", "size_vram")


def price_rows(lists: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Nested price lists to one row per price: kind, model, quality, size, price.

    Chat models give two rows, told apart by ``size`` = ``prompt`` or ``completion``.
    """
    entry = "struct<kind:string,model:string,quality:string,size:string,price:double>"
    # A column of its own, so that each list is parsed once.
    lists = lists.select(*keep, F.from_json(column, PRICE_LIST).alias("_p"))
    p = F.col("_p")
    none = F.lit(None).cast("string")

    def row(kind, model, quality, size, price):
        return F.struct(
            F.lit(kind).alias("kind"), model.alias("model"), quality.alias("quality"),
            size.alias("size"), price.alias("price"),
        ).cast(entry)

    def flat(kind, section):
        return F.transform(
            F.map_entries(section), lambda e: row(kind, e["key"], none, none, e["value"])
        )

    def images(section):
        return F.flatten(F.transform(F.map_entries(section), lambda m: F.flatten(F.transform(
            F.map_entries(m["value"]), lambda q: F.transform(
                F.map_entries(q["value"]),
                lambda s: row("images", m["key"], q["key"], s["key"], s["value"]),
            )
        ))))

    def chat(section):
        return F.flatten(F.transform(F.map_entries(section), lambda e: F.array(
            row("chat", e["key"], none, F.lit("prompt"), e["value"]["promptPrice"]),
            row("chat", e["key"], none, F.lit("completion"), e["value"]["completionPrice"]),
        )))

    empty = F.array().cast(f"array<{entry}>")
    prices = F.concat(
        F.coalesce(flat("embeddings", p["embeddings"]), empty),
        F.coalesce(images(p["images"]), empty),
        F.coalesce(flat("audio", p["audio"]), empty),
        F.coalesce(chat(p["chat"]), empty),
    )
    return lists.select(*keep, F.explode(prices).alias("e")).select(*keep, "e.*")
