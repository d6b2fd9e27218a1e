"""The batch around a language model: candidates, prompts, answers, documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.functions.documents import analysis_document, encrypt_text, sha512_hex
from forumlake.functions.predicates import (
    has_text,
    has_text_by_hash,
    human_author,
    passes_language_gate,
)
from forumlake.functions.keys import registry_key
from forumlake.functions.text import sanitize, title_and_body
from forumlake.functions.times import elapsed_seconds, tokens_per_second
from forumlake.operators.joins import each_of, subtract_distinct, with_model, without_documents
from forumlake.operators.registry import keys_of

# What stands before the text, per kind of item, and the JSON
# fields under which documents name their item.
PROMPT_PREFIX = {
    "post": "respond to this post title and post body: ",
    "comment": "respond to this comment: ",
}
POST_FIELDS = ("post_id", "reference_id")
COMMENT_FIELDS = ("comment_id", "reference_id")


def unanalyzed_posts(posts: DataFrame, documents: DataFrame) -> DataFrame:
    readable = posts.filter(has_text("post_body")).select("post_id")
    return without_documents(readable, "post_id", documents, POST_FIELDS)


def unanalyzed_comments(comments: DataFrame, documents: DataFrame) -> DataFrame:
    readable = comments.filter(has_text_by_hash("comment_body")).select("comment_id")
    return without_documents(readable, "comment_id", documents, COMMENT_FIELDS)


def post_candidates(posts: DataFrame, documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Unanalysed posts whose key is not claimed."""
    return subtract_distinct(unanalyzed_posts(posts, documents), keys_of(registry, "post_id"))


def comment_candidates(
    comments: DataFrame, documents: DataFrame, registry: DataFrame
) -> DataFrame:
    return subtract_distinct(
        unanalyzed_comments(comments, documents), keys_of(registry, "comment_id")
    )


def post_text(posts: DataFrame, post_id: str | None = None) -> DataFrame:
    """(post_id, text) of readable posts, of one post if an id is given."""
    rows = posts if post_id is None else posts.filter(F.col("post_id") == post_id)
    return rows.filter(has_text("post_body")).select(
        "post_id", title_and_body("post_title", "post_body").alias("text")
    )


def comment_text(comments: DataFrame, comment_id: str | None = None) -> DataFrame:
    rows = comments if comment_id is None else comments.filter(F.col("comment_id") == comment_id)
    return rows.filter(has_text("comment_body")).select(
        "comment_id", F.col("comment_body").alias("text")
    )


def language_gate(items: DataFrame, languages: DataFrame, key: str, lang: str) -> DataFrame:
    """Items in English and items without a known language."""
    known = languages.select(F.col(key).alias("_k"), F.col(lang).alias("_lang"))
    return (
        items.join(known, F.col(key) == F.col("_k"), "left")
        .filter(passes_language_gate("_lang")).drop("_k", "_lang")
    )


def prompt_table(texts: DataFrame, key: str, category: str, llms: Sequence[str]) -> DataFrame:
    """One prompt per text and model name, with the name's place in the list."""
    return each_of(texts, llms, "llm", "llm_pos").select(
        F.col(key).alias("reference_id"), F.lit(category).alias("category"), "llm", "llm_pos",
        F.concat(F.lit(PROMPT_PREFIX[category]), F.col("text")).alias("prompt"),
    )


def run_inference(prompts: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """Let the caller's function answer the prompts, one Arrow batch at a time.

    ``answer`` takes and gives an iterator of pandas frames; a client opened at
    its start serves the whole partition.
    """
    return prompts.mapInPandas(answer, schema)


def finish_answers(answers: DataFrame, key: Column | str | bytes | None = None) -> DataFrame:
    """Cleaned text, its SHA-512, tokens per second and elapsed seconds, for records of
    the answer feed. With ``key`` the text is stored encrypted; the hash stays that of
    the plain text."""
    clean = answers.withColumn("_plain", sanitize("message.content"))
    stored = F.col("_plain") if key is None else encrypt_text("_plain", key)
    return clean.select(
        F.col("ts").alias("timestamp"), "reference_id", "category", "llm", "llm_pos",
        sha512_hex("_plain").alias("shasum_512"), stored.alias("analysis"), "ollama_ver",
        tokens_per_second("eval_count", "eval_duration").alias("tokens_per_second"),
        elapsed_seconds("start_time", "end_time").alias("prompt_completion_time"),
    )


def stored_answers(answers: DataFrame) -> DataFrame:
    """The answers that are kept: of comments every model's, of posts only the last
    model's.

    Use it before ``finish_answers``, so that nothing is spent on the others. The
    last answer of a post is a maximum, which reduces before the shuffle.
    """
    posts = (
        answers.filter(F.col("category") == "post")
        .groupBy("reference_id")
        .agg(F.max_by(F.struct(*answers.columns), F.col("llm_pos")).alias("r"))
        .select("r.*")
    )
    return answers.filter(F.col("category") == "comment").unionByName(posts)


def document_rows(stored: DataFrame) -> DataFrame:
    """Rows of the document table, with the ids, category and model that they name as columns.
    Where the answers have an ``id``, so have the rows."""
    rows = stored.select(
        *[c for c in ("id",) if c in stored.columns], "timestamp", "shasum_512",
        analysis_document("category", "reference_id", "llm", "analysis").alias("analysis_document"),
        "ollama_ver", F.lit(None).cast("string").alias("post_id"),
        F.lit(None).cast("string").alias("comment_id"), "reference_id", "category", "llm",
    )
    return rows


def performance_rows(stored: DataFrame, models: DataFrame, created_at: Column | None = None
                     ) -> DataFrame:
    """One performance row per stored answer of a known model.

    ``digest`` holds the document hash and ``ollama_host`` is empty, as in the
    table's existing rows.
    """
    stamp = F.current_timestamp() if created_at is None else created_at
    kind = models.schema["details"].dataType.simpleString()
    text = F.col("details") if kind == "string" else F.to_json("details", {"ignoreNullFields": "false"})
    inventory = models.select("name", "model", "size", text.alias("details"), "expires_at", "size_vram")
    return with_model(stored, "llm", inventory).select(
        F.col("shasum_512").alias("doc_shasum_512"), F.lit("").alias("ollama_host"),
        F.col("ollama_ver"), F.col("model_name").alias("name"), "model", "size",
        F.col("shasum_512").alias("digest"),
        "details", "expires_at", "size_vram", stamp.alias("created_at"),
        "prompt_completion_time", "tokens_per_second",
    )


def new_authors(
    posts: DataFrame, comments: DataFrame, authors: DataFrame, registry: DataFrame | None = None
) -> DataFrame:
    """Human authors of posts and comments that are not stored and not marked as gone."""
    seen = (
        posts.select(F.col("post_author").alias("author_name"))
        .unionByName(comments.select(F.col("comment_author").alias("author_name")))
        .filter(human_author("author_name")).distinct()
    )
    rows = seen.join(authors.select("author_name"), "author_name", "left_anti")
    if registry is None:
        return rows
    return _without_marks(rows, registry)


def authors_to_refresh(authors: DataFrame, registry: DataFrame) -> DataFrame:
    """Known authors without a mark that they are gone or closed."""
    return _without_marks(authors.select("author_name").distinct(), registry)


def _without_marks(rows: DataFrame, registry: DataFrame) -> DataFrame:
    marks = registry.select(F.col("key").alias("_mark"))
    return rows.join(
        marks, registry_key("author_id", "author_name") == F.col("_mark"), "left_anti"
    )


def request_routes(
    requests: DataFrame, key: str, unanalyzed: DataFrame, unanalyzed_key: str
) -> DataFrame:
    """(key, route) per requested id: an id in the list of unanalysed ids is skipped, any
    other is fetched and analysed."""
    requests = requests.select(key).distinct()
    listed = unanalyzed.select(F.col(unanalyzed_key).alias("_u")).distinct()
    return requests.join(listed, F.col(key) == F.col("_u"), "left").select(
        key, F.when(F.col("_u").isNotNull(), "skip").otherwise("fetch").alias("route")
    )


