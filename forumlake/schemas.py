"""The twelve tables: schemas as Spark DDL and the unique keys that drive insert-or-ignore."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "posts": "post_id STRING NOT NULL, subreddit STRING, post_author STRING, post_title STRING, "
             "post_body STRING, post_created_utc INT, is_post_oc BOOLEAN, is_post_video BOOLEAN, "
             "post_upvote_count INT, post_downvote_count INT, subreddit_members INT",
    "comments": "comment_id STRING NOT NULL, comment_author STRING, is_comment_submitter BOOLEAN, "
                "is_comment_edited STRING, comment_created_utc INT, comment_body STRING, "
                "post_id STRING, subreddit STRING, comment_upvote_count INT, "
                "comment_downvote_count INT",
    "authors": "author_id STRING NOT NULL, author_name STRING, author_created_utc INT",
    "subscription": "datetimesubscribed STRING, subreddit STRING",
    "analysis_documents": "id INT NOT NULL, timestamp TIMESTAMP NOT NULL, shasum_512 STRING NOT NULL, "
                          "analysis_document STRING NOT NULL, ollama_ver STRING",
    "prompt_completion_details": "id INT NOT NULL, doc_shasum_512 STRING NOT NULL, ollama_host STRING, "
                                 "ollama_ver STRING NOT NULL, name STRING NOT NULL, "
                                 "model STRING NOT NULL, size BIGINT NOT NULL, digest STRING NOT NULL, "
                                 "details STRING NOT NULL, expires_at TIMESTAMP NOT NULL, "
                                 "size_vram BIGINT NOT NULL, created_at TIMESTAMP NOT NULL, "
                                 "prompt_completion_time INT NOT NULL, tokens_per_second FLOAT",
    "parent_child_tree_data": "id INT NOT NULL, timestamp STRING, shasum256 STRING, post_id STRING, "
                              "parent_child_tree STRING",
    "program_logs": "id INT NOT NULL, timestamp TIMESTAMP NOT NULL, log_json STRING NOT NULL",
    "servicelogs": "id INT NOT NULL, timestamp TIMESTAMP, host_name STRING, service_name STRING, "
                   "message STRING",
    "row_count_history": "id INT NOT NULL, table_name STRING, row_count INT, created_at TIMESTAMP_NTZ",
    "websearch_results_ts": "ts TIMESTAMP NOT NULL, id INT NOT NULL, source STRING, post_id STRING, "
                            "lookup_text STRING, websearch_result STRING NOT NULL",
    "errors": "item_id STRING, item_type STRING, error STRING, created_at TIMESTAMP_NTZ",
}

# Surrogate ids are left out: new rows get none until they are stored, so only
# the natural keys can conflict.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "posts": [["post_id"]],
    "comments": [["comment_id"]],
    "authors": [["author_id"]],
    "subscription": [],
    "analysis_documents": [["shasum_512"]],
    "prompt_completion_details": [],
    "parent_child_tree_data": [["shasum256"]],
    "program_logs": [],
    "servicelogs": [],
    "row_count_history": [],
    "websearch_results_ts": [],
    "errors": [],
}

# Records as they arrive in the landing folders.
POST_RECORD = (
    "id STRING, title STRING, selftext STRING, created_utc DOUBLE, is_original_content BOOLEAN, "
    "is_video BOOLEAN, ups INT, downs INT, subreddit_subscribers INT, "
    "subreddit STRUCT<display_name: STRING>, author STRUCT<name: STRING>"
)
COMMENT_RECORD = (
    "id STRING, parent_id STRING, body STRING, created_utc DOUBLE, edited STRING, "
    "is_submitter BOOLEAN, ups INT, downs INT, submission STRUCT<id: STRING>, "
    "subreddit STRUCT<display_name: STRING>, author STRUCT<name: STRING>"
)
AUTHOR_RECORD = ("id STRING, name STRING, created_utc DOUBLE")
ANSWER_RECORD = (
    "reference_id STRING, category STRING, llm STRING, llm_pos INT, "
    "message STRUCT<content: STRING>, eval_count BIGINT, eval_duration BIGINT, "
    "start_time DOUBLE, end_time DOUBLE, ts TIMESTAMP, ollama_ver STRING"
)
MODEL_RECORD = (
    "name STRING, model STRING, size BIGINT, digest STRING, "
    "details VARIANT, expires_at TIMESTAMP, size_vram BIGINT"
)
WEBSEARCH_RECORD = (
    "source STRING, post_id STRING, lookup_text STRING, results ARRAY<VARIANT>"
)
PRICE_LIST = (
    "embeddings MAP<STRING, DOUBLE>, images MAP<STRING, MAP<STRING, MAP<STRING, DOUBLE>>>, "
    "audio MAP<STRING, DOUBLE>, "
    "chat MAP<STRING, STRUCT<promptPrice: DOUBLE, completionPrice: DOUBLE>>"
)
