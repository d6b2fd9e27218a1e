"""Every registered query with its SQL counterpart over the test tables.

``@query(name, views, sql)`` registers a function of ``TestTables``. The views
named are put before the SQL as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.functions import documents as docs
from forumlake.functions import keys, predicates, sql_functions, text, times, versions
from forumlake.operators import dml, enrichment, joins, language, numbering, registry, top, trees
from forumlake.plans import dashboard, service
from forumlake.schemas import UNIQUE_KEYS
from forumlake.session import fresh_path, spread
from forumlake.sources import feeds, logs, tables
from forumlake.sources.adapters import BASE_TABLES, TestTables, view_sql
from forumlake.streaming import ingest, state, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LLMS = ["phi4", "gemma2", "llama3"]
FIVE_DAYS = 5 * 24 * 3600


def query(name: str, views: str = "", sql: str | None = None):
    def register(build: Callable[[TestTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # days are UTC days
            return build(TestTables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = _with_views(views.split(), sql.strip())
        return build

    return register


def _with_views(views: list[str], sql: str) -> str:
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS (\n{view_sql(v)}\n)" for v in views)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{ctes},\n{sql[len(start):]}"
    return f"WITH {ctes}\n{sql}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NO_TEXT = "('', '[removed]', '[deleted]')"


# --- dashboard ---------------------------------------------------------------

@query("author_subreddits", "posts comments", """
SELECT post_author, subreddit FROM posts
UNION
SELECT comment_author, subreddit FROM comments
ORDER BY post_author ASC NULLS LAST, subreddit ASC NULLS LAST
""")
def _(t):
    return dashboard.author_subreddits(t.posts, t.comments)


@query("author_posts_comments", "posts comments", """
SELECT p.post_id, p.post_title, p.post_body, p.post_created_utc, p.post_author,
  c.comment_author, c.comment_id, c.comment_body, c.comment_created_utc
FROM posts p JOIN comments c ON p.post_author = c.comment_author
WHERE p.post_body NOT IN ('[removed]', '')
""")
def _(t):
    return dashboard.author_posts_comments(t.posts, t.comments)


@query("avg_time_by_model", "prompt_completion_details", """
SELECT DISTINCT model, round(avg(prompt_completion_time) OVER (PARTITION BY model), 6)
  AS avg_completion_time
FROM prompt_completion_details
""")
def _(t):
    return rounded(dashboard.avg_time_by_model(t.prompt_completion_details),
                   "avg_completion_time")


@query("completions_per_day", "analysis_documents", """
SELECT CAST(ts AS DATE) AS date, count(analysis_document) AS num_documents
FROM analysis_documents
WHERE ts >= TIMESTAMP '2024-08-22' AND ts < TIMESTAMP '2024-09-07'
GROUP BY ALL
""")
def _(t):
    return dashboard.completions_per_day(t.analysis_documents, "ts")


def _counted(t: TestTables) -> dict[str, DataFrame]:
    """Tables for the row counts, read by footers; the last four stand for tables that filters name."""
    t = TestTables(t.spark, t.sf_dir, footers=True)
    names = [*BASE_TABLES, "posts", "comments", "authors", "subscription",
             "analysis_documents", "prompt_completion_details"]
    found = {n: getattr(t, n) for n in names}
    found |= {"parent_child_tree_data": t.conversations, "websearch_results_ts": t.pages,
              "row_count_history": t.events, "pg_stats": t.region}
    return found


_COUNT_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows_n FROM {source}" for n, source in (
        *[(n, n) for n in BASE_TABLES],
        *[(n, n) for n in ("posts", "comments", "authors", "subscription", "analysis_documents",
                           "prompt_completion_details")],
        ("parent_child_tree_data", "conversations"), ("websearch_results_ts", "pages"),
        ("row_count_history", "events"), ("pg_stats", "region"),
    )
)
_COUNTED_VIEWS = (
    "posts comments authors subscription analysis_documents prompt_completion_details"
)


@query("table_row_counts", _COUNTED_VIEWS, f"""
SELECT table_name, rows_n FROM ({_COUNT_SQL})
WHERE table_name NOT LIKE 'pg_%' ORDER BY rows_n DESC, table_name
""")
def _(t):
    return dashboard.table_row_counts(_counted(t))


@query("table_row_counts_dashboard", _COUNTED_VIEWS, f"""
SELECT table_name, rows_n FROM ({_COUNT_SQL})
WHERE table_name NOT LIKE 'pg_%' AND table_name <> 'parent_child_tree_data'
  AND table_name <> 'websearch_results_ts'
ORDER BY rows_n DESC, table_name LIMIT 1000
""")
def _(t):
    return dashboard.table_row_counts_dashboard(_counted(t))


@query("row_count_snapshot", _COUNTED_VIEWS, f"""
SELECT table_name, rows_n AS row_count, TIMESTAMP '2024-08-01 00:05:00' AS created_at
FROM ({_COUNT_SQL})
WHERE table_name NOT LIKE 'pg_%' AND table_name <> 'row_count_history'
""")
def _(t):
    return dml.row_count_snapshot(_counted(t), F.lit("2024-08-01 00:05:00").cast("timestamp_ntz"))


@query("top10_posts", "posts", """
SELECT post_title, post_upvote_count, subreddit FROM posts
WHERE post_upvote_count > 100
ORDER BY post_upvote_count DESC, post_id LIMIT 10
""")
def _(t):
    return dashboard.top10_posts(t.posts)


@query("recent10_per_subreddit", "posts", """
SELECT DISTINCT subreddit, title AS top_ten_posts, votes AS max_post_upvote_count
FROM (SELECT subreddit, post_title AS title, post_upvote_count AS votes FROM posts
      WHERE NOT (post_title IN ('[deleted by user]', '[deleted]'))
        AND list_contains(['democrats', 'Republican', 'Libertarian'], subreddit)
      QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY post_id DESC) < 11)
""")
def _(t):
    return dashboard.recent10_per_subreddit(t.posts)


@query("avg_time_by_release", "prompt_completion_details", """
SELECT DISTINCT ollama_ver, model,
  round(avg(prompt_completion_time) OVER (PARTITION BY ollama_ver, model), 6)
    AS avg_completion_time
FROM prompt_completion_details WHERE ollama_ver <> 'false'
""")
def _(t):
    return rounded(dashboard.avg_time_by_release(t.prompt_completion_details),
                   "avg_completion_time")


@query("avg_tps_by_model", "prompt_completion_details", """
SELECT model, round(sum(tokens_per_second) / count(tokens_per_second), 6)
  AS avg_tokens_per_second
FROM prompt_completion_details
WHERE NOT list_contains(['false', '0.3.10-rc1'], ollama_ver) AND tokens_per_second IS NOT NULL
GROUP BY model
""")
def _(t):
    return rounded(dashboard.avg_tps_by_model(t.prompt_completion_details),
                   "avg_tokens_per_second")


_DONE = """
done AS (
  SELECT unnest([
    json_extract_string(analysis_document, '$.comment_id'),
    json_extract_string(analysis_document, '$.post_id'),
    json_extract_string(analysis_document, '$.reference_id')]) AS id
  FROM analysis_documents)
"""


@query("remaining_to_analyze", "posts comments analysis_documents", f"""
WITH {_DONE.strip()},
readable AS (
  SELECT 'comments' AS label, comment_id AS id, comment_body AS body FROM comments
  UNION ALL SELECT 'posts', post_id, post_body FROM posts),
open AS (
  SELECT label FROM readable ANTI JOIN done USING (id) WHERE body NOT IN {NO_TEXT})
SELECT 'comments' AS label, count(*) FILTER (label = 'comments') AS count FROM open
UNION ALL SELECT 'posts', count(*) FILTER (label = 'posts') FROM open
""")
def _(t):
    return dashboard.remaining_to_analyze(t.posts, t.comments, t.analysis_documents)


@query("tokens_per_day", "prompt_completion_details", """
SELECT CAST(expires_at AS DATE) AS date,
  round(sum(CASE WHEN prompt_completion_time IS NULL THEN tokens_per_second
            ELSE CAST(prompt_completion_time AS DOUBLE) * tokens_per_second END), 6)
    AS total_tokens
FROM prompt_completion_details WHERE tokens_per_second > 0
GROUP BY ALL ORDER BY total_tokens DESC, date LIMIT 30
""")
def _(t):
    return rounded(dashboard.tokens_per_day(t.prompt_completion_details), "total_tokens")


# --- service -----------------------------------------------------------------

_UNANALYZED = _DONE + """,
unanalyzed_posts AS (
  SELECT post_id FROM posts ANTI JOIN done ON done.id = posts.post_id
  WHERE post_body NOT IN ('', '[removed]', '[deleted]')),
unanalyzed_comments AS (
  SELECT comment_id FROM comments ANTI JOIN done ON done.id = comments.comment_id
  WHERE NOT list_contains(
    list_transform(['', '[removed]', '[deleted]'], lambda x: md5(x)), md5(comment_body)))
"""
_DOC_VIEWS = "posts comments analysis_documents"


@query("unanalyzed_posts", _DOC_VIEWS, f"WITH {_UNANALYZED.strip()} SELECT * FROM unanalyzed_posts")
def _(t):
    return enrichment.unanalyzed_posts(t.posts, t.analysis_documents)


@query("unanalyzed_comments", _DOC_VIEWS,
       f"WITH {_UNANALYZED.strip()} SELECT * FROM unanalyzed_comments")
def _(t):
    return enrichment.unanalyzed_comments(t.comments, t.analysis_documents)


_SEEN = """
SELECT DISTINCT CASE WHEN event_type = 'click' THEN concat('comment_id_c', user_id)
  ELSE concat('post_id_p', user_id) END AS key FROM {events}
"""


def _seen(t: TestTables) -> DataFrame:
    return t.events.selectExpr(
        "CASE WHEN event_type = 'click' THEN concat('comment_id_c', user_id) "
        "ELSE concat('post_id_p', user_id) END AS key"
    ).distinct()


@query("analysis_candidates", _DOC_VIEWS, f"""WITH {_UNANALYZED.strip()},
seen AS ({_SEEN.format(events='events')})
SELECT 'post' AS category, post_id AS id FROM unanalyzed_posts
WHERE post_id NOT IN (SELECT replace(key, 'post_id_', '') FROM seen WHERE key LIKE 'post_id%')
UNION
SELECT 'comment', comment_id FROM unanalyzed_comments
WHERE comment_id NOT IN
  (SELECT replace(key, 'comment_id_', '') FROM seen WHERE key LIKE 'comment_id%')
""")
def _(t):
    seen = _seen(t)
    posts = enrichment.post_candidates(t.posts, t.analysis_documents, seen)
    comments = enrichment.comment_candidates(t.comments, t.analysis_documents, seen)
    return posts.select(F.lit("post").alias("category"), F.col("post_id").alias("id")).union(
        comments.select(F.lit("comment"), "comment_id")
    )


@query("new_subreddits", "posts subscription", """
SELECT DISTINCT subreddit FROM posts
WHERE length(subreddit) < 2 OR subreddit[1] <> 'u'
EXCEPT SELECT subreddit FROM subscription
""")
def _(t):
    return service.new_subreddits(t.posts, t.subscription)


_PAGES = """
named AS (
  SELECT json_extract_string(analysis_document, '$.reference_id') AS post_id,
    json_extract_string(analysis_document, '$.category') AS category,
    json_extract_string(analysis_document, '$.llm') AS llm, id, analysis_document AS doc
  FROM analysis_documents),
talk AS (
  SELECT post_id, array_to_string(list(coalesce(comment_body, '<null>')
    ORDER BY comment_created_utc, comment_id), '|') AS comment_bodies
  FROM comments GROUP BY post_id),
answers AS (
  SELECT post_id, string_agg(doc, ', ' ORDER BY id) AS analysis_docs FROM named GROUP BY post_id),
pages AS (
  SELECT post_id, subreddit, post_title || '  -  ' || post_body AS post, 0 AS piece,
    analysis_docs, comment_bodies
  FROM posts JOIN talk USING (post_id) JOIN answers USING (post_id)
  WHERE NOT starts_with(post_body, '[ Removed by Reddit ]'))
"""


@query("post_bundle", _DOC_VIEWS, f"""WITH {_PAGES.strip()}
SELECT subreddit, post, piece, analysis_docs, comment_bodies FROM pages
WHERE post_id = (SELECT post_id FROM named WHERE category = 'post' AND llm = 'phi4'
  ORDER BY md5(post_id || '30') NULLS LAST, post_id NULLS LAST LIMIT 1)
""")
def _(t):
    bundle = service.post_bundle(t.posts, t.comments, t.analysis_documents, seed=30)
    return bundle.withColumn("comment_bodies", F.array_join("comment_bodies", "|", "<null>"))


@query("post_bundles", _DOC_VIEWS, f"""WITH {_PAGES.strip()} SELECT * FROM pages""")
def _(t):
    found = service.bundles(t.posts, t.comments, t.analysis_documents)
    return found.withColumn("comment_bodies", F.array_join("comment_bodies", "|", "<null>"))


# Each comment under its own post and under a second one of its subreddit, so that groups merge.
_TWINS = _PAGES.replace("FROM comments GROUP BY", "FROM twin_comments GROUP BY").replace(
    "FROM posts JOIN", "FROM twin_posts JOIN").replace("FROM named GROUP BY", "FROM twin_named GROUP BY")
_TWIN_SQL = """
twin_posts AS (SELECT post_id, subreddit, post_title, post_body FROM posts
  UNION ALL SELECT post_id || '+', subreddit, post_title || '+', post_body FROM posts),
twin_comments AS (SELECT post_id, comment_created_utc, comment_id, comment_body FROM comments
  UNION ALL SELECT post_id || '+', comment_created_utc, comment_id, comment_body FROM comments),
"""


@query("bundle_groups", _DOC_VIEWS, f"""WITH {_TWIN_SQL.strip()}
{_TWINS.strip().replace("answers AS (", """twin_named AS (
  SELECT post_id, id, doc FROM named UNION ALL SELECT post_id || '+', id, doc FROM named),
answers AS (""")}
SELECT subreddit, comment_bodies, max(post) AS post, count(*) AS posts FROM pages
GROUP BY ALL
""")
def _(t):
    posts = t.posts.select("post_id", "subreddit", "post_title", "post_body")
    comments = t.comments.select("post_id", "comment_created_utc", "comment_id", "comment_body")
    named = joins.with_named(t.analysis_documents, ["reference_id", "category", "llm"]).where(
        "reference_id IS NOT NULL")

    def twice(df, *columns):
        second = df.withColumns({c: F.concat(c, F.lit("+")) for c in columns})
        return df.unionByName(second)

    found = service.bundles(
        twice(posts, "post_id", "post_title"), twice(comments, "post_id"), twice(named, "reference_id"))
    return service.bundle_groups(found).withColumn(
        "comment_bodies", F.array_join("comment_bodies", "|", "<null>")
    )


@query("known_authors", "authors", "SELECT author_name FROM authors GROUP BY author_name")
def _(t):
    return service.known_authors(t.authors)


@query("new_feed_ids", "posts", """
SELECT id FROM (SELECT concat('p', c_custkey) AS id FROM customer)
EXCEPT SELECT post_id FROM posts
""")
def _(t):
    feed = t.customer.selectExpr("concat('p', c_custkey) AS id")
    return joins.new_ids(feed, "id", t.posts, "post_id")


@query("post_prompt_text", "posts", f"""
SELECT post_id, post_title || post_body AS text FROM posts WHERE post_body NOT IN {NO_TEXT}
""")
def _(t):
    return enrichment.post_text(t.posts)


@query("comment_prompt_text", "comments", f"""
SELECT comment_id, comment_body AS text FROM comments WHERE comment_body NOT IN {NO_TEXT}
""")
def _(t):
    return enrichment.comment_text(t.comments)


@query("answered_posts", "analysis_documents", """
SELECT * FROM (
  SELECT json_extract_string(analysis_document, '$.post_id') AS post_id,
    json_extract_string(analysis_document, '$.analysis') AS analysis
  FROM analysis_documents)
WHERE post_id IS NOT NULL
  AND NOT contains(analysis, 'therefore I cannot answer this question.')
""")
def _(t):
    return service.answered_posts(t.analysis_documents)


_TREE_SQL = """
edges AS (
  SELECT c.post_id, split_part(c.parent_id, '_', 2) AS parent, c.comment_id AS child,
    row_number() OVER (PARTITION BY c.post_id ORDER BY c.comment_created_utc, c.comment_id) AS n
  FROM comments c JOIN comments p
    ON p.post_id = c.post_id AND p.comment_id = split_part(c.parent_id, '_', 2)),
lists AS (
  SELECT post_id, parent, min(n) AS first, string_agg('"' || child || '"', ',' ORDER BY n) AS kids
  FROM edges GROUP BY post_id, parent),
objects AS (
  SELECT post_id, string_agg('"' || parent || '":[' || kids || ']', ',' ORDER BY first) AS body
  FROM lists GROUP BY post_id),
trees AS (
  SELECT p.post_id, '{' || coalesce(o.body, '') || '}' AS parent_child_tree
  FROM (SELECT DISTINCT post_id FROM comments) p LEFT JOIN objects o ON o.post_id = p.post_id)
"""


@query("comment_tree", "comments", f"""WITH {_TREE_SQL.strip()}
SELECT post_id, 0 AS piece, parent_child_tree, sha256(parent_child_tree) AS shasum256 FROM trees
""")
def _(t):
    return trees.comment_trees(t.comments)


@query("comment_tree_rows", "comments", f"""WITH {_TREE_SQL.strip()}
SELECT '1704067200' AS timestamp, sha256(parent_child_tree) AS shasum256,
  min(post_id) AS post_id, parent_child_tree
FROM trees WHERE parent_child_tree NOT IN (SELECT parent_child_tree FROM trees WHERE post_id LIKE '%3')
GROUP BY parent_child_tree
""")
def _(t):
    """The trees of some posts are stored already."""
    rows = trees.tree_rows(trees.comment_trees(t.comments),
                           F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return dml.rows_to_insert(
        rows.where("post_id LIKE '%3'"), rows, UNIQUE_KEYS["parent_child_tree_data"], ["post_id"]
    )


# --- tables, DML, registry ---------------------------------------------------

@query("parameterised_select", "", """
SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total
FROM events WHERE value > 10 AND event_type <> 'error' GROUP BY user_id, event_type
""")
def _(t):
    return tables.select_rows(
        t.spark,
        f"SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total "
        f"FROM parquet.`{t.path('events')}` WHERE value > :least AND event_type <> :skipped "
        "GROUP BY user_id, event_type",
        {"least": 10, "skipped": "error"},
    )


@query("rows_as_documents", "", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
""")
def _(t):
    names = ("c_custkey", "c_name", "c_mktsegment")
    return docs.fields(tables.as_documents(t.customer), "row_json", *names).select(*names)


def _insert_batch(t: TestTables) -> DataFrame:
    """New posts, half of them known, some of them twice."""
    return t.documents.selectExpr(
        "concat('p', doc_id * 2) AS post_id", "source AS subreddit", "doc_id AS feed_no",
        "text AS post_body",
    ).unionByName(t.customer.selectExpr(
        "concat('p', c_custkey) AS post_id", "c_mktsegment AS subreddit",
        "c_custkey AS feed_no", "c_name AS post_body",
    ))


@query("insert_ignore", "posts", """
WITH batch AS (
  SELECT concat('p', doc_id * 2) AS post_id, source AS subreddit, doc_id AS feed_no,
    text AS post_body FROM documents
  UNION ALL
  SELECT concat('p', c_custkey), c_mktsegment, c_custkey, c_name FROM customer)
SELECT post_id, subreddit, post_body FROM posts
UNION ALL
SELECT post_id, subreddit, post_body FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY feed_no, md5(post_body)) AS n
  FROM batch)
WHERE n = 1 AND post_id NOT IN (SELECT post_id FROM posts)
""")
def _(t):
    batch = _insert_batch(t)
    target = t.posts.select("post_id", "subreddit", "post_body")
    new = dml.rows_to_insert(
        target, batch, UNIQUE_KEYS["posts"], ["feed_no", F.md5("post_body")]
    )
    return target.unionByName(new.drop("feed_no"))


@query("insert_by_batches", "posts", """
WITH batch AS (
  SELECT concat('p', doc_id * 2) AS post_id, source AS subreddit, doc_id AS feed_no,
    text AS post_body FROM documents
  UNION ALL
  SELECT concat('p', c_custkey), c_mktsegment, c_custkey, c_name FROM customer)
SELECT post_id, subreddit, post_body FROM posts
UNION ALL
SELECT post_id, subreddit, post_body FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY feed_no % 3, feed_no, md5(post_body)) AS n
  FROM batch)
WHERE n = 1 AND post_id NOT IN (SELECT post_id FROM posts)
""")
def _(t):
    """Four batches into a table that is stored by key."""
    path = fresh_path(t.spark, "keyed")
    columns = ["post_id", "subreddit", "post_body"]
    order = ["feed_no", F.md5("post_body")]
    first = t.posts.select(*columns, F.lit(0).cast("bigint").alias("feed_no"))
    batch = _insert_batch(t).select(*columns, "feed_no")
    for own in (first, *(batch.where(F.col("feed_no") % 3 == n) for n in range(3))):
        dml.append_ignore(t.spark, path, own, UNIQUE_KEYS["posts"], order)
    return t.spark.read.parquet(path).select(*columns)


@query("insert_without_key", "subscription", """
SELECT * FROM subscription
UNION ALL SELECT '1704067200', source FROM documents
""")
def _(t):
    batch = t.documents.selectExpr("'1704067200' AS datetimesubscribed", "source AS subreddit")
    return dml.insert_ignore(t.subscription, batch, UNIQUE_KEYS["subscription"], [])


@query("update_by_key", "posts", """
SELECT p.post_id, coalesce(u.v, p.post_upvote_count) AS post_upvote_count
FROM posts p LEFT JOIN (
  SELECT concat('p', o_custkey) AS post_id, CAST(arg_max(o_orderkey, o_orderkey) AS INT) AS v
  FROM orders GROUP BY 1) u ON u.post_id = p.post_id
""")
def _(t):
    updates = t.orders.selectExpr(
        "concat('p', o_custkey) AS post_id", "o_orderkey AS post_upvote_count", "o_orderkey"
    )
    return dml.update_by_key(
        t.posts.select("post_id", "post_upvote_count"), updates, "post_id",
        "post_upvote_count", ["o_orderkey"],
    )


@query("purge_automod", "posts comments", """
SELECT 'post' AS kind, post_id AS id, post_author AS author FROM posts
WHERE post_author IS NULL OR post_author <> 'AutoModerator'
UNION ALL
SELECT 'comment', comment_id, comment_author FROM comments
WHERE comment_author IS NULL OR comment_author <> 'AutoModerator'
""")
def _(t):
    posts = dml.purge_bot(t.posts, "post_author")
    comments = dml.purge_bot(t.comments, "comment_author")
    return posts.selectExpr("'post' AS kind", "post_id AS id", "post_author AS author").union(
        comments.selectExpr("'comment'", "comment_id", "comment_author")
    )


# The exported tables and what stands for those that the test tables lack.
EXPORTED = {
    "posts": "posts", "comments": "comments", "authors": "authors", "subscription": "subscription",
    "analysis_documents": "analysis_documents",
    "prompt_completion_details": "prompt_completion_details",
    "parent_child_tree_data": "conversations", "program_logs": "service_log_lines",
    "servicelogs": "customer", "row_count_history": "labels", "websearch_results_ts": "pages",
    "errors": "nation",
}
# The columns of each that are neither floating nor nested nor a moment.
_EXACT = {
    "posts": "post_id, subreddit, post_author, post_title, post_body, post_created_utc, is_post_oc, "
             "is_post_video, post_upvote_count, post_downvote_count, subreddit_members",
    "comments": "comment_id, parent_id, comment_author, is_comment_submitter, is_comment_edited, "
                "comment_created_utc, comment_body, post_id, subreddit, comment_upvote_count, "
                "comment_downvote_count",
    "authors": "author_id, author_name, author_created_utc",
    "subscription": "datetimesubscribed, subreddit",
    "analysis_documents": "id, shasum_512, analysis_document",
    "prompt_completion_details": "id, model, ollama_ver, prompt_completion_time",
    "conversations": "conv_id, turn, role, text", "service_log_lines": "line_no, line",
    "customer": "c_custkey, c_name, c_nationkey, c_mktsegment", "labels": "doc_id, quality, toxic",
    "pages": "page_id, url, html", "nation": "n_nationkey, n_name, n_regionkey",
}


def _exact_text(columns: str) -> str:
    texts = [f"coalesce(CAST({c.strip()} AS VARCHAR), '')" for c in columns.split(",")]
    return f"concat_ws('|', {', '.join(texts)})"


@query("export_snapshot", _COUNTED_VIEWS + " service_log_lines", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows_n, CAST(coalesce(sum(CAST('0x' || "
    f"substr(md5({_exact_text(_EXACT[source])}), 1, 8) AS BIGINT)), 0) AS BIGINT) AS checksum FROM {source}"
    for name, source in EXPORTED.items()))
def _(t):
    stored = {name: getattr(t, source) for name, source in EXPORTED.items()}
    folder = dml.export_snapshot(stored, fresh_path(t.spark, "export"), 1704067200)
    return dml.manifest(t.spark, folder)


@query("claim_keys", "registry_claims", """
WITH RECURSIVE ordered AS (
  SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n
  FROM registry_claims),
walk AS (
  SELECT key, ts, event_id, n, ts AS last, true AS won FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.key, o.ts, o.event_id, o.n,
    CASE WHEN o.ts >= w.last + INTERVAL 5 DAY THEN o.ts ELSE w.last END,
    o.ts >= w.last + INTERVAL 5 DAY
  FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)
SELECT key, ts AS claimed_at, event_id FROM walk WHERE won
""")
def _(t):
    return registry.claim_keys(t.registry_claims, "key", "ts", "event_id", None, FIVE_DAYS)


@query("migrate_keys", "registry_claims", """
SELECT DISTINCT concat('post_id_', c_custkey) AS key FROM customer
WHERE concat('post_id_', c_custkey) NOT IN (SELECT key FROM registry_claims)
""")
def _(t):
    return registry.migrate(t.customer, "c_custkey", "post_id", t.registry_claims)


@query("strip_keys", "registry_claims", """
SELECT DISTINCT replace(key, 'post_id_', '') AS id FROM registry_claims WHERE key LIKE 'post_id%'
""")
def _(t):
    return registry.keys_of(t.registry_claims, "post_id").distinct()


@query("live_keys", "registry_claims", """
SELECT key, claimed_at FROM (SELECT key, max(ts) AS claimed_at FROM registry_claims GROUP BY key)
WHERE claimed_at > TIMESTAMP '2024-02-03 22:00:00' - INTERVAL 5 DAY
""")
def _(t):
    held = t.registry_claims.groupBy("key").agg(F.max("ts").alias("claimed_at"))
    return registry.live(held, F.lit("2024-02-03 22:00:00").cast("timestamp_ntz"), FIVE_DAYS)


@query("quota_flags", "registry_claims", """
SELECT event_id, key,
  row_number() OVER (PARTITION BY key ORDER BY ts, event_id) % 11 <> 0 AS allowed
FROM registry_claims
""")
def _(t):
    flags = numbering.quota_flags(t.registry_claims, "key", ["ts", "event_id"])
    return flags.select("event_id", "key", "allowed")


@query("quota_counters", "registry_claims", """
SELECT key, count(*) % 11 AS value FROM registry_claims GROUP BY key
""")
def _(t):
    return numbering.quota_counters(t.registry_claims, "key")


@query("batch_numbers", "posts", """
SELECT subreddit, post_id,
  CAST(floor((row_number() OVER (PARTITION BY subreddit ORDER BY post_id) - 1) / 25) AS BIGINT)
    AS batch_no
FROM posts
""")
def _(t):
    return numbering.batch_numbers(t.posts.select("subreddit", "post_id"), "subreddit", "post_id")


# --- sources -----------------------------------------------------------------

def post_records(t: TestTables) -> DataFrame:
    """The posts as JSON records of the feed."""
    return t.posts.select(docs.to_document(
        F.col("post_id").alias("id"), F.col("post_title").alias("title"),
        F.col("post_body").alias("selftext"),
        (F.col("post_created_utc") + F.lit(0.75)).alias("created_utc"),
        F.col("is_post_oc").alias("is_original_content"), F.col("is_post_video").alias("is_video"),
        F.col("post_upvote_count").alias("ups"), F.col("post_downvote_count").alias("downs"),
        F.col("subreddit_members").alias("subreddit_subscribers"),
        F.struct(F.col("subreddit").alias("display_name")).alias("subreddit"),
        F.when(F.col("post_author").isNotNull(), F.struct(F.col("post_author").alias("name")))
        .alias("author"),
    ).alias("value"))


@query("post_feed_ingest", "posts", "SELECT * FROM posts")
def _(t):
    return feeds.post_rows(feeds.parse_records(post_records(t), "posts"))


@query("feed_rejects", "posts", """
SELECT 'posts' AS item_type, CASE lang WHEN 'fr' THEN 'malformed record: {' || text
  ELSE 'record without id: {"title":"' || source || '"}' END AS error
FROM documents WHERE lang IN ('fr', 'de')
""")
def _(t):
    line = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("{"), F.col("text")))
        .when(F.col("lang") == "de", docs.to_document(F.col("source").alias("title")))
        .otherwise(docs.to_document(F.col("doc_id").cast("string").alias("id")))
    )
    lines = t.documents.select(line.alias("value"))
    bad = feeds.rejected_records(lines, "posts", F.lit("2024-01-01").cast("timestamp"))
    return bad.select("item_type", "error")


@query("comment_feed_ingest", "comments", "SELECT * FROM comments")
def _(t):
    records = t.comments.select(docs.to_document(
        F.col("comment_id").alias("id"), F.col("parent_id"), F.col("comment_body").alias("body"),
        (F.col("comment_created_utc") + F.lit(0.25)).alias("created_utc"),
        F.when(F.col("is_comment_edited") == "false", "false")
        .otherwise(F.concat("is_comment_edited", F.lit(".0"))).alias("edited"),
        F.col("is_comment_submitter").alias("is_submitter"),
        F.col("comment_upvote_count").alias("ups"), F.col("comment_downvote_count").alias("downs"),
        F.struct(F.col("post_id").alias("id")).alias("submission"),
        F.struct(F.col("subreddit").alias("display_name")).alias("subreddit"),
        F.when(F.col("comment_author").isNotNull(), F.struct(F.col("comment_author").alias("name")))
        .alias("author"),
    ).alias("value"))
    return feeds.comment_rows(feeds.parse_records(records, "comments"), "parent_id")


@query("author_feed_ingest", "authors", "SELECT * FROM authors")
def _(t):
    records = t.authors.select(docs.to_document(
        F.col("author_id").alias("id"), F.col("author_name").alias("name"),
        F.col("author_created_utc").cast("double").alias("created_utc"),
    ).alias("value"))
    return feeds.author_rows(feeds.parse_records(records, "authors"))


@query("service_log_ingest", "service_log_lines", """
SELECT ts AS timestamp, json_extract_string(line, '$.host_name') AS host_name,
  'model-server' AS service_name, json_extract_string(line, '$.severity') AS severity,
  json_extract_string(line, '$.message.k') AS k
FROM service_log_lines WHERE json_valid(line)
""")
def _(t):
    rows = logs.service_log_rows(
        t.service_log_lines, docs.field("line", "host_name"), "model-server"
    )
    parsed = rows.select(
        "timestamp", "host_name", "service_name",
        F.json_tuple("message", "severity", "message").alias("severity", "inner"),
    )
    return parsed.withColumn("k", docs.field("inner", "k")).drop("inner")


@query("service_log_rejects", "service_log_lines", """
SELECT CAST(line_no AS VARCHAR) AS item_id, 'service_log' AS item_type,
  'malformed line: ' || line AS error, ts AS created_at
FROM service_log_lines WHERE NOT json_valid(line)
""")
def _(t):
    return logs.rejected_lines(t.service_log_lines, "line_no", F.col("ts"))


@query("service_log_split", "service_log_lines", """
SELECT ts AS at, 'row' AS kind, line AS text FROM service_log_lines WHERE json_valid(line)
UNION ALL
SELECT ts, CAST(line_no AS VARCHAR), 'malformed line: ' || line FROM service_log_lines
WHERE NOT json_valid(line)
""")
def _(t):
    found = logs.sorted_lines(t.service_log_lines, F.lit("h"), "model-server", "line_no", F.col("ts"))
    folder = fresh_path(t.spark, "lines")
    logs.store_lines(found, folder)
    rows, rejects = (logs.stored_lines(t.spark, folder, found.schema, bad) for bad in (False, True))
    return rows.selectExpr("timestamp AS at", "'row' AS kind", "message AS text").union(
        rejects.select("created_at", "item_id", "error"))


@query("service_log_recent", "service_log_lines", """
SELECT line_no, ts, line FROM service_log_lines
WHERE ts >= (SELECT max(ts) FROM service_log_lines) - INTERVAL 10 MINUTE
""")
def _(t):
    lines = t.service_log_lines
    newest = lines.agg(F.max("ts").alias("t")).scalar()
    return logs.recent_lines(lines, newest)


@query("log_rows", "", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' AS timestamp, concat('h', user_id) AS host,
  'collector' AS program_name, '0.4.4' AS program_version, upper(event_type) AS severity,
  props AS message
FROM events
""")
def _(t):
    rows = logs.program_log_rows(
        t.events, F.concat(F.lit("h"), F.col("user_id")), F.lit("collector"), F.lit("0.4.4"),
        F.upper("event_type"), "props", "ts",
    )
    names = ("timestamp", "host", "program_name", "program_version", "severity", "message")
    return docs.fields(rows.select("log_json"), "log_json", *names).select(*names)


_LINK = 'href="([^"]*)"'


@query("websearch_ingest", "", f"""
SELECT 'duckduckgo' AS source, concat('p', page_id) AS post_id, url AS lookup_text,
  CAST(generate_subscripts(links, 1) AS INT) AS result_no,
  '{{"href":"' || unnest(links) || '","more":{{"bytes":' || CAST(length(html) AS VARCHAR)
    || ',"tags":["a",null,true]}},"rank":' || CAST(page_id AS VARCHAR) || '}}' AS websearch_result
FROM (SELECT page_id, url, html, regexp_extract_all(html, '{_LINK}', 1) AS links FROM pages)
""")
def _(t):
    more = F.struct(F.length("html").alias("bytes"), F.parse_json(F.lit('["a",null,true]')).alias("tags"))
    lookups = t.pages.select(docs.to_document(
        F.lit("duckduckgo").alias("source"),
        F.concat(F.lit("p"), F.col("page_id")).alias("post_id"), F.col("url").alias("lookup_text"),
        F.transform(
            F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)),
            lambda h: F.struct(F.col("page_id").alias("rank"), h.alias("href"), more.alias("more")),
        ).alias("results"),
    ).alias("value"))
    records = feeds.parse_records(lookups, "websearch")
    rows = feeds.websearch_rows(records, F.lit("2024-01-01").cast("timestamp"))
    return rows.select("source", "post_id", "lookup_text", "result_no", "websearch_result")


@query("model_ingest", "", """
SELECT concat(p_brand, ':', p_partkey) AS name, p_brand AS model, p_partkey * 1000 AS size,
  md5(p_name) AS digest, '{"families":["' || p_brand || '","x"],"family":"' || p_brand
    || '","more":{"deep":{"n":' || CAST(p_size AS VARCHAR) || '}},"parameter_size":"7B","quant":null}' AS details,
  p_partkey * 10 AS size_vram
FROM part
""")
def _(t):
    records = t.part.select(docs.to_document(
        F.concat("p_brand", F.lit(":"), "p_partkey").alias("name"), F.col("p_brand").alias("model"),
        (F.col("p_partkey") * 1000).alias("size"), F.md5("p_name").alias("digest"),
        F.struct(
            F.lit("7B").alias("parameter_size"), F.lit(None).cast("string").alias("quant"),
            F.col("p_brand").alias("family"), F.array("p_brand", F.lit("x")).alias("families"),
            F.struct(F.struct(F.col("p_size").alias("n")).alias("deep")).alias("more"),
        ).alias("details"),
        F.lit("2024-01-01T00:00:00Z").alias("expires_at"), (F.col("p_partkey") * 10).alias("size_vram"),
    ).alias("value"))
    return feeds.model_rows(feeds.parse_records(records, "models")).drop("expires_at")


@query("price_list", "", """
SELECT 'embeddings' AS kind, concat('e', p_partkey) AS model, NULL AS quality, NULL AS size,
  p_retailprice AS price, p_partkey FROM part
UNION ALL SELECT 'images', p_brand, p_type, CAST(p_size AS VARCHAR), p_retailprice, p_partkey
  FROM part
UNION ALL SELECT 'audio', p_name, NULL, NULL, p_retailprice / 2, p_partkey FROM part
UNION ALL SELECT 'chat', p_brand, NULL, 'prompt', p_retailprice, p_partkey FROM part
UNION ALL SELECT 'chat', p_brand, NULL, 'completion', p_retailprice * 2, p_partkey FROM part
""")
def _(t):
    price = F.col("p_retailprice")
    lists = t.part.select("p_partkey", docs.to_document(
        F.create_map(F.concat(F.lit("e"), F.col("p_partkey")), price).alias("embeddings"),
        F.create_map("p_brand", F.create_map(
            "p_type", F.create_map(F.col("p_size").cast("string"), price))).alias("images"),
        F.create_map("p_name", price / 2).alias("audio"),
        F.create_map("p_brand", F.struct(
            price.alias("promptPrice"), (price * 2).alias("completionPrice"))).alias("chat"),
    ).alias("value"))
    return feeds.price_rows(lists, "value", "p_partkey")


PRICES = (
    '{"embeddings": {"embed": 0.0002}, "audio": {"speech": 0.015}, '
    '"images": {"picture": {"standard": {"512x512": 0.018}}}, '
    '"chat": {"view": {"promptPrice": 0.1, "completionPrice": 0.2}, '
    '"click": {"promptPrice": 0.3, "completionPrice": 0.4}, '
    '"signup": {"promptPrice": 0.5, "completionPrice": 0.6}, '
    '"purchase": {"promptPrice": 0.7, "completionPrice": 0.8}}}'
)


@query("token_cost", "prompt_completion_details", """
SELECT d.id, d.model, round(d.prompt_completion_time / 1000.0 * p.price, 9) AS cost
FROM prompt_completion_details d
LEFT JOIN (VALUES ('view', 0.2), ('click', 0.4), ('signup', 0.6), ('purchase', 0.8))
  AS p(model, price) ON p.model = d.model
""")
def _(t):
    prices = feeds.price_rows(t.spark.createDataFrame([(PRICES,)], "value string"))
    usage = t.prompt_completion_details
    return rounded(
        joins.with_price(usage, "model", prices, F.col("prompt_completion_time"))
        .select("id", "model", "cost"), "cost", digits=9,
    )


# --- enrichment --------------------------------------------------------------

@query("comment_routes", "comments", """
SELECT comment_id, CASE WHEN comment_body IN ('[removed]', '[deleted]') THEN 'comment'
  WHEN comment_author IS NOT NULL AND comment_author <> 'AutoModerator' THEN 'comment_and_post'
  ELSE 'none' END AS route
FROM comments
""")
def _(t):
    route = predicates.comment_route("comment_body", "comment_author")
    return t.comments.select("comment_id", route.alias("route"))


@query("request_routes", _DOC_VIEWS, f"""WITH {_UNANALYZED.strip()}
SELECT concat('p', c_custkey) AS id,
  CASE WHEN concat('p', c_custkey) IN (SELECT post_id FROM unanalyzed_posts) THEN 'skip'
  ELSE 'fetch' END AS route
FROM customer
""")
def _(t):
    requests = t.customer.selectExpr("concat('p', c_custkey) AS id")
    listed = enrichment.unanalyzed_posts(t.posts, t.analysis_documents)
    return enrichment.request_routes(requests, "id", listed, "post_id")


def _marks(t: TestTables) -> DataFrame:
    return t.supplier.selectExpr("concat('author_id_a', s_suppkey * 3) AS key")


_MARKS = "marks AS (SELECT concat('author_id_a', s_suppkey * 3) AS key FROM supplier)"


@query("new_authors", "posts comments authors", f"""
WITH {_MARKS}
SELECT author_name FROM (
  SELECT post_author AS author_name FROM posts UNION SELECT comment_author FROM comments)
WHERE author_name IS NOT NULL AND author_name <> 'AutoModerator'
  AND author_name NOT IN (SELECT author_name FROM authors)
  AND concat('author_id_', author_name) NOT IN (SELECT key FROM marks)
""")
def _(t):
    return enrichment.new_authors(t.posts, t.comments, t.authors, _marks(t))


@query("authors_to_refresh", "authors", f"""
WITH {_MARKS}
SELECT DISTINCT author_name FROM authors
WHERE concat('author_id_', author_name) NOT IN (SELECT key FROM marks)
""")
def _(t):
    return enrichment.authors_to_refresh(t.authors, _marks(t))


@query("detect_language", "", r"""
WITH tokens AS (
  SELECT doc_id, lang,
    unnest(string_split(trim(regexp_replace(lower(text), '\P{L}+', ' ', 'g')), ' ')) AS w
  FROM documents),
chars AS (SELECT doc_id, lang, string_split(' ' || w || ' ', '') AS c FROM tokens WHERE w <> ''),
grams AS (
  SELECT doc_id, lang,
    unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
  FROM chars),
counts AS (SELECT lang, gram, count(*) AS c FROM grams GROUP BY lang, gram),
sizes AS (SELECT lang, sum(c) AS n, (SELECT count(DISTINCT gram) FROM counts) AS v
          FROM counts GROUP BY lang),
profile AS (
  SELECT g.gram, s.lang AS l,
    CAST(round(ln((coalesce(c.c, 0) + 1)::DOUBLE / (s.n + s.v)::DOUBLE) * 1000000) AS BIGINT) AS lp
  FROM (SELECT DISTINCT gram FROM counts) g JOIN sizes s ON true
  LEFT JOIN counts c ON c.gram = g.gram AND c.lang = s.lang),
scores AS (
  SELECT g.doc_id, p.l, sum(p.lp * g.n) AS s
  FROM (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY doc_id, gram) g
  JOIN profile p ON p.gram = g.gram GROUP BY g.doc_id, p.l),
best AS (
  SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, l) AS r FROM scores)
SELECT d.doc_id, b.l AS detected FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1
""")
def _(t):
    documents = spread(t.documents)
    profiles = language.train_profiles(documents, "text", "lang")
    return language.detect_language(documents, "doc_id", "text", profiles)


_HELD_OUT_SQL = ORACLE["detect_language"].replace(
    "FROM grams GROUP BY lang, gram", "FROM grams WHERE doc_id % 2 = 0 GROUP BY lang, gram").replace(
    "FROM grams GROUP BY doc_id, gram", "FROM grams WHERE doc_id % 2 = 1 GROUP BY doc_id, gram").replace(
    "SELECT d.doc_id, b.l AS detected FROM documents d", "SELECT d.lang, b.l AS detected, count(*) AS n FROM documents d")


@query("detect_held_out", "", _HELD_OUT_SQL + " WHERE d.doc_id % 2 = 1 GROUP BY ALL")
def _(t):
    """Learned from one half of the documents and stored; how the other half comes out."""
    folder = fresh_path(t.spark, "profiles")
    even = F.col("doc_id") % 2 == 0
    language.save_profiles(language.train_profiles(t.documents.where(even), "text", "lang"), folder)
    rows = t.documents.where(~even)
    found = language.detect_language(rows, "doc_id", "text", language.load_profiles(t.spark, folder))
    return found.join(rows.select("doc_id", "lang"), "doc_id").groupBy("lang", "detected").agg(
        F.count(F.lit(1)).alias("n"))


@query("language_gate", "posts", f"""
SELECT p.post_id, p.post_title || p.post_body AS text FROM posts p
LEFT JOIN documents d ON concat('p', d.doc_id) = p.post_id
WHERE p.post_body NOT IN {NO_TEXT} AND (d.lang = 'en' OR d.lang IS NULL)
""")
def _(t):
    langs = t.documents.selectExpr("concat('p', doc_id) AS post_id", "lang")
    return enrichment.language_gate(enrichment.post_text(t.posts), langs, "post_id", "lang")


@query("prompt_table", "posts comments", f"""
WITH items AS (
  SELECT post_id AS reference_id, 'post' AS category,
    'respond to this post title and post body: ' || post_title || post_body AS prompt
  FROM posts WHERE post_body NOT IN {NO_TEXT}
  UNION ALL
  SELECT comment_id, 'comment', 'respond to this comment: ' || comment_body
  FROM comments WHERE comment_body NOT IN {NO_TEXT})
SELECT reference_id, category, unnest(['phi4', 'gemma2', 'llama3']) AS llm,
  CAST(unnest([0, 1, 2]) AS INT) AS llm_pos, prompt
FROM items
""")
def _(t):
    posts = enrichment.prompt_table(enrichment.post_text(t.posts), "post_id", "post", LLMS)
    comments = enrichment.prompt_table(
        enrichment.comment_text(t.comments), "comment_id", "comment", LLMS
    )
    return posts.unionByName(comments)


def answer_records(t: TestTables) -> DataFrame:
    """Answers of three models to every user turn and every readable post."""
    comments = joins.each_of(t.responses, LLMS, "llm", "llm_pos").select(
        "reference_id", F.lit("comment").alias("category"), "llm", "llm_pos",
        F.when(F.col("llm_pos") < 2, F.col("content"))
        .otherwise(F.concat(F.lit(text.BOILERPLATE[0]), "content")).alias("content"),
        "eval_count", "eval_duration",
    )
    posts = joins.each_of(enrichment.post_text(t.posts), LLMS, "llm", "llm_pos").select(
        F.col("post_id").alias("reference_id"), F.lit("post").alias("category"), "llm", "llm_pos",
        F.concat("llm", F.lit(" on "), "text").alias("content"),
        F.length("text").cast("bigint").alias("eval_count"),
        F.lit(2_000_000_000).cast("bigint").alias("eval_duration"),
    )
    return comments.unionByName(posts).select(
        "reference_id", "category", "llm", "llm_pos",
        F.struct("content").alias("message"), "eval_count", "eval_duration",
        F.lit(1704067200.25).alias("start_time"),
        (F.lit(1704067200.75) + F.col("llm_pos")).alias("end_time"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("0.4.0").alias("ollama_ver"),
    )


_ANSWERS = f"""
answers AS (
  SELECT reference_id, 'comment' AS category, l.llm, l.pos,
    CASE WHEN l.pos < 2 THEN content ELSE 'FWIW - ' || content END AS analysis,
    eval_count, eval_duration
  FROM responses JOIN llms l ON true
  UNION ALL
  SELECT post_id, 'post', 'llama3', 2, 'llama3 on ' || post_title || post_body,
    length(post_title || post_body), 2000000000
  FROM posts WHERE post_body NOT IN {NO_TEXT})
"""


@query("stored_answers", "posts responses llms", f"""WITH {_ANSWERS.strip()}
SELECT reference_id, category, llm, analysis, CAST(pos AS INT) AS prompt_completion_time,
  round(eval_count::DOUBLE / eval_duration::DOUBLE * 1000000000, 6) AS tokens_per_second
FROM answers
""")
def _(t):
    stored = enrichment.finish_answers(enrichment.stored_answers(answer_records(t)))
    return rounded(stored.select(
        "reference_id", "category", "llm", "analysis", "prompt_completion_time",
        "tokens_per_second",
    ), "tokens_per_second")


@query("analysis_docs_ingest", "posts responses llms", f"""WITH {_ANSWERS.strip()}
SELECT '4' AS schema_version, 'reddit' AS source, category, reference_id, llm, analysis
FROM (SELECT *, row_number() OVER (PARTITION BY analysis ORDER BY reference_id, pos) AS n
      FROM answers)
WHERE n = 1 AND analysis NOT IN (SELECT analysis FROM answers WHERE reference_id LIKE '%1')
""")
def _(t):
    """The answers to some items are stored already, under their hashes."""
    stored = enrichment.finish_answers(enrichment.stored_answers(answer_records(t)))
    held = t.analysis_documents.select("shasum_512").union(
        stored.where("reference_id LIKE '%1'").select("shasum_512"))
    new = dml.rows_to_insert(
        held, stored, UNIQUE_KEYS["analysis_documents"],
        ["timestamp", "reference_id", "llm_pos"],
    )
    names = ("schema_version", "source", "category", "reference_id", "llm", "analysis")
    stored_docs = enrichment.document_rows(new).select("analysis_document")
    return docs.fields(stored_docs, "analysis_document", *names).select(*names)


@query("perf_rows", "models prompt_completion_details", """
SELECT md5(concat('e', d.id)) AS doc_shasum_512, '' AS ollama_host, d.ollama_ver, m.name,
  m.name AS model, m.size, md5(concat('e', d.id)) AS digest, '{"family":"f"}' AS details,
  m.size_vram, d.prompt_completion_time, round(d.tokens_per_second, 6) AS tokens_per_second
FROM prompt_completion_details d JOIN models m ON m.name = d.model || ':latest'
""")
def _(t):
    inventory = t.models.select(
        "name", F.col("name").alias("model"), "size", "size_vram",
        F.struct(F.lit("f").alias("family")).alias("details"),
        F.lit("2024-01-01").cast("timestamp").alias("expires_at"),
    )
    answers = t.prompt_completion_details.select(
        F.md5(F.concat(F.lit("e"), F.col("id"))).alias("shasum_512"), F.col("model").alias("llm"),
        "ollama_ver", "prompt_completion_time", "tokens_per_second",
    )
    rows = enrichment.performance_rows(answers, inventory, F.lit("2024-01-01").cast("timestamp"))
    return rounded(rows.drop("expires_at", "created_at"), "tokens_per_second")


@query("run_inference", "comments", f"""
SELECT comment_id AS reference_id, unnest(['phi4', 'gemma2', 'llama3']) AS llm,
  length('respond to this comment: ' || comment_body) AS answer
FROM comments WHERE comment_body NOT IN {NO_TEXT}
""")
def _(t):
    def prompt_length(batches):
        """Stands in for a model client: answers with the length of the prompt."""
        for frame in batches:
            yield frame.assign(answer=frame["prompt"].str.len().astype("int64"))[
                ["reference_id", "llm", "answer"]
            ]

    prompts = enrichment.prompt_table(
        enrichment.comment_text(t.comments), "comment_id", "comment", LLMS
    )
    return enrichment.run_inference(
        prompts, prompt_length, "reference_id string, llm string, answer bigint"
    )


# --- scalar functions --------------------------------------------------------

@query("format_width", "", """
SELECT doc_id, array_to_string(list_transform(range(1, ((length(text) + 79) // 80) + 1),
  lambda i: CASE WHEN i = 1 THEN substring(coalesce(lines[i], ''), 1, 80)
    ELSE chr(10) || repeat(' ', 80 - length(substring(coalesce(lines[i], ''), 1, 80)))
      || substring(coalesce(lines[i], ''), 1, 80) END), '') AS formatted
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
""")
def _(t):
    return spread(t.documents).select("doc_id", text.format_width("text").alias("formatted"))


_PHRASED = " ".join(
    f"WHEN {i} THEN {_quote(p)}" for i, p in enumerate(text.BOILERPLATE)
)
_SANITIZED = "raw"
for _phrase in text.BOILERPLATE:
    _SANITIZED = f"replace({_SANITIZED}, {_quote(_phrase)}, 'FWIW - ')"


@query("sanitize", "", f"""
SELECT doc_id, {_SANITIZED} AS clean
FROM (SELECT doc_id, concat(CASE doc_id % 7 {_PHRASED} ELSE '' END, text) AS raw FROM documents)
""")
def _(t):
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in text.BOILERPLATE], F.lit("")),
        (F.col("doc_id") % 7 + 1).cast("int"),
    )
    raw = spread(t.documents).select("doc_id", F.concat(phrase, "text").alias("raw"))
    return raw.select("doc_id", text.sanitize("raw").alias("clean"))


@query("word_punct", "", rf"""
SELECT doc_id, len(regexp_extract_all(text, '[^\t\n\x0b\f\r \x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')) AS words,
  length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')) AS marks
FROM documents
""")
def _(t):
    return spread(t.documents).select(
        "doc_id", text.word_count("text").cast("bigint").alias("words"),
        text.punctuation_count("text").cast("bigint").alias("marks"),
    )


_VERSION = (
    "concat(p_size % 3, '.', p_partkey % 12, '.', p_size, "
    "CASE WHEN p_partkey % 4 = 0 THEN concat('-rc.', p_partkey % 15) "
    "WHEN p_partkey % 4 = 1 THEN '-beta' ELSE '' END)"
)


@query("semver_sort", "", f"""
SELECT version, major, row_number() OVER (PARTITION BY major ORDER BY
  CAST(split_part(core, '.', 2) AS INT), CAST(split_part(core, '.', 3) AS INT),
  pre = '', split_part(pre, '.', 1), TRY_CAST(split_part(pre, '.', 2) AS INT)) AS place
FROM (SELECT version, split_part(version, '-', 1) AS core, split_part(version, '-', 2) AS pre,
        CAST(split_part(version, '.', 1) AS INT) AS major
      FROM (SELECT DISTINCT {_VERSION} AS version FROM part))
""")
def _(t):
    found = t.part.select(F.expr(_VERSION).alias("version")).distinct().withColumn(
        "major", F.split_part("version", F.lit("."), F.lit(1)).cast("int")
    )
    return numbering.running_number(
        found, "major", versions.version_key("version"), "place"
    )


@query("semver_valid", "", f"""
SELECT p_partkey, version, regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+') AS plain
FROM (SELECT p_partkey, {_VERSION} AS version FROM part)
""")
def _(t):
    return t.part.select("p_partkey", F.expr(_VERSION).alias("version")).withColumn(
        "plain", versions.is_plain_version("version")
    )


@query("hash_functions", "", """
SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, left(text, 255) AS index_prefix,
  substring(md5(CAST(doc_id AS VARCHAR) || '0'), 1, 10) AS internal_id
FROM documents
""")
def _(t):
    return t.documents.select(
        "doc_id", F.md5("text").alias("md5"), docs.sha256_hex("text").alias("sha256"),
        text.index_prefix("text").alias("index_prefix"),
        text.internal_id("doc_id").alias("internal_id"),
    )


@query("time_functions", "", """
SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('day', ts) = CAST(CAST(ts AS DATE) AS TIMESTAMP)
    AS starts_day,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' AS iso,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso_json,
  CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
  CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS epoch_text,
  CAST(trunc(value) AS INT) AS seconds
FROM events
""")
def _(t):
    return t.events.select(
        "event_id", times.day_of("ts").alias("day"),
        (times.day_start("ts") == times.day_of("ts").cast("timestamp")).alias("starts_day"),
        times.iso_text("ts").alias("iso"),
        F.regexp_replace(times.iso_json("ts"), r"(:\d\d)\+", "$1.000000+").alias("iso_json"),
        times.epoch_seconds("ts").alias("epoch"),
        times.epoch_text("ts").alias("epoch_text"),
        times.elapsed_seconds(F.lit(1000.0), F.lit(1000.0) + F.col("value")).alias("seconds"),
    )


@query("key_functions", "comments", """
SELECT comment_id, split_part(parent_id, '_', 2) AS parent,
  concat('comment_id_', comment_id) AS key,
  CASE WHEN contains(concat('m:', subreddit), ':') THEN concat('m:', subreddit) END AS tagged,
  concat(subreddit, ':latest') AS untagged
FROM comments
""")
def _(t):
    return t.comments.select(
        "comment_id", text.parent_comment_id("parent_id").alias("parent"),
        keys.registry_key("comment_id", "comment_id").alias("key"),
        keys.full_model_name(F.concat(F.lit("m:"), F.col("subreddit"))).alias("tagged"),
        keys.full_model_name("subreddit").alias("untagged"),
    )


@query("json_fields", "analysis_documents", """
SELECT id, json_extract_string(analysis_document, '$.schema_version') AS schema_version,
  json_extract_string(analysis_document, '$.category') AS category,
  json_extract_string(analysis_document, '$.reference_id') AS reference_id,
  json_extract_string(analysis_document, '$.llm') AS llm,
  json_valid(analysis_document) AS valid
FROM analysis_documents
""")
def _(t):
    found = docs.fields(
        t.analysis_documents, "analysis_document", "schema_version", "category",
        "reference_id", "llm",
    )
    return found.select(
        "id", "schema_version", "category", "reference_id", "llm",
        docs.is_json("analysis_document").alias("valid"),
    )


@query("encrypt_roundtrip", "", """
SELECT doc_id, text AS plain, true AS hidden FROM documents
""")
def _(t):
    key = F.substring(F.sha2(F.lit("test key"), 256), 1, 32)
    token = t.documents.select("doc_id", "text", docs.encrypt_text("text", key).alias("token"))
    return token.select(
        "doc_id", docs.decrypt_text("token", key).alias("plain"),
        (F.col("token") != F.col("text")).alias("hidden"),
    )


@query("sql_text", "", """
SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment
""")
def _(t):
    return tables.run_sql(
        t.spark, f"SELECT c_mktsegment, count(*) AS n FROM parquet.`{t.path('customer')}` GROUP BY c_mktsegment")


@query("point_lookup", "posts comments", f"""
SELECT post_id AS id, post_title || post_body AS text FROM posts
WHERE post_id = 'p16' AND post_body NOT IN {NO_TEXT}
UNION ALL SELECT comment_id, comment_body FROM comments
WHERE comment_id = (SELECT min(comment_id) FROM comments WHERE comment_body NOT IN {NO_TEXT})
""")
def _(t):
    first = enrichment.comment_text(t.comments).agg(F.min("comment_id")).first()[0]
    post = enrichment.post_text(t.posts, "p16").toDF("id", "text")
    return post.union(enrichment.comment_text(t.comments, first))


@query("plucked_names", "", "SELECT c_name FROM customer")
def _(t):
    return tables.pluck(t.customer, "c_name")


@query("first_row", "posts", "SELECT post_id FROM posts ORDER BY post_id LIMIT 1")
def _(t):
    return top.first_row(t.posts.select("post_id").orderBy("post_id"))


@query("document_lists", "analysis_documents", """
SELECT json_extract_string(analysis_document, '$.category') AS category,
  json_extract_string(analysis_document, '$.llm') AS llm, count(*) AS n
FROM analysis_documents GROUP BY ALL
""")
def _(t):
    lists = t.analysis_documents.groupBy(F.col("id") % 100).agg(F.collect_list("analysis_document").alias("d"))
    parsed = lists.select(F.explode(docs.parsed_documents("d", "category string, llm string")).alias("r"))
    return parsed.groupBy("r.category", "r.llm").agg(F.count(F.lit(1)).alias("n"))


@query("document_text", "analysis_documents", "SELECT id, analysis_document AS text FROM analysis_documents")
def _(t):
    return t.analysis_documents.select("id", F.col("analysis_document").alias("text"))


@query("answer_hashes", "", """
SELECT lang, count(DISTINCT text) AS hashes, 128 AS length FROM documents GROUP BY lang
""")
def _(t):
    return t.documents.select("lang", docs.sha512_hex("text").alias("h")).groupBy("lang").agg(
        F.countDistinct("h").alias("hashes"), F.max(F.length("h")).alias("length"))


@query("epoch_times", "posts", """
SELECT post_id, CAST(to_timestamp(post_created_utc) AT TIME ZONE 'UTC' AS TIMESTAMP) AS created FROM posts
""")
def _(t):
    return t.posts.select(
        "post_id", times.epoch_to_timestamp("post_created_utc").cast("timestamp_ntz").alias("created"))


@query("format_width_sql", "", ORACLE["format_width"])
def _(t):
    sql_functions.register(t.spark)
    return t.documents.selectExpr("doc_id", "format_width(text, 80) AS formatted")


# --- streams -----------------------------------------------------------------

SLICES, FILES = 6, 2


def _arriving(t: TestTables, folder: str) -> DataFrame:
    """The events as a stream of six micro-batches or more, each later in time than the one before.

    They land slice by slice, in the same number of files each, and a batch takes so many.
    """
    shares = [i / SLICES for i in range(1, SLICES)]
    cuts = t.events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), shares)).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [None, *(cuts or []), None]
    for low, high in zip(edges, edges[1:]):
        own = t.events if low is None else t.events.where(at >= low)
        own = own if high is None else own.where(at < high)
        own.repartition(FILES).write.mode("append").parquet(folder)
    return ingest.stream_parquet(t.spark, folder, "*.parquet", t.events.schema, files_per_trigger=FILES)


def _claims_as_stream(t: TestTables, folder: str) -> DataFrame:
    return _arriving(t, folder).select(
        F.concat(F.lit("post_id_"), F.col("user_id")).alias("key"), "event_id", "ts"
    )


@query("claim_stream", "registry_claims", """
WITH RECURSIVE ordered AS (
  SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n
  FROM registry_claims),
walk AS (
  SELECT key, ts, event_id, n, ts AS last, true AS won FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.key, o.ts, o.event_id, o.n,
    CASE WHEN o.ts >= w.last + INTERVAL 5 DAY THEN o.ts ELSE w.last END,
    o.ts >= w.last + INTERVAL 5 DAY
  FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)
SELECT key, ts, event_id, won AS claimed FROM walk
""")
def _(t):
    out = fresh_path(t.spark, "claims")
    state.claim_stream(
        _claims_as_stream(t, out + "/landing"), "key", "ts", "event_id", out + "/rows",
        out + "/checkpoint", FIVE_DAYS,
    ).awaitTermination()
    return t.spark.read.parquet(out + "/rows").select("key", "ts", "event_id", "claimed")


@query("quota_stream", "registry_claims", """
SELECT event_id, key,
  row_number() OVER (PARTITION BY key ORDER BY ts, event_id) % 11 <> 0 AS allowed
FROM registry_claims
""")
def _(t):
    out = fresh_path(t.spark, "quota")
    state.quota_stream(
        _claims_as_stream(t, out + "/landing"), "key", ["ts", "event_id"], out + "/rows",
        out + "/checkpoint",
    ).awaitTermination()
    return t.spark.read.parquet(out + "/rows").select("event_id", "key", "allowed")


@query("feed_stream", "posts", """
SELECT post_id, subreddit, post_author, post_body FROM posts
WHERE post_author IS NULL OR post_author <> 'AutoModerator'
""")
def _(t):
    out = fresh_path(t.spark, "feed")
    post_records(t).repartition(6).write.text(out + "/landing")
    records = feeds.stream_records(t.spark, "posts", out + "/landing", 2)
    ingest.insert_ignore_stream(
        feeds.post_rows(records), out + "/posts", UNIQUE_KEYS["posts"],
        ["post_created_utc", F.md5("post_body")], out + "/checkpoint", "post_author",
    ).awaitTermination()
    return t.spark.read.parquet(out + "/posts").select(
        "post_id", "subreddit", "post_author", "post_body"
    )


@query("service_log_stream", "service_log_lines", """
SELECT 'row' AS kind, line FROM service_log_lines WHERE json_valid(line)
UNION ALL
SELECT 'reject', 'malformed line: ' || line FROM service_log_lines WHERE NOT json_valid(line)
""")
def _(t):
    out = fresh_path(t.spark, "logs")
    t.service_log_lines.select("line").repartition(5).write.text(out + "/landing")
    lines = ingest.stream_lines(t.spark, out + "/landing", 1)
    ingest.service_log_stream(
        lines, "host", "model-server", out + "/lines", out + "/checkpoint"
    ).awaitTermination()
    schema = logs.sorted_lines(lines, F.lit("host"), "", F.lit(""), F.col("ts")).schema
    rows, rejects = (logs.stored_lines(t.spark, out + "/lines", schema, bad) for bad in (False, True))
    return rows.selectExpr("'row' AS kind", "message AS line").union(
        rejects.selectExpr("'reject'", "error"))


@query("daily_window", "prompt_completion_details", """
SELECT CAST(expires_at AS DATE) AS date,
  round(sum(CAST(prompt_completion_time AS DOUBLE) * tokens_per_second), 6) AS total_tokens,
  count(*) AS answers
FROM prompt_completion_details WHERE tokens_per_second > 0 GROUP BY 1
""")
def _(t):
    out = fresh_path(t.spark, "daily")
    details = _arriving(t, out + "/landing").selectExpr(
        "ts AS expires_at", "CAST(floor(value) AS INT) AS prompt_completion_time",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 0D "
        "ELSE value / 8 END AS tokens_per_second",
    )
    windows.keep_current(
        windows.daily_tokens(details), out + "/days", out + "/checkpoint"
    ).awaitTermination()
    return rounded(t.spark.read.parquet(out + "/days"), "total_tokens")


# Rows of every 50th event arrive a batch or more late, behind the end of their day.
_LATE_SECONDS = 3600


def _with_stragglers(t: TestTables, folder: str) -> DataFrame:
    """The events day by day; the first slice's rows with ids divisible by 50 land last."""
    _arriving(t, folder)
    first = t.events.agg(F.min("ts")).first()[0]
    late = t.events.where((F.col("event_id") % 50 == 0) & (F.to_date("ts") == F.lit(first).cast("date")))
    late.withColumn("event_id", -F.col("event_id") - 1).repartition(FILES).write.mode("append").parquet(folder)
    return ingest.stream_parquet(t.spark, folder, "*.parquet", t.events.schema, files_per_trigger=FILES)


_FINAL_SQL = """
SELECT CAST(ts AS DATE) AS date, {sums}, 'final' AS kind FROM events
WHERE CAST(ts AS DATE) < CAST((SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS DATE) {more} GROUP BY 1
UNION ALL
SELECT CAST(ts AS DATE), {sums}, 'late' FROM events
WHERE event_id % 50 = 0 AND CAST(ts AS DATE) = CAST((SELECT min(ts) FROM events) AS DATE) {more} GROUP BY 1
"""


def _final(t: TestTables, name: str, sums: dict, where: str) -> DataFrame:
    out = fresh_path(t.spark, name)
    rows = _with_stragglers(t, out + "/landing").where(where)
    windows.final_days(rows, "ts", sums, out, out + "/checkpoint", _LATE_SECONDS).awaitTermination()
    final = t.spark.read.parquet(out + "/final").select("date", *sums, F.lit("final").alias("kind"))
    late = t.spark.read.parquet(out + "/late").groupBy(F.to_date("ts").alias("date")).agg(
        *[F.sum(v).alias(n) for n, v in sums.items()]).withColumn("kind", F.lit("late"))
    return final.unionByName(late)


@query("final_documents", "", _FINAL_SQL.format(sums="CAST(count(*) AS BIGINT) AS num_documents", more=""))
def _(t):
    return _final(t, "final", {"num_documents": F.lit(1)}, "TRUE")


@query("final_tokens", "", _FINAL_SQL.format(
    sums="CAST(sum(CAST(floor(value / 8 * floor(value)) AS BIGINT)) AS BIGINT) AS total_tokens", more="AND value > 1"))
def _(t):
    total = F.floor(F.col("value") / 8 * F.floor("value"))
    return _final(t, "tokens", {"total_tokens": total}, "value > 1")
