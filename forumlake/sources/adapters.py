"""The twelve tables as views over the test tables.

One text serves Spark SQL and DuckDB: ``@name`` stands for a test table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from forumlake.sources.tables import footer_table

VIEWS: dict[str, str] = {
    "posts": """
SELECT concat('p',doc_id) AS post_id,
  CASE WHEN doc_id%9=0 THEN concat('u_',source) WHEN doc_id%9=1 THEN 'democrats' WHEN doc_id%9=2 THEN 'Republican' WHEN doc_id%9=3 THEN 'Libertarian' WHEN doc_id%9=4 THEN 'ukpol' ELSE source END AS subreddit,
  CASE WHEN doc_id%17=0 THEN NULL WHEN doc_id%23=0 THEN 'AutoModerator' ELSE concat('a',doc_id%50) END AS post_author,
  CASE WHEN doc_id%13=0 THEN '[deleted by user]' WHEN doc_id%13=1 THEN '[deleted]' ELSE concat(lang,' ',source,' ',n_chars) END AS post_title,
  CASE WHEN doc_id%11=0 THEN '[removed]' WHEN doc_id%11=1 THEN '[deleted]' WHEN doc_id%11=2 THEN '' WHEN doc_id%11=3 THEN NULL WHEN doc_id%11=4 THEN '[ Removed by Reddit ] x' ELSE text END AS post_body,
  CAST(1704067200+(doc_id*60)%31536000 AS INT) AS post_created_utc,
  doc_id%2=0 AS is_post_oc, doc_id%3=0 AS is_post_video,
  CAST(CASE WHEN doc_id%29=0 THEN NULL ELSE (doc_id*37)%1000 END AS INT) AS post_upvote_count,
  CAST(0 AS INT) AS post_downvote_count, CAST((doc_id%50)*1000 AS INT) AS subreddit_members
FROM @documents
""",
    "comments": """
SELECT concat('c',conv_id*100+turn) AS comment_id,
  CASE WHEN turn=0 THEN concat('t3_p',conv_id) ELSE concat('t1_c',conv_id*100+CAST(floor((turn-1)/2) AS BIGINT)) END AS parent_id,
  CASE WHEN (conv_id+turn)%19=0 THEN NULL WHEN (conv_id+turn)%23=0 THEN 'AutoModerator' ELSE concat('a',(conv_id*7+turn)%50) END AS comment_author,
  role='user' AS is_comment_submitter,
  CASE WHEN turn%4=0 THEN 'false' ELSE CAST(1704070000+conv_id AS VARCHAR(20)) END AS is_comment_edited,
  CAST(1704067200+(conv_id*3600+turn*60)%31536000 AS INT) AS comment_created_utc,
  CASE WHEN (conv_id*3+turn)%13=0 THEN '[removed]' WHEN (conv_id*3+turn)%13=1 THEN '[deleted]' WHEN (conv_id*3+turn)%13=2 THEN '' WHEN (conv_id*3+turn)%13=3 THEN NULL ELSE text END AS comment_body,
  concat('p',conv_id) AS post_id, concat('src',conv_id%20) AS subreddit,
  CAST((conv_id*13+turn)%200 AS INT) AS comment_upvote_count, CAST(0 AS INT) AS comment_downvote_count
FROM @conversations
""",
    "authors": """
SELECT concat('t2_',c_custkey) AS author_id, concat('a',c_custkey*2) AS author_name, CAST(1500000000+c_custkey%31536000 AS INT) AS author_created_utc
FROM @customer
""",
    "subscription": """
SELECT DISTINCT '1704067200' AS datetimesubscribed, source AS subreddit FROM @documents WHERE source NOT IN ('src3','src7','src11')
""",
    "analysis_documents": """
SELECT doc_id AS id, CAST(DATE '2024-08-15'+CAST(doc_id%40 AS INT) AS TIMESTAMP) AS ts, md5(concat('p',doc_id)) AS shasum_512,
  CASE WHEN doc_id%3=0 THEN concat('{"schema_version":"1","source":"reddit","category":"post","post_id":"p',doc_id,'","llm":"phi4","analysis":"',CASE WHEN doc_id%2=0 THEN 'therefore I cannot answer this question.' ELSE 'an answer' END,'"}')
  ELSE concat('{"schema_version":"4","source":"reddit","category":"post","reference_id":"p',doc_id,'","llm":"',CASE WHEN doc_id%2=0 THEN 'phi4' ELSE 'gemma2' END,'","analysis":"text ',doc_id,'"}') END AS analysis_document
FROM @labels
UNION ALL
SELECT 1000000+conv_id*100+turn, CAST(DATE '2024-08-15'+CAST(conv_id%40 AS INT) AS TIMESTAMP), md5(concat('c',conv_id*100+turn)),
  CASE WHEN turn%4=1 THEN concat('{"schema_version":"1","source":"reddit","category":"comment","comment_id":"c',conv_id*100+turn,'","llm":"phi4","analysis":"ok"}')
  ELSE concat('{"schema_version":"4","source":"reddit","category":"comment","reference_id":"c',conv_id*100+turn,'","llm":"phi4","analysis":"ok"}') END
FROM @conversations WHERE role='assistant'
""",
    "prompt_completion_details": """
SELECT event_id AS id, event_type AS model, CASE event_id%6 WHEN 0 THEN 'false' WHEN 1 THEN '0.3.10-rc1' WHEN 2 THEN '0.3.9' WHEN 3 THEN '0.3.10' WHEN 4 THEN '0.3.12' ELSE '0.4.0' END AS ollama_ver,
  CAST(floor(value) AS INT) AS prompt_completion_time,
  CASE WHEN event_id%10=0 THEN NULL WHEN event_id%10=1 THEN CAST(0 AS DOUBLE) ELSE value/8 END AS tokens_per_second,
  ts AS expires_at
FROM @events
""",
    "responses": """
SELECT concat('c',u.conv_id*100+u.turn) AS reference_id, u.text AS prompt, a.text AS content,
  CAST(char_length(a.text) AS BIGINT) AS eval_count, (a.turn+1)*1000000000 AS eval_duration
FROM @conversations u JOIN @conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1
WHERE u.role='user' AND a.role='assistant'
""",
    "service_log_lines": """
SELECT event_id AS line_no, ts, CASE WHEN event_id%10=0 THEN '{bad json' ELSE concat('{"host_name":"h',user_id%5,'","severity":"',event_type,'","message":',props,'}') END AS line
FROM @events
""",
    "registry_claims": """
SELECT concat('post_id_',user_id) AS key, event_id, ts FROM @events
""",
    "models": """
SELECT * FROM (VALUES ('view:latest',100,80),('click:latest',200,160),('signup:latest',300,240),('purchase:latest',400,320)) AS t(name,size,size_vram)
""",
    "llms": """
SELECT * FROM (VALUES (0,'phi4'),(1,'gemma2'),(2,'llama3')) AS t(pos,llm)
""",
}

# Declared schemas: no job has to look into the files first.
BASE_TABLES: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

_BASE_NAME = re.compile(r"@(\w+)")


def view_sql(name: str) -> str:
    """The view's text for an engine that knows the test tables by name."""
    return _BASE_NAME.sub(r"\1", VIEWS[name]).strip()


class TestTables:
    """Test tables and views as attributes: ``t.posts``, ``t.events``.

    With ``footers`` they are read so that counts come from the files' footers.
    """

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str, footers: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.footers = footers

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name].replace("{", "{{").replace("}", "}}")
            used = {n: getattr(self, n) for n in _BASE_NAME.findall(text)}
            return self.spark.sql(_BASE_NAME.sub(r"{\1}", text), **used)
        if name in BASE_TABLES and self.footers:
            # Kept, so that views over one table look for its files once.
            self.__dict__[name] = footer_table(self.spark, self.path(name), BASE_TABLES[name])
            return self.__dict__[name]
        if name in BASE_TABLES:
            return self.spark.read.schema(BASE_TABLES[name]).parquet(self.path(name))
        raise AttributeError(name)
