"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.llm import (
    decontam, dedup, html, jaccard, langid, packing, runs, secrets, sharding, tokens, topk, urls, whitening,
)
from forumlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return keep


RULES = [
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def page_number() -> Column:
    """The id of a page's document, the number its path ends in; null without one."""
    return F.regexp_extract(
        urls.url_path(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(\.html|/)*$", 1).try_cast("long")


def listed_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of pages whose document a label calls toxic."""
    own = pages.select("url", page_number().alias("doc_id"))
    return own.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("url")


@query("op1_url_filter", r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '') END AS k,
    try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})(\.html|/)*$', 1), '') AS BIGINT) AS doc_id
  FROM parts),
listed AS (
  SELECT DISTINCT k FROM keyed WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND k IS NOT NULL),
rules(r_text, r_host, r_path, r_verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
fits AS (
  SELECT page_id, max_by(r_text, length(r_text)) AS rule, max_by(r_verdict, length(r_text)) AS r_verdict
  FROM keyed, rules
  WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id)
SELECT keyed.page_id, host, path, rule,
  coalesce(r_verdict, CASE WHEN k IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN fits USING (page_id)
""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = urls.compile_list(listed_urls(pages, table(spark, sf_dir, "labels")))
    return urls.url_verdicts(pages, RULES, listed)


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, documents = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    order = F.xxhash64("page_id")
    sample = pages.select("page_id", "html", page_number().alias("doc_id")).where(
        "doc_id IS NOT NULL").orderBy(order).limit(html.TRAIN_PAGES)
    articles = documents.select("doc_id", F.col("text").alias("article"))
    model = html.train(articles.join(F.broadcast(sample), "doc_id"), "html", "article", order)
    return html.extract_text(pages, model)


def held_out() -> Column:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    return F.coalesce(fold == 2, F.lit(False))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents, usable=~held_out())
    found = langid.identify_languages(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("lang").alias("lang_pred"),
                        "score", "accepted")


def joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)))")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
    counts = [F.expr(f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
              for k in secrets.BASE_KINDS]
    base = F.sha2(joined(f"filter(found, s -> s.kind IN ({kinds}))"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), joined("found").alias("spans"))


@query("op9_exact_dedup", r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_shards(table(spark, sf_dir, "documents"))


def with_planted_repeats(documents: DataFrame) -> DataFrame:
    """Every tenth document, by its id's checksum, repeats a stretch of itself from some word on."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.col("h") % 10 == 0
    found = found.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words"))
    found = found.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    found = found.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    word = "words[CAST(if(i < a, i, a + (i - a) % p) AS INT)]"
    planted = F.expr(f"array_join(transform(sequence(0, n - 1), i -> {word}), ' ')")
    return found.select("doc_id", F.when(F.expr("n > 0"), planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * -top.less div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_exact_topk")
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
