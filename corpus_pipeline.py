"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the kept rows with the columns of documents; the last returns the packed pieces.
Null and empty texts have no language and leave in the first stage. Other columns of
documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forumlake.llm import decontam, dedup, jaccard, langid, packing
from forumlake.llm.catalog import held_out
from forumlake.llm.common import table
from forumlake.session import durable

#: Rows that a Python task is handed at once. The texts of a batch are in memory three times and more: in
#: Spark's buffer, which doubles as it grows, in Arrow and as Python strings.
BATCH_ROWS = 1_000


def in_small_batches(spark: SparkSession) -> None:
    """Hand the Python tasks of this session at most BATCH_ROWS rows at once; a smaller setting holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled documents have; the rejected ones go."""
    in_small_batches(spark)
    return langid.keep_accepted(docs, langid.train(docs, usable=~held_out()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    in_small_batches(spark)
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similar texts connect, the row with the smallest id."""
    in_small_batches(spark)
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    in_small_batches(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all texts with their sequence and place."""
    in_small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Language models, links of similar sets and token ids are not expressible in SQL.
ORACLE_SQL = None
