"""Tables by name: declared schemas, parameterised queries, the list of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.functions.predicates import not_system_table
from forumlake.schemas import TABLES


def read_table(spark: SparkSession, name: str, base: str, fmt: str = "parquet") -> DataFrame:
    """One of the twelve tables under ``base``, read with its declared schema. The column of the
    folders of a table that is stored by key is left out."""
    table = spark.read.schema(TABLES[name]).format(fmt).load(f"{base.rstrip('/')}/{name}")
    extra = [c for c in table.columns if re.match(r"^key\d+$", c)]
    return table.drop(*extra)


def read_tables(spark: SparkSession, base: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: read_table(spark, name, base, fmt) for name in TABLES}


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


V1_SOURCES = "spark.sql.sources.useV1SourceList"


def footer_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table through the reader that can answer counts from the files' footers."""
    before = spark.conf.get(V1_SOURCES)
    spark.conf.set(V1_SOURCES, "")
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    finally:
        spark.conf.set(V1_SOURCES, before)


def select_rows(
    spark: SparkSession, query: str, params: Mapping | Sequence | None = None
) -> DataFrame | bool:
    """A text that starts with SELECT gives rows; any other text is run and gives True.

    ``params`` binds ``:name`` or ``?`` markers; values are never put into the text.
    """
    args = list(params) if isinstance(params, Sequence) else params
    rows = spark.sql(query, args=args) if args else spark.sql(query)
    if query.strip().upper().startswith("SELECT"):
        return rows
    return True


def as_documents(rows: DataFrame) -> DataFrame:
    """Each row as one JSON document keyed by column name."""
    return rows.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json")
    )


def pluck(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key)


def table_names(tables: Mapping[str, DataFrame], *excluded: str) -> list[str]:
    """Names that are no system tables (``pg_`` with a wildcard underscore) and not excluded."""
    return [
        n for n in tables
        if not (len(n) >= 3 and n.startswith("pg")) and n not in excluded
    ]


def catalog_tables(spark: SparkSession, database: str, *excluded: str) -> DataFrame:
    """The tables of a catalog database."""
    names = spark.sql(f"SHOW TABLES IN `{database}`").filter("NOT isTemporary")
    return names.select(F.col("tableName").alias("table_name")).filter(
        not_system_table("table_name") & ~F.col("table_name").isin(*excluded)
        if excluded else not_system_table("table_name")
    )
