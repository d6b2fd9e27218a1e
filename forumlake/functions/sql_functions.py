"""The text functions for use in SQL texts, as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from forumlake.functions.text import (
    BOILERPLATE,
    BOILERPLATE_REPLACEMENT,
    LINE_WIDTH,
    MARK_PATTERN,
    WORD_PATTERN,
)


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sanitized(argument: str) -> str:
    for phrase in BOILERPLATE:
        argument = f"replace({argument}, {_literal(phrase)}, {_literal(BOILERPLATE_REPLACEMENT)})"
    return argument


def register(spark: SparkSession) -> None:
    """Define ``format_width``, ``sanitize_text``, ``word_count``, ``punctuation_count`` and
    ``full_model_name``. The bodies are expressions, so Catalyst folds them into the query.

    ``format_width`` takes a width for compatibility and, like the column
    function, always uses 80.
    """
    w = LINE_WIDTH
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION format_width(t STRING, width INT) RETURNS STRING
        RETURN CASE WHEN length(t) > 0 THEN array_join(transform(
          concat(
            slice(split(t, '\\n'), 1, CAST(ceil(length(t) / {w}) AS INT)),
            array_repeat('', CAST(ceil(length(t) / {w}) AS INT) - size(split(t, '\\n')))),
          (line, i) -> CASE WHEN i = 0 THEN substring(line, 1, {w})
            ELSE concat('\\n', repeat(' ', {w} - length(substring(line, 1, {w}))),
                        substring(line, 1, {w})) END), '') END""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION sanitize_text(t STRING) RETURNS STRING
        RETURN {_sanitized('t')}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION word_count(t STRING) RETURNS INT
        RETURN regexp_count(t, {_literal(WORD_PATTERN)})""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION punctuation_count(t STRING) RETURNS INT
        RETURN regexp_count(t, {_literal(MARK_PATTERN)})""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION full_model_name(n STRING) RETURNS STRING
        RETURN CASE WHEN contains(n, ':') THEN n ELSE concat(n, ':latest') END""")
