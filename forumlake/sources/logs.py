"""Service logs: one JSON object per line, bad lines set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.functions.documents import is_json


def recent_lines(lines: DataFrame, as_of: Column, minutes: int = 10, ts: str = "ts") -> DataFrame:
    """Lines of the last ``minutes`` before ``as_of``; the test is on the raw column."""
    start = as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return lines.filter((F.col(ts) >= start) & (F.col(ts) <= as_of))


ROW = ("timestamp", "host_name", "service_name", "message")
REJECT = ("item_id", "item_type", "error", "created_at")


def sorted_lines(
    lines: DataFrame, host: Column, service: str, item_id, created_at: Column, line: str = "line",
    ts: str = "ts",
) -> DataFrame:
    """Every line that is not null once, as a log row or, where it is no JSON, as a row of the
    ``errors`` table: ``rejected`` tells which, the other's columns are null. Lines are parsed once."""
    item = F.col(item_id) if isinstance(item_id, str) else item_id
    found = lines.filter(F.col(line).isNotNull()).withColumn("rejected", ~is_json(line))
    bad, good = F.col("rejected"), ~F.col("rejected")
    return found.select(
        "rejected",
        F.when(good, F.col(ts)).alias("timestamp"), F.when(good, host).alias("host_name"),
        F.when(good, F.lit(service)).alias("service_name"), F.when(good, F.col(line)).alias("message"),
        F.when(bad, item.cast("string")).alias("item_id"),
        F.when(bad, F.lit("service_log")).alias("item_type"),
        F.when(bad, F.concat(F.lit("malformed line: "), F.col(line))).alias("error"),
        F.when(bad, created_at).alias("created_at"),
    )


def store_lines(found: DataFrame, folder: str) -> None:
    """One write for both kinds, parted by ``rejected``."""
    found.write.mode("overwrite").partitionBy("rejected").parquet(folder)


def stored_lines(spark: SparkSession, folder: str, schema, rejected: bool) -> DataFrame:
    """The log rows or the rejects of a stored folder; only their part is read."""
    rows = spark.read.schema(schema).parquet(folder).where(F.col("rejected") == F.lit(rejected))
    return rows.select(*(REJECT if rejected else ROW))


def service_log_rows(
    lines: DataFrame, host: Column, service: str, line: str = "line", ts: str = "ts"
) -> DataFrame:
    """The log rows alone."""
    return lines.filter(is_json(line)).select(
        F.col(ts).alias("timestamp"),
        host.alias("host_name"),
        F.lit(service).alias("service_name"),
        F.col(line).alias("message"),
    )


def rejected_lines(
    lines: DataFrame, item_id, created_at: Column, line: str = "line"
) -> DataFrame:
    """Lines that are no JSON, as rows of the ``errors`` table."""
    found = sorted_lines(lines, F.lit(None).cast("string"), "", item_id, created_at, line, line)
    return found.filter("rejected").select(*REJECT)


def program_log_rows(
    messages: DataFrame, host, program_name, program_version, severity, message, ts
) -> DataFrame:
    """Six fields packed into one JSON column beside the time stamp."""
    from forumlake.functions.documents import to_document
    from forumlake.functions.times import iso_text

    def col(c):
        return F.col(c) if isinstance(c, str) else c

    stamp = iso_text(ts)
    return messages.select(
        col(ts).cast("timestamp").alias("timestamp"),
        to_document(
            stamp.alias("timestamp"), col(host).alias("host"),
            col(program_name).alias("program_name"),
            col(program_version).alias("program_version"),
            col(severity).alias("severity"), col(message).alias("message"),
        ).alias("log_json"),
    )
