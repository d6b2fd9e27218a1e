"""Streams into tables: feeds, service logs, purges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from forumlake.functions.predicates import survives_purge
from forumlake.operators.dml import append_ignore
from forumlake.sources.logs import sorted_lines, store_lines


def _start(rows: DataFrame, step: Callable, checkpoint: str, available_now: bool
           ) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def insert_ignore_stream(
    rows: DataFrame, path: str, unique: list[list[str]], order: list[str], checkpoint: str,
    bot_column: str | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Add unseen rows to the table at ``path``. A batch that runs twice adds nothing new,
    since its keys are then present. ``bot_column`` drops rows of the moderation bot."""

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch if bot_column is None else batch.filter(survives_purge(bot_column))
        append_ignore(batch.sparkSession, path, kept, unique, order)

    return _start(rows, step, checkpoint, available_now)


def service_log_stream(
    lines: DataFrame, host: str, service: str, out: str, checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Lines (ts, line) to log rows and rejects (see ``logs.sorted_lines``), in one pass and one
    write, each batch in its own folder, so that a repeated batch replaces itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        found = sorted_lines(batch, F.lit(host), service, F.sha2("line", 256), F.col("ts"))
        store_lines(found, f"{out}/batch={batch_id}")

    return _start(lines, step, checkpoint, available_now)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None
                 ) -> DataFrame:
    """Log files as lines, stamped on arrival."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        F.current_timestamp().alias("ts"), F.col("value").alias("line")
    )


def stream_parquet(spark: SparkSession, folder: str, name: str, schema,
                   files_per_trigger: int | None = None) -> DataFrame:
    """The files called ``name`` (a glob) in a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
