"""Running results per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def daily(rows: DataFrame, ts: str, *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates per UTC day, for tables and streams.

    With ``late`` a day is final once the watermark has passed it; without it
    every day stays open.
    """
    stamped = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    if late:
        stamped = stamped.withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", "1 day")).agg(*aggregates).select(
        F.to_date("window.start").alias("date"), "*"
    ).drop("window")


def daily_documents(documents: DataFrame, ts: str = "timestamp", late: str | None = None
                    ) -> DataFrame:
    return daily(
        documents.filter(F.col("analysis_document").isNotNull()), ts,
        F.count(F.lit(1)).alias("num_documents"), late=late,
    )


def daily_tokens(details: DataFrame, ts: str = "expires_at", late: str | None = None
                 ) -> DataFrame:
    tps = F.col("tokens_per_second").cast("double")
    return daily(
        details.filter(F.col("tokens_per_second") > 0), ts,
        F.sum(F.coalesce(F.col("prompt_completion_time").cast("double") * tps, tps))
        .alias("total_tokens"),
        F.count(F.lit(1)).alias("answers"), late=late,
    )


def final_days(
    stream: DataFrame, ts: str, sums: dict[str, Column], folder: str, checkpoint: str, late_seconds: int,
    available_now: bool = True,
) -> StreamingQuery:
    """Sums per UTC day, each day once, when the newest time seen is ``late_seconds`` past its end.

    ``folder``/final gets the days (date and the sums), ``folder``/late the rows of days that were
    final before their batch, ``folder``/open the days still open after each batch. A batch
    reads the open days and the clock of the batch before, which are a few rows, and
    replaces its own output when it runs again. Rows without a time are late.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.to_date(F.col(ts).cast("timestamp"))
        named = batch.withColumn("_day", day)
        held, clock = None, None
        if batch_id:
            before = f"{folder}/open/batch={batch_id - 1}"
            held = spark.read.parquet(f"{before}/days")
            clock = spark.read.parquet(f"{before}/clock").first()["closed"]
        closed = F.lit(False) if clock is None else F.col("_day") < F.lit(clock)
        is_late = F.col("_day").isNull() | closed
        named.where(is_late).drop("_day").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        days = named.where(~is_late).groupBy(F.col("_day").alias("date")).agg(
            *[F.sum(v).alias(n) for n, v in sums.items()], F.max(F.col(ts).cast("timestamp")).alias("_newest"))
        if held is not None:
            days = days.unionByName(held).groupBy("date").agg(
                *[F.sum(n).alias(n) for n in sums], F.max("_newest").alias("_newest"))
        here = f"{folder}/open/batch={batch_id}"
        # The first day that is not over: late_seconds before the newest time.
        days.coalesce(1).write.mode("overwrite").parquet(f"{here}/all")
        days = spark.read.parquet(f"{here}/all")
        edge = F.to_date(F.max(F.col("_newest")) - F.make_dt_interval(secs=F.lit(late_seconds)))
        newest = days.agg(edge.alias("closed")).first()["closed"]
        newest = max((d for d in (newest, clock) if d is not None), default=None)
        over = F.lit(False) if newest is None else F.col("date") < F.lit(newest)
        days.where(over).drop("_newest").write.mode("overwrite").parquet(f"{folder}/final/batch={batch_id}")
        days.where(~over).write.mode("overwrite").parquet(f"{here}/days")
        spark.createDataFrame([(newest,)], "closed date").write.mode("overwrite").parquet(f"{here}/clock")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def keep_current(result: DataFrame, path: str, checkpoint: str, available_now: bool = True
                 ) -> StreamingQuery:
    """Replace the table at ``path`` with the whole result after every batch.

    The result has one row per day, so it stays small.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    writer = (
        result.writeStream.outputMode("complete").foreachBatch(step)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
