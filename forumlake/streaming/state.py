"""Keyed state over micro-batches: claims that expire and quota counters.

Each key has one value in the state store. A micro-batch reads and writes the values of
its own keys only, so its work and the growth of the state do not depend on how many
batches went before. Answers are appended to a table by the file sink, once each.

Keys are dealt by hash into a fixed number of groups. The processor is called once for a
group and batch and takes the rows of its keys together, since a call for each key costs far
more than the rows of most keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from forumlake.operators.numbering import QUOTA
from forumlake.operators.registry import TTL_SECONDS

STORE = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the store that keeps state on disk and saves what changed.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys. A group's rows in one batch are in memory together.
GROUPS = 256
#: Timers of a group are rounded up to a multiple of so many milliseconds, to have few of them.
TIMER_STEP = 86_400_000


def _sorted_by_key(rows: Iterator[pd.DataFrame], order: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows key by key, each in ``order``; the keys; and where each begins, with the end."""
    frame = pd.concat(list(rows))
    codes, keys = pd.factorize(frame["key_"])
    frame = frame.assign(code_=codes).sort_values(["code_", *order], kind="stable")
    return frame, keys, np.searchsorted(frame["code_"].to_numpy(), np.arange(len(keys) + 1))


class ClaimProcessor(StatefulProcessor):
    """The time of the last accepted claim of each key, until a timer behind its expiry takes it away."""

    def __init__(self, order: list[str], ttl_seconds: int):
        self.order, self.ttl = order, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "key string", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, keys, cuts = _sorted_by_key(rows, self.order)
        known = frame["micros_"].notna().to_numpy()  # the first ones of each key
        times = frame["micros_"].fillna(0).to_numpy("int64")
        claimed = np.zeros(len(frame), bool)
        timers = set()
        for name, first, end in zip(keys, cuts[:-1], cuts[1:], strict=True):
            own = times[first:end][known[first:end]]
            if not len(own):
                continue
            before = self.last.getValue((name,))
            # From one accepted claim to the first that is late enough.
            at = 0 if before is None else int(np.searchsorted(own, before[0] + self.ttl))
            last = None
            while at < len(own):
                claimed[first + at] = True
                last = int(own[at])
                at = max(at + 1, int(np.searchsorted(own, last + self.ttl)))
            if last is not None:
                self.last.updateValue((name,), (last,))
                timers.add(-(-(last + self.ttl) // 1000 // TIMER_STEP) * TIMER_STEP)
        for at in timers.difference(self.handle.listTimers() if timers else ()):
            self.handle.registerTimer(at)
        yield frame.drop(columns=["micros_", *HELPERS]).assign(claimed=claimed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for name, (last,) in list(self.last.iterator()):
            if (last + self.ttl) // 1000 <= now:
                self.last.removeKey(name)
        return iter([])

    def close(self) -> None:
        pass


class QuotaProcessor(StatefulProcessor):
    """The counter of each key: calls since the last refusal."""

    def __init__(self, order: list[str], quota: int):
        self.order, self.quota = order, quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getMapState("count", "key string", "calls bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, keys, cuts = _sorted_by_key(rows, self.order)
        before = np.array([(self.count.getValue((name,)) or (0,))[0] for name in keys], "int64")
        calls = np.diff(cuts)
        for name, n in zip(keys, (before + calls) % (self.quota + 1), strict=True):
            self.count.updateValue((name,), (int(n),))
        total = np.arange(1, len(frame) + 1) + np.repeat(before - cuts[:-1], calls)
        yield frame.drop(columns=HELPERS).assign(allowed=total % (self.quota + 1) != 0)

    def close(self) -> None:
        pass


HELPERS = ["key_", "group_", "code_"]


def _answered(stream: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType,
              time_mode: str = "None") -> DataFrame:
    # One text for a key of any type; the NULL key has its own.
    keyed = stream.withColumn("key_", F.to_json(F.struct(F.col(key).alias("key"))))
    keyed = keyed.withColumn("group_", F.pmod(F.xxhash64("key_"), F.lit(GROUPS)))
    return keyed.groupBy("group_").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def _start(spark: SparkSession, answers: DataFrame, out: str, checkpoint: str, available_now: bool
           ) -> StreamingQuery:
    """Append to ``out``. The query takes the kind of its state store from the session when it
    starts; the setting is put back for other queries."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = answers.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start(out)
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def claim_stream(
    stream: DataFrame, key: str, ts: str, tie: str, out: str, checkpoint: str,
    ttl_seconds: int = TTL_SECONDS, late: str = "1 day", available_now: bool = True,
) -> StreamingQuery:
    """Append every claim with its answer (``claimed``) to ``out``.

    The first claim of a key is accepted, then the first that comes at least ``ttl_seconds``
    after the last accepted one. Claims of one batch are taken in (``ts``, ``tie``) order,
    and a batch may hold older claims than the one before. A claim without key or time
    is refused. The state of a key is dropped once the newest time seen is ``late`` and at most
    a day more past the end of its claim, so the state holds live keys only. No claim is dropped,
    but one that comes still later counts as the first of its key. The claims of one key, and of
    a 256th of all keys, in one batch must fit into a task: bound the batch at its source.
    """
    moment = F.col(ts).cast("timestamp")
    micros = F.when(F.col(key).isNotNull(), F.unix_micros(moment))
    stamped = stream.withColumn("micros_", micros).withColumn("clock_", moment)
    # The clock of the timers; without its column on the rows none is filtered for being late.
    stamped = stamped.withWatermark("clock_", late).drop("clock_")
    schema = T.StructType([*stream.schema.fields, T.StructField("claimed", T.BooleanType())])
    answers = _answered(stamped, key, ClaimProcessor(["micros_", tie], ttl_seconds), schema, "EventTime")
    return _start(stream.sparkSession, answers, out, checkpoint, available_now)


def quota_stream(
    stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str, quota: int = QUOTA,
    available_now: bool = True,
) -> StreamingQuery:
    """Append every call with its answer (``allowed``) to ``out``.

    ``quota`` calls per key pass, the next is refused and starts the count again. Calls of
    one batch are taken in ``order``; the calls of one key, and of a 256th of all keys, in one
    batch must fit into a task. NULL is a key like any other.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("allowed", T.BooleanType())])
    answers = _answered(stream, key, QuotaProcessor(list(order), quota), schema)
    return _start(stream.sparkSession, answers, out, checkpoint, available_now)


def claims_at_least_apart(stream: DataFrame, key: str, ts: str, ttl: str = "30 days"
                          ) -> DataFrame:
    """Built-in variant: a key stays taken for at least ``ttl`` and at most two of them,
    counted in event time. ``ts`` must be a TIMESTAMP."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
