"""Streams replayed in several batches give what the batch operators give."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from forumlake.operators import numbering, registry
from forumlake.schemas import UNIQUE_KEYS
from forumlake.sources import feeds, logs
from forumlake.streaming import ingest, state, windows

SCHEMA = "key string, ts timestamp_ntz, id bigint, value double"
DAY0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def landing(spark, tmp_path):
    """Events in time order, split over six files that arrive one after the other."""
    rnd = random.Random(11)
    times = sorted(rnd.randrange(0, 100 * 24) for _ in range(300))
    events = [
        (rnd.choice(["hot", "hot", "hot", "a", "b"]), DAY0 + dt.timedelta(hours=h), i, i / 4)
        for i, h in enumerate(times)
    ]
    path = tmp_path / "landing"
    for n in range(6):
        part = spark.createDataFrame(events[n * 50:(n + 1) * 50], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path), spark.createDataFrame(events, SCHEMA)


def stream(spark, path):
    return ingest.stream_parquet(spark, path, "*.parquet", SCHEMA, files_per_trigger=1)


def states(query):
    """Keys held and rows put into the state, by micro-batch that had input."""
    return [(p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsUpdated"])
            for p in query.recentProgress if p["numInputRows"]]


def test_claims(spark, landing, tmp_path, rows):
    path, events = landing
    out = str(tmp_path / "out")
    query = state.claim_stream(
        stream(spark, path), "key", "ts", "id", out + "/rows", out + "/ckpt",
        ttl_seconds=30 * 86400)
    query.awaitTermination()
    assert len(states(query)) == 6
    got = spark.read.parquet(out + "/rows").select("id", "claimed")
    expected = registry.claim_flags(events, "key", "ts", "id", None, 30 * 86400)
    assert rows(got) == rows(expected.select("id", "claimed"))


def test_claims_without_key_or_time(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = [(None, DAY0, 1, 0.0), ("k", None, 2, 0.0), ("k", DAY0, 3, 0.0), ("k", DAY0, 4, 0.0)]
    spark.createDataFrame(part, SCHEMA).write.parquet(path)
    state.claim_stream(stream(spark, path), "key", "ts", "id", out + "/rows", out + "/ckpt").awaitTermination()
    got = {r["id"]: r["claimed"] for r in spark.read.parquet(out + "/rows").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_claims_that_ended_leave_the_state(spark, tmp_path):
    """Each batch claims keys of its own, long after the claims of the batch before have ended."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(5):
        part = [(f"k{n}-{i}", DAY0 + dt.timedelta(days=100 * n), n * 10 + i, 0.0) for i in range(10)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    query = state.claim_stream(stream(spark, path), "key", "ts", "id", out + "/rows", out + "/ckpt")
    query.awaitTermination()
    totals = [total for total, _ in states(query)]
    assert len(totals) == 5 and totals[-1] <= 3 * totals[0]
    assert spark.read.parquet(out + "/rows").where("claimed").count() == 50


def test_quota(spark, landing, tmp_path, rows):
    path, events = landing
    out = str(tmp_path / "out")
    query = state.quota_stream(
        stream(spark, path), "key", ["ts", "id"], out + "/rows", out + "/ckpt")
    query.awaitTermination()
    assert len(states(query)) == 6 and all(total <= 3 for total, _ in states(query))
    got = spark.read.parquet(out + "/rows").select("id", "allowed")
    expected = numbering.quota_flags(events, "key", ["ts", "id"]).select("id", "allowed")
    assert rows(got) == rows(expected)


def test_only_the_counters_of_a_batch_are_written(spark, tmp_path):
    """A batch of one key among many leaves the other counters alone."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(f"k{i}", DAY0, i, 0.0) for i in range(200)]
    for part in (first, *([("k0", DAY0, 1000 + n, 0.0)] for n in range(4))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    query = state.quota_stream(stream(spark, path), "key", ["ts", "id"], out + "/rows", out + "/ckpt")
    query.awaitTermination()
    assert states(query) == [(200, 200), *[(200, 1)] * 4]


def test_restart_goes_on_from_the_state(spark, landing, tmp_path, rows):
    path, events = landing
    out = str(tmp_path / "out")

    def run():
        state.quota_stream(stream(spark, path), "key", ["ts", "id"], out + "/rows",
                           out + "/ckpt").awaitTermination()

    run()
    later = [("a", DAY0 + dt.timedelta(days=200 + i), 1000 + i, 0.0) for i in range(13)]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    run()
    everything = events.unionByName(spark.createDataFrame(later, SCHEMA))
    expected = numbering.quota_flags(everything, "key", ["ts", "id"]).select("id", "allowed")
    assert rows(spark.read.parquet(out + "/rows").select("id", "allowed")) == rows(expected)


def test_feed_adds_unseen_posts_only(spark, tmp_path, rows):
    landing = tmp_path / "feed"
    landing.mkdir()

    def post(i, author, title):
        return json.dumps({"id": f"p{i}", "title": title, "created_utc": 1.0 + i,
                           "subreddit": {"display_name": "s"}, "author": {"name": author}})

    def run():
        ingest.insert_ignore_stream(
            feeds.post_rows(feeds.stream_records(spark, "posts", str(landing), 1)),
            str(tmp_path / "posts"), UNIQUE_KEYS["posts"], ["post_created_utc", "post_title"],
            str(tmp_path / "ckpt"), "post_author").awaitTermination()

    (landing / "1.json").write_text("\n".join([post(1, "bob", "a"), post(2, "AutoModerator", "b")]))
    run()
    (landing / "2.json").write_text("\n".join([post(1, "bob", "z"), post(3, "eve", "c")]))
    run()
    got = spark.read.parquet(str(tmp_path / "posts"))
    assert rows(got, "post_id", "post_title") == [("p1", "a"), ("p3", "c")]


def test_logs_and_rejects(spark, tmp_path):
    landing = tmp_path / "logs"
    landing.mkdir()
    (landing / "1.log").write_text('{"a":1}\n{bad\n')
    (landing / "2.log").write_text('{"a":2}\n')
    out = str(tmp_path / "out")
    lines = ingest.stream_lines(spark, str(landing), 1)
    ingest.service_log_stream(lines, "h", "svc", out + "/lines", out + "/ckpt").awaitTermination()
    schema = logs.sorted_lines(lines, F.lit("h"), "svc", F.lit("i"), F.col("ts")).schema
    rows, bad = (logs.stored_lines(spark, out + "/lines", schema, r).collect() for r in (False, True))
    assert sorted(r["message"] for r in rows) == ['{"a":1}', '{"a":2}']
    assert {(r["host_name"], r["service_name"]) for r in rows} == {("h", "svc")}
    assert [(r["item_type"], r["error"]) for r in bad] == [("service_log", "malformed line: {bad")]


def test_days_are_final_once(spark, tmp_path):
    """Days come out when the clock is an hour past them; what comes later is set aside."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    hours = [[1, 2, 23], [25, 24.5], [26, 5, 50], [3, 27, 74], [None, 100]]
    for n, batch in enumerate(hours):
        part = [("k", h if h is None else DAY0 + dt.timedelta(hours=h), n * 10 + i, 1.0) for i, h in enumerate(batch)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    query = windows.final_days(stream(spark, path), "ts", {"n": F.lit(1), "total": F.col("value")}, out, out + "/ckpt", 3600)
    query.awaitTermination()
    final = {(r["date"].day, r["n"], r["total"]) for r in spark.read.parquet(out + "/final").collect()}
    # Hour 25 closes the first day; hours 5 and 3 come after it, hour 27 after the second was closed.
    assert final == {(1, 3, 3.0), (2, 3, 3.0), (3, 1, 1.0), (4, 1, 1.0)}
    late = [r["ts"] and (r["ts"] - DAY0).total_seconds() / 3600 for r in spark.read.parquet(out + "/late").collect()]
    assert sorted(late, key=repr) == sorted([5.0, 3.0, 27.0, None], key=repr)
    open_ = spark.read.parquet(out + "/open/batch=4/days").collect()
    assert [(r["date"].day, r["n"]) for r in open_] == [(5, 1)]


def test_days_stay_current(spark, landing, tmp_path, rows):
    path, events = landing
    out = str(tmp_path / "days")
    columns = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    windows.keep_current(
        windows.daily(stream(spark, path), "ts", *columns), out, str(tmp_path / "ckpt")
    ).awaitTermination()
    expected = events.groupBy(F.to_date("ts").alias("date")).agg(*columns)
    assert rows(spark.read.parquet(out)) == rows(expected)
    assert rows(windows.daily(events, "ts", *columns)) == rows(expected)


def test_built_in_variant_keeps_claims_apart(spark, landing, tmp_path):
    path, events = landing
    claims = state.claims_at_least_apart(
        stream(spark, path).withColumn("at", F.col("ts").cast("timestamp")), "key", "at", "30 days")
    query = claims.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema("key string, at timestamp").parquet(str(tmp_path / "o")).collect()
    times = {}
    for r in sorted(got, key=lambda r: r["at"]):
        if r["key"] in times:
            assert r["at"] - times[r["key"]] >= dt.timedelta(days=30)
        times[r["key"]] = r["at"]
    assert set(times) == {"hot", "a", "b"}


def test_claims_that_come_late(spark, tmp_path):
    """A batch may hold older claims than the one before it."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [[0, 40], [35, 75], [69, 70, 105]]
    for n, batch in enumerate(days):
        part = [("k", DAY0 + dt.timedelta(days=d), n * 10 + i, 0.0) for i, d in enumerate(batch)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        state.claim_stream(stream(spark, path), "key", "ts", "id", out + "/rows", out + "/ckpt",
                           ttl_seconds=30 * 86400).awaitTermination()
    got = spark.read.parquet(out + "/rows").filter("claimed").collect()
    assert sorted((r["ts"] - DAY0).days for r in got) == [0, 40, 75, 105]


class MapInMemory(dict):
    """What a processor asks of the state store, and how often rows of it were written."""

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_one_call_answers_all_keys_of_a_group():
    """Rows of several keys, in two frames and out of order, with counters from batches before."""
    quota = state.QuotaProcessor(["id"], 2)
    quota.count = MapInMemory({("a",): (2,)})
    frames = [pd.DataFrame({"key_": keys, "group_": 0, "id": ids}) for keys, ids in ((["b", "a"], [3, 5]), (["a", "b"], [1, 2]))]
    got = pd.concat(quota.handleInputRows((0,), iter(frames), None))
    assert dict(zip(got["id"], got["allowed"])) == {1: False, 5: True, 2: True, 3: True}
    assert quota.count == {("a",): (1,), ("b",): (2,)} and list(got) == ["id", "allowed"]


def test_keys_of_any_type_and_null(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = [(k, DAY0, i, 0.0) for i, k in enumerate([None, 1, None, 2, 1] * 5)]
    spark.createDataFrame(part, "key int, ts timestamp_ntz, id bigint, value double").coalesce(1).write.parquet(path)
    rows = ingest.stream_parquet(spark, path, "*.parquet", "key int, ts timestamp_ntz, id bigint, value double", files_per_trigger=1)
    state.quota_stream(rows, "key", ["id"], out + "/rows", out + "/ckpt", 4).awaitTermination()
    refused = [tuple(r) for r in spark.read.parquet(out + "/rows").where("NOT allowed").select("key", "id").collect()]
    assert sorted(refused, key=repr) == [(1, 11), (1, 24), (2, 23), (None, 10), (None, 22)]
