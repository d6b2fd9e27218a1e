"""What the physical plans must look like, with broadcasting by size switched off."""

import contextlib
import io
import os

import pytest

from forumlake.operators import enrichment, joins
from forumlake.plans import dashboard
from forumlake.plans.catalog import QUERIES
from forumlake.schemas import TABLES
from forumlake.sources.tables import read_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STREAMS = {"claim_stream", "quota_stream", "feed_stream", "service_log_stream", "daily_window",
           "final_documents", "final_tokens"}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("lake"))
    for name, ddl in TABLES.items():
        spark.createDataFrame([], ddl).write.parquet(f"{base}/{name}")
    return {name: read_table(spark, name, base) for name in TABLES}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_no_nested_loops(spark, no_auto_broadcast, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_day_range_and_columns_reach_the_scan(lake):
    text = plan(dashboard.completions_per_day(lake["analysis_documents"]))
    assert "GreaterThanOrEqual(timestamp,2024-08-22" in text
    assert "LessThan(timestamp,2024-09-07" in text
    assert "shasum_512" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_votes_reach_the_scan_and_top_k_needs_no_sort(lake):
    text = plan(dashboard.top10_posts(lake["posts"]))
    assert "GreaterThan(post_upvote_count,100)" in text
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "post_body" not in text


def test_recent_posts_are_cut_before_the_shuffle(lake, no_auto_broadcast):
    text = plan(dashboard.recent10_per_subreddit(lake["posts"]))
    assert text.count("WindowGroupLimit") >= 2
    assert "In(subreddit, [Libertarian,Republican,democrats])" in text
    assert text.count("Exchange") == 2  # the tree line and the detail of one exchange


def test_remaining_has_no_join(lake, no_auto_broadcast):
    text = plan(dashboard.remaining_to_analyze(
        lake["posts"], lake["comments"], lake["analysis_documents"]))
    assert "Join" not in text


def test_averages_shuffle_once_per_level(lake):
    text = plan(dashboard.avg_tps_by_model(lake["prompt_completion_details"]))
    assert text.count("hashpartitioning") == 1


def test_anti_join_shares_the_shuffle_of_distinct(lake, no_auto_broadcast):
    text = plan(enrichment.unanalyzed_posts(lake["posts"], lake["analysis_documents"]))
    assert "LeftAnti" in text and text.count("hashpartitioning") == 2


def test_stored_ids_leave_the_documents_unread(lake, no_auto_broadcast):
    stored = joins.with_id_columns(lake["analysis_documents"]).drop("analysis_document")
    assert "analysis_document" not in stored.columns
    text = plan(enrichment.unanalyzed_posts(lake["posts"], stored))
    assert "LeftAnti" in text


def test_counts_come_from_the_footers(spark, tmp_path):
    from forumlake.operators import dml
    from forumlake.sources.tables import footer_table

    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS body").repartition(3).write.parquet(path)
    table = footer_table(spark, path)
    counted = dml.count_rows({"t": table, "view": table.selectExpr("concat(body, 'x') AS y")})
    text = plan(counted)
    assert text.count("PushedAggregation: [COUNT(*)]") == 2
    assert sorted(map(tuple, counted.collect())) == [("t", 1000), ("view", 1000)]


def test_log_lines_are_read_and_parsed_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from forumlake.sources import logs

    path = str(tmp_path / "t")
    spark.createDataFrame([('{"a":1}',), ("{bad",)], "line string").write.parquet(path)
    lines = spark.read.parquet(path).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    found = logs.sorted_lines(lines, F.lit("h"), "s", "line", F.col("ts"))
    assert plan(found).count("Scan parquet") == 2  # the tree line and the detail of one scan


def test_bundles_of_stored_ids_parse_no_json(lake, no_auto_broadcast):
    from forumlake.plans import service

    stored = joins.with_id_columns(lake["analysis_documents"])
    named = stored.select("id", "analysis_document", "reference_id", "category", "llm")
    frame = named.sparkSession.createDataFrame([], named.schema)
    text = plan(service.bundles(lake["posts"], lake["comments"], frame))
    assert "json_tuple" not in text and "LeftSemi" in text


def test_a_batch_reads_its_own_folders_of_the_target(spark, tmp_path):
    from pyspark.sql import functions as F

    from forumlake.operators import dml

    path = str(tmp_path / "t")
    rows = spark.range(2000).selectExpr("concat('k', id) AS k", "id AS v")
    dml.append_ignore(spark, path, rows, [["k"]], ["v"])
    column = dml.bucket_column(spark, path)
    assert column == "key64"
    batch = spark.createDataFrame([("k7", 1), ("new", 2), ("new", 3)], "k string, v bigint")
    staged = batch.select("*", dml.bucket(["k"], column))
    held = dml.touched_rows(spark, path, staged, ["k"], column)
    line = next(x for x in plan(held).splitlines() if "PartitionFilters" in x)
    assert f"{column}" in line and "IN (" in line
    assert 0 < len(held.inputFiles()) and held.count() < 200
    for _ in range(2):
        dml.append_ignore(spark, path, batch, [["k"]], ["v"])
    got = spark.read.parquet(path)
    assert got.count() == 2001 and got.where("k = 'new'").first()["v"] == 2
    assert got.groupBy("k").count().where("count > 1").count() == 0
    # Only folders with many files are put together.
    for n in range(3):
        dml.append_ignore(spark, path, spark.createDataFrame([(f"x{n}", n)], "k string, v bigint"), [["k"]], ["v"])
    before = got.count() + 3
    full = dml.compact(spark, path, column, most_files=1)
    assert full and len(full) < 64
    after = spark.read.parquet(path)
    assert after.count() == before == 2004 and after.where(F.col(column).isin(full)).count() > 0
