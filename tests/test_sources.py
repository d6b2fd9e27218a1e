"""Records, logs, price lists, catalog and parameterised queries."""

import json

import pytest
from pyspark.sql import functions as F

from forumlake.functions import sql_functions
from forumlake.schemas import TABLES
from forumlake.sources import feeds, logs, tables


def write_lines(folder, lines):
    folder.mkdir()
    (folder / "part.json").write_text("\n".join(lines))
    return str(folder)


def test_post_records(spark, tmp_path):
    post = {"id": "p1", "title": "t", "selftext": "b", "created_utc": 1704067200.9,
            "is_original_content": True, "is_video": False, "ups": 5, "downs": 0,
            "subreddit_subscribers": 9, "subreddit": {"display_name": "s"},
            "author": {"name": "bob"}}
    path = write_lines(tmp_path / "posts", [
        json.dumps(post), json.dumps({**post, "id": "p2", "author": None})])
    got = feeds.post_rows(feeds.read_records(spark, "posts", path)).orderBy("post_id").collect()
    assert [r["post_author"] for r in got] == ["bob", None]
    assert got[0]["post_created_utc"] == 1704067200
    assert set(got[0].asDict()) == {c.split()[0] for c in TABLES["posts"].split(", ")}


def test_comment_records(spark, tmp_path):
    c = {"id": "c1", "parent_id": "t3_p1", "body": "b", "created_utc": 1704067200.9, "ups": 1,
         "downs": 0, "submission": {"id": "p1"}, "subreddit": {"display_name": "s"},
         "author": {"name": "bob"}}
    path = write_lines(tmp_path / "comments", [
        json.dumps({**c, "edited": False, "is_submitter": True}),
        json.dumps({**c, "id": "c2", "edited": 1704070000.0}),
        json.dumps({**c, "id": "c3", "edited": 1704070000, "author": None})])
    got = feeds.comment_rows(feeds.read_records(spark, "comments", path)).orderBy(
        "comment_id").collect()
    assert [r["is_comment_edited"] for r in got] == ["false", "1704070000", "1704070000"]
    assert [r["is_comment_submitter"] for r in got] == [True, None, None]
    assert [r["comment_author"] for r in got] == ["bob", "bob", None]


def test_websearch_rows_count_from_one(spark, tmp_path):
    path = write_lines(tmp_path / "web", [json.dumps(
        {"source": "s", "post_id": "p", "lookup_text": "q",
         "results": [{"title": "a", "href": "x"}, {"title": "b"}]})])
    got = feeds.websearch_rows(feeds.read_records(spark, "websearch", path)).collect()
    assert [(r["result_no"], json.loads(r["websearch_result"])) for r in got] == [
        (1, {"title": "a", "href": "x"}), (2, {"title": "b"})]


def test_price_sections(spark, rows):
    price_list = {
        "embeddings": {"e": 0.1},
        "images": {"i": {"standard": {"1x1": 0.2, "2x2": 0.3}, "hd": {"1x1": 0.4}}},
        "audio": {"a": 0.5},
        "chat": {"c": {"promptPrice": 0.6, "completionPrice": 0.7}},
    }
    df = spark.createDataFrame([(json.dumps(price_list),), ('{"audio": {"b": 1}}',)], "value string")
    assert rows(feeds.price_rows(df)) == sorted([
        ("embeddings", "e", None, None, 0.1), ("images", "i", "standard", "1x1", 0.2),
        ("images", "i", "standard", "2x2", 0.3), ("images", "i", "hd", "1x1", 0.4),
        ("audio", "a", None, None, 0.5), ("chat", "c", None, "prompt", 0.6),
        ("chat", "c", None, "completion", 0.7), ("audio", "b", None, None, 1.0)], key=repr)


def test_log_lines(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", '{"a":1}'), (2, "2024-01-01 00:09:00", "{bad"),
         (3, "2024-01-01 00:20:00", '"text"')], "n int, t string, line string"
    ).select("n", F.col("t").cast("timestamp").alias("ts"), "line")
    good = logs.service_log_rows(df, F.lit("h"), "svc").collect()
    assert sorted(r["message"] for r in good) == ['"text"', '{"a":1}']
    bad = logs.rejected_lines(df, "n", F.col("ts")).collect()
    assert [(r["item_id"], r["item_type"]) for r in bad] == [("2", "service_log")]
    as_of = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert sorted(r["n"] for r in logs.recent_lines(df, as_of).collect()) == [1, 2]


def test_program_log_row(spark):
    df = spark.range(1).withColumn("ts", F.lit("2024-01-01 00:00:07").cast("timestamp"))
    row = logs.program_log_rows(
        df, F.lit("h"), F.lit("p"), F.lit("0.1.2"), F.lit("INFO"), F.lit("hello"), "ts").first()
    assert json.loads(row["log_json"]) == {
        "timestamp": "2024-01-01 00:00:07+00:00", "host": "h", "program_name": "p",
        "program_version": "0.1.2", "severity": "INFO", "message": "hello"}


def test_select_returns_rows_and_other_text_true(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert tables.select_rows(spark, "SELECT id FROM five WHERE id > :x", {"x": 2}).count() == 2
    assert tables.select_rows(spark, "  select id FROM five WHERE id > ?", [3]).count() == 1
    assert tables.select_rows(spark, "WITH t AS (SELECT 1) SELECT * FROM t") is True
    assert tables.run_sql(spark, "SELECT 1 AS x").first()["x"] == 1


def test_values_are_bound_not_pasted(spark):
    spark.createDataFrame([("a",)], "k string").createOrReplaceTempView("one_key")
    got = tables.select_rows(spark, "SELECT * FROM one_key WHERE k = :k", {"k": "x' OR '1'='1"})
    assert got.count() == 0


def test_rows_as_documents(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert tables.as_documents(df).first()[0] == '{"a":1,"b":null}'
    assert tables.pluck(df, "a").columns == ["a"]


@pytest.mark.parametrize("name", sorted(TABLES))
def test_tables_round_trip(spark, tmp_path, name):
    spark.createDataFrame([], TABLES[name]).write.parquet(str(tmp_path / name))
    assert tables.read_table(spark, name, str(tmp_path)).count() == 0


def test_table_names():
    found = {"posts": None, "pg_x": None, "pg": None, "pgab": None, "row_count_history": None}
    assert tables.table_names(found, "row_count_history") == ["posts", "pg"]


def test_sql_functions(spark):
    sql_functions.register(spark)
    row = spark.sql("""SELECT format_width('ab\\ncd', 80) AS f, sanitize_text('x') AS s,
        word_count('a b') AS w, punctuation_count('a.b!') AS p, full_model_name('phi4') AS m,
        format_width('', 80) AS e""").first()
    assert row.asDict() == {"f": "ab", "s": "x", "w": 2, "p": 2, "m": "phi4:latest", "e": None}


def test_bad_records_are_rejected_not_stored(spark, rows):
    lines = spark.createDataFrame(
        [('{"id":"p1","created_utc":1e18}',), ("{bad",), ('{"title":"t"}',), ("[]",)],
        "value string")
    stored = feeds.post_rows(feeds.parse_records(lines, "posts")).collect()
    assert [(r["post_id"], r["post_created_utc"]) for r in stored] == [("p1", None)]
    bad = feeds.rejected_records(lines, "posts", F.lit("2024-01-01").cast("timestamp"))
    assert rows(bad, "error") == [
        ("malformed record: {bad",), ("record without id: []",),
        ('record without id: {"title":"t"}',)]


def test_catalog_leaves_out_temporary_views(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    assert tables.catalog_tables(spark, "default").filter("table_name = 'some_view'").count() == 0
    assert tables.catalog_tables(spark, "default", "posts").columns == ["table_name"]
