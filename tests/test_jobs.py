"""The jobs one after the other, on landing files made by hand."""

import json

from pyspark.sql import functions as F

from forumlake.plans import jobs
from forumlake.sources import feeds
from forumlake.sources.tables import read_table


def at(day):
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def land(folder, name, records):
    path = folder / name
    path.mkdir()
    (path / "1.json").write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def post(i, body, author="bob"):
    return {"id": f"p{i}", "title": f"title {i} ", "selftext": body, "created_utc": 1.0 * i,
            "subreddit": {"display_name": "s"}, "author": author and {"name": author}}


def comment(i, parent, body="hello there"):
    return {"id": f"c{i}", "parent_id": parent, "body": body, "created_utc": 1.0 * i,
            "edited": False, "submission": {"id": "p1"}, "subreddit": {"display_name": "s"},
            "author": {"name": "eve"}}


def test_from_feed_to_documents(spark, tmp_path, rows):
    now, later, much_later = at("2024-02-01"), at("2024-02-02"), at("2024-03-05")
    base = str(tmp_path / "lake")
    posts = feeds.read_records(spark, "posts", land(tmp_path, "posts", [
        post(1, "english text"), post(2, "[removed]"), post(3, "texte"), post(1, "copy"),
        post(4, "spam", "AutoModerator")]))
    comments = feeds.read_records(spark, "comments", land(tmp_path, "comments", [
        comment(1, "t3_p1"), comment(2, "t1_c1"), comment(3, "t1_c1", "[deleted]")]))
    authors = feeds.read_records(spark, "authors", land(tmp_path, "authors", [
        {"id": "t2_b", "name": "bob", "created_utc": 5.5}]))
    for _ in range(2):  # the second run adds nothing
        jobs.collect(spark, base, posts, comments, authors, now)
    assert read_table(spark, "posts", base).count() == 4
    assert read_table(spark, "comments", base).count() == 3
    tree = read_table(spark, "parent_child_tree_data", base).collect()
    assert [json.loads(r["parent_child_tree"]) for r in tree] == [{"c1": ["c2", "c3"]}]

    def languages(texts):
        return texts.select("id", F.when(F.col("id") == "p3", "fr").otherwise("en").alias("lang"))

    prompts = jobs.claim_and_prompt(spark, base, "post", ["phi4", "gemma2"], now, languages)
    assert rows(prompts, "reference_id", "llm_pos") == [
        ("p1", 0), ("p1", 1), ("p4", 0), ("p4", 1)]
    assert prompts.filter("reference_id = 'p1'").first()["prompt"].startswith(
        "respond to this post title and post body: title 1 ")
    # Claimed items are not given out again before the claim expires.
    assert jobs.claim_and_prompt(spark, base, "post", ["phi4"], later).count() == 0
    assert jobs.claim_and_prompt(spark, base, "comment", ["phi4"], later).count() == 2

    answers = spark.createDataFrame(
        [("p1", "post", llm, pos, (f"answer {pos}",), 8, 4_000_000_000, 1.0, 3.5,
          "2024-02-01 00:00:00", "0.4.0") for pos, llm in enumerate(["phi4", "gemma2"])],
        "reference_id string, category string, llm string, llm_pos int, "
        "message struct<content:string>, eval_count bigint, eval_duration bigint, "
        "start_time double, end_time double, ts string, ollama_ver string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    models = spark.createDataFrame(
        [("gemma2:latest", "gemma2", 9, ("f",), "2024-02-01", 1)],
        "name string, model string, size bigint, details struct<family:string>, "
        "expires_at string, size_vram bigint").withColumn(
        "expires_at", F.col("expires_at").cast("timestamp"))
    for _ in range(2):
        jobs.store_answers(spark, base, answers, models, created_at=now)
    stored = read_table(spark, "analysis_documents", base).collect()
    assert len(stored) == 1
    assert json.loads(stored[0]["analysis_document"]) == {
        "schema_version": "4", "source": "reddit", "category": "post", "reference_id": "p1",
        "llm": "gemma2", "analysis": "answer 1"}
    assert [r["id"] for r in stored] == [1]
    named = spark.read.parquet(base + "/analysis_documents").select("reference_id", "category", "llm")
    assert rows(named) == [("p1", "post", "gemma2")]
    # A repeated run adds neither documents nor performance rows; another answer goes on counting.
    speed = spark.read.parquet(base + "/prompt_completion_details").collect()
    assert [(r["name"], r["tokens_per_second"], r["prompt_completion_time"]) for r in speed] == [
        ("gemma2:latest", 2.0, 2)]
    other = answers.withColumn("message", F.struct(F.lit("another").alias("content"))).withColumn(
        "reference_id", F.lit("p9"))
    jobs.store_answers(spark, base, other, models, created_at=now)
    for name in ("analysis_documents", "prompt_completion_details"):
        assert rows(spark.read.parquet(f"{base}/{name}"), "id") == [(1,), (2,)]
    # After 30 days only posts without a document come up again.
    again = jobs.claim_and_prompt(spark, base, "post", ["phi4"], much_later)
    assert rows(again, "reference_id") == [("p3",), ("p4",)]

    out = str(tmp_path / "clean")
    jobs.purge(spark, base, out)
    assert rows(spark.read.parquet(out + "/posts"), "post_id") == [("p1",), ("p2",), ("p3",)]
    assert rows(jobs.subscribe_new(spark, base, now)) == [("1706745600", "s")]


def test_refresh_takes_the_last_count(spark, tmp_path):
    from forumlake.schemas import TABLES

    base, out = str(tmp_path / "base"), str(tmp_path / "out")
    posts = spark.createDataFrame([], TABLES["posts"])
    names = ["post_id", "post_upvote_count"]
    rows = spark.createDataFrame([("a", 500), ("b", 5)], "post_id string, post_upvote_count int")
    posts.unionByName(rows, allowMissingColumns=True).write.parquet(f"{base}/posts")
    updates = spark.createDataFrame([("a", 400, 1), ("a", 300, 2)], "post_id string, post_upvote_count int, at int")
    jobs.refresh_upvotes(spark, base, updates, out, ["at"])
    got = spark.read.parquet(f"{out}/posts").select(*names).collect()
    assert sorted(map(tuple, got)) == [("a", 300), ("b", 5)]
