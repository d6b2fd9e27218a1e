"""Large posts are one row unless the caller asks for pieces."""

import json

from forumlake.operators import trees
from forumlake.plans import service

N = 10_500


def comments(spark):
    data = [("p", f"c{i:05}", "t3_p" if i == 0 else f"t1_c{i // 3:05}" if i % 2 else "t1_c00000", i, f"b{i}")
            for i in range(N)]
    return data, spark.createDataFrame(
        data, "post_id string, comment_id string, parent_id string, comment_created_utc int, comment_body string")


def test_large_tree_is_one_document(spark):
    data, frame = comments(spark)
    want = {}
    for _, child, parent, _, _ in data[1:]:
        want.setdefault(parent[3:], []).append(child)
    text = json.dumps(want, separators=(",", ":"))
    got = trees.comment_trees(frame).collect()
    assert [(r["post_id"], r["piece"], r["parent_child_tree"]) for r in got] == [("p", 0, text)]
    assert len(trees.comment_trees(frame, size=10_000).collect()) == 2


def test_large_bundle_is_one_row(spark):
    _, frame = comments(spark)
    posts = spark.createDataFrame([("p", "s", "title", "body")], "post_id string, subreddit string, post_title string, post_body string")
    documents = spark.createDataFrame(
        [(i, json.dumps({"reference_id": "p", "category": "post", "llm": "phi4", "n": i})) for i in range(3)],
        "id long, analysis_document string")
    got = service.bundles(posts, frame, documents).collect()
    assert [(r["piece"], r["comment_bodies"]) for r in got] == [(0, [f"b{i}" for i in range(N)])]
    assert got[0]["analysis_docs"].count("reference_id") == 3
    assert len(service.post_bundle(posts, frame, documents).collect()) == 1
    assert len(service.bundles(posts, frame, documents, size=1_000).collect()) == 11
