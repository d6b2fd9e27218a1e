"""Operators against brute force, with heavy keys forced onto the distributed paths."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forumlake.operators import dml, enrichment, joins, language, numbering, registry, top, trees
from forumlake.plans import dashboard, service
from forumlake.schemas import TABLES, UNIQUE_KEYS

DAY0 = dt.datetime(2024, 1, 1)


def skewed_events(n=600, seed=3):
    """(key, ts, id): one key has most rows, NULL is a key, times repeat."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
        out.append((key, DAY0 + dt.timedelta(hours=rnd.randrange(0, 24 * 120)), i))
    return out


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(skewed_events(), "key string, ts timestamp_ntz, id bigint")


@pytest.fixture(params=["few pieces", "many pieces"])
def pieces(spark, request):
    """Small partitions are put together, or all eight shuffle partitions stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(request.param == "few pieces").lower())
    yield
    spark.conf.set(name, "true")


def test_running_number(events, pieces):
    got = numbering.running_number(events, "key", ["ts", "id"], "n")
    found = {(r["key"], r["id"]): r["n"] for r in got.collect()}
    groups = defaultdict(list)
    for key, ts, i in skewed_events():
        groups[key].append((ts, i))
    expected = {
        (k, i): n for k, rows in groups.items() for n, (_, i) in enumerate(sorted(rows), 1)
    }
    assert found == expected


def test_running_number_descending(events, pieces):
    got = numbering.running_number(events, "key", [F.desc("ts"), F.desc("id")], "n")
    found = {(r["key"], r["id"]): r["n"] for r in got.collect()}
    groups = defaultdict(list)
    for key, ts, i in skewed_events():
        groups[key].append((ts, i))
    for k, rows in groups.items():
        for n, (_, i) in enumerate(sorted(rows, reverse=True), 1):
            assert found[(k, i)] == n


def test_quota_of_one_key(spark):
    calls = spark.range(1, 24).selectExpr("'k' AS key", "id")
    got = numbering.quota_flags(calls, "key", "id")
    assert sorted(r["id"] for r in got.filter("NOT allowed").collect()) == [11, 22]


def quota_by_hand(calls, start):
    state, out = dict(start), {}
    for key, _, i in calls:
        v = state.get(key, 0)
        if v == 10:
            state[key], out[i] = 0, False
        elif v <= 10:
            state[key] = v + 1
            out[i] = v + 1 <= 10
        else:
            out[i] = False
    return out, state


def test_running_number_of_two_keys_and_of_nothing(spark, pieces):
    rows = [(i % 2, None if i % 3 else "x", i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, i int")
    got = {r["i"]: r["n"] for r in numbering.running_number(df, ["a", "b"], "i").collect()}
    seen = defaultdict(int)
    for a, b, i in rows:
        seen[a, b] += 1
        assert got[i] == seen[a, b]
    assert numbering.running_number(df.limit(0), ["a", "b"], "i").count() == 0


def test_quota_with_counters(spark, pieces):
    calls = [e for e in skewed_events() if e[0] is not None]
    calls.sort(key=lambda e: (e[1], e[2]))
    start = {"hot": 10, "a": 11, "b": 4, "idle": 7, "c": -3}
    df = spark.createDataFrame(calls, "key string, ts timestamp_ntz, id bigint")
    counters = spark.createDataFrame(list(start.items()), "key string, value bigint")
    flags = numbering.quota_flags(df, "key", ["ts", "id"], counters)
    answers, state = quota_by_hand(calls, start)
    assert {r["id"]: r["allowed"] for r in flags.collect()} == answers
    after = numbering.quota_counters(df, "key", counters)
    assert {r["key"]: r["value"] for r in after.collect()} == state


def test_batches_of_25(spark):
    for n, expected in {0: 0, 25: 1, 26: 2}.items():
        items = spark.range(n).selectExpr("'k' AS key", "id")
        got = numbering.batch_numbers(items, "key", "id")
        assert got.select("batch_no").distinct().count() == expected


def claims_by_hand(events, ttl, last=None):
    last, out = dict(last or {}), []
    for key, ts, i in sorted((e for e in events if e[0] is not None), key=lambda e: (e[1], e[2])):
        if key not in last or ts >= last[key] + ttl:
            last[key] = ts
            out.append((key, ts, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("days", [0, 1, 7, 30, 200])
def test_claims(events, rows, days, pieces):
    got = registry.claim_keys(events, "key", "ts", "id", None, days * 86400)
    assert rows(got) == claims_by_hand(skewed_events(), dt.timedelta(days=days))


def test_claims_after_a_registry(spark, events, rows, pieces):
    held = {"hot": DAY0 + dt.timedelta(days=3), "a": DAY0 - dt.timedelta(days=29)}
    reg = spark.createDataFrame(list(held.items()), "key string, claimed_at timestamp_ntz")
    got = registry.claim_keys(events, "key", "ts", "id", reg, 30 * 86400)
    assert rows(got) == claims_by_hand(skewed_events(), dt.timedelta(days=30), held)


@pytest.mark.parametrize("days", [1, 20, 60])
def test_registry_of_the_future_and_unknown_keys(spark, events, rows, pieces, days):
    """Claims before the end of a held one are refused, also those that are older than it."""
    held = {"hot": DAY0 + dt.timedelta(days=50), "a": DAY0 + dt.timedelta(days=500), "new": DAY0}
    reg = spark.createDataFrame(list(held.items()), "key string, claimed_at timestamp_ntz")
    got = registry.claim_keys(events, "key", "ts", "id", reg, days * 86400)
    assert rows(got) == claims_by_hand(skewed_events(), dt.timedelta(days=days), held)


def test_claim_flags_answer_every_claim(spark, events, pieces):
    odd = spark.createDataFrame([("hot", None, 9000), (None, None, 9001)], events.schema)
    flags = registry.claim_flags(events.unionByName(odd), "key", "ts", "id", None, 7 * 86400)
    assert flags.columns == [*events.columns, "claimed"]
    won = {i for _, _, i in claims_by_hand(skewed_events(), dt.timedelta(days=7))}
    assert {r["id"]: r["claimed"] for r in flags.collect()} == {
        **{i: i in won for _, _, i in skewed_events()}, 9000: False, 9001: False}
    assert registry.claim_keys(events.limit(0), "key", "ts", "id").count() == 0


@pytest.mark.parametrize("ttl,most", [(3, 25), (100_000, 45)])
def test_a_million_claims_of_one_key(spark, ttl, most):
    """Few jobs, whatever the length of the chain; more where an expiry reaches over pieces."""
    rows = 1_000_000
    claims = spark.range(0, rows, 1, 8).selectExpr("'k' AS key", "timestamp_seconds(pmod(xxhash64(id), 2000000)) AS ts", "id")
    context = spark.sparkContext
    context.setJobGroup("claims", "claims")
    got = sorted(r["claimed_at"].timestamp() for r in registry.claim_keys(claims, "key", "ts", "id", None, ttl).collect())
    context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("claims"))
    want, last = [], None
    for t in sorted(r["ts"].timestamp() for r in claims.select("ts").collect()):
        if last is None or t >= last + ttl:
            want.append(t)
            last = t
    assert got == want and len(want) > 10
    assert jobs <= most


def test_expiry_counts_from_the_accepted_claim(spark):
    days = [0, 40, 41, 110, 115]
    df = spark.createDataFrame([("k", DAY0 + dt.timedelta(days=d), d) for d in days],
                               "key string, ts timestamp, day int")
    flags = registry.claim_flags(df, "key", "ts", "day")
    assert sorted(r["day"] for r in flags.filter("claimed").collect()) == [0, 40, 110]


def test_registry_keys(spark, rows):
    reg = spark.createDataFrame(
        [("post_id_a",), ("post_id_b",), ("comment_id_a",)], "key string")
    assert rows(registry.keys_of(reg, "post_id")) == [("a",), ("b",)]
    members = spark.createDataFrame([("b",), ("c",), ("c",)], "m string")
    assert rows(registry.migrate(members, "m", "post_id", reg)) == [("post_id_c",)]


# --- joins -------------------------------------------------------------------

def test_null_in_subquery_empties_not_in(spark, rows):
    left = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    cases = {
        ("x",): [("y",)],
        ("x", None): [],
        (): [("x",), ("y",), (None,)],
        ("z",): [("x",), ("y",)],
    }
    for right, expected in cases.items():
        r = spark.createDataFrame([(v,) for v in right], "r string")
        got = rows(joins.not_in(left, "k", r, "r"))
        assert got == sorted(expected, key=repr)
        left.createOrReplaceTempView("l_")
        r.createOrReplaceTempView("r_")
        by_sql = rows(spark.sql("SELECT k FROM l_ WHERE k NOT IN (SELECT r FROM r_)"))
        assert got == by_sql


def test_null_authors_do_not_join(spark):
    posts = spark.createDataFrame([("p1", None, "x")], "post_id string, post_author string, post_body string")
    posts = posts.selectExpr("*", "'t' AS post_title", "1 AS post_created_utc")
    comments = spark.createDataFrame([("c1", None)], "comment_id string, comment_author string")
    comments = comments.selectExpr("*", "'b' AS comment_body", "1 AS comment_created_utc")
    assert dashboard.author_posts_comments(posts, comments).count() == 0


def test_either_document_key_excludes(spark, rows):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "comment_id string")
    documents = spark.createDataFrame(
        [('{"comment_id":"a"}',), ('{"reference_id":"b"}',), ('{"other":"c"}',),
         ('{"comment_id":null,"reference_id":null}',)], "analysis_document string")
    got = joins.without_documents(items, "comment_id", documents, enrichment.COMMENT_FIELDS)
    assert rows(got) == [("c",)]


def test_or_anti_join_equals_key_union(spark, rows):
    rnd = random.Random(1)
    for _ in range(5):
        items = spark.createDataFrame(
            [(f"i{n}",) for n in range(20)], "comment_id string")
        made = []
        for _ in range(15):
            key = rnd.choice(["comment_id", "reference_id", "post_id"])
            made.append((f'{{"{key}":"i{rnd.randrange(25)}"}}',))
        documents = spark.createDataFrame(made, "analysis_document string")
        items.createOrReplaceTempView("items_")
        documents.createOrReplaceTempView("docs_")
        expected = spark.sql("""
            SELECT comment_id FROM items_ LEFT JOIN docs_
              ON get_json_object(analysis_document, '$.comment_id') = comment_id
              OR get_json_object(analysis_document, '$.reference_id') = comment_id
            WHERE analysis_document IS NULL""")
        got = joins.without_documents(items, "comment_id", documents, enrichment.COMMENT_FIELDS)
        assert rows(got) == rows(expected)


def test_counts_on_empty_input(spark):
    posts = spark.createDataFrame([], TABLES["posts"])
    comments = spark.createDataFrame([], TABLES["comments"])
    documents = spark.createDataFrame([], TABLES["analysis_documents"])
    got = dashboard.remaining_to_analyze(posts, comments, documents).collect()
    assert {(r["label"], r["count"]) for r in got} == {("comments", 0), ("posts", 0)}


# --- DML ---------------------------------------------------------------------

def test_target_row_wins_then_first_of_batch(spark, rows):
    target = spark.createDataFrame([("a", "old")], "post_id string, body string")
    batch = spark.createDataFrame(
        [("a", "new", 1), ("b", "second", 3), ("b", "first", 2)],
        "post_id string, body string, no int")
    new = dml.rows_to_insert(target, batch, [["post_id"]], ["no"])
    assert rows(target.unionByName(new.drop("no"))) == [("a", "old"), ("b", "first")]


def test_no_unique_key_keeps_both(spark):
    target = spark.createDataFrame([("1", "x")], TABLES["subscription"])
    batch = spark.createDataFrame([("1", "x"), ("1", "x")], TABLES["subscription"])
    assert dml.insert_ignore(target, batch, UNIQUE_KEYS["subscription"], []).count() == 3


def test_null_keys_never_conflict(spark):
    target = spark.createDataFrame([(None, 1)], "k string, v int")
    batch = spark.createDataFrame([(None, 2), (None, 3), ("a", 4), ("a", 5)], "k string, v int")
    got = dml.rows_to_insert(target, batch, [["k"]], ["v"])
    assert sorted(r["v"] for r in got.collect()) == [2, 3, 4]


def insert_by_hand(target, batch, keys):
    taken = [{t[k] for t in target if t[k] is not None} for k in keys]
    out = []
    for row in batch:
        if all(row[k] is None or row[k] not in taken[j] for j, k in enumerate(keys)):
            out.append(row)
            for j, k in enumerate(keys):
                if row[k] is not None:
                    taken[j].add(row[k])
    return out


def test_two_unique_keys(spark, rows):
    rnd = random.Random(5)
    for _ in range(4):
        target = [(rnd.randrange(30), f"h{rnd.randrange(30)}", -1 - n) for n in range(4)]
        batch = [
            (rnd.choice([None, *range(20)]), rnd.choice([None, *[f"h{x}" for x in range(20)]]), n)
            for n in range(40)
        ]
        schema = "id int, hash string, no int"
        got = dml.rows_to_insert(
            spark.createDataFrame(target, schema), spark.createDataFrame(batch, schema),
            [["id"], ["hash"]], ["no"])
        assert rows(got) == sorted(insert_by_hand(target, batch, (0, 1)), key=repr)


def test_append_ignore_twice(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    second = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    for batch in (first, first, second, second):
        dml.append_ignore(spark, path, batch, [["k"]], ["v"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 2), ("c", 3)]


def test_a_small_table_is_stored_by_key_once_it_grows(spark, tmp_path, rows):
    path = str(tmp_path / "t")

    def put(*made):
        dml.append_ignore(spark, path, spark.createDataFrame(list(made), "k string, v int"), [["k"]], ["v"])

    put()
    assert rows(spark.read.parquet(path)) == []
    put(("a", 2), ("a", 1), (None, 3))
    assert dml.bucket_column(spark, path) is None
    put(*[(f"k{n}", n) for n in range(61)])  # 63 rows
    assert dml.bucket_column(spark, path) is None
    put(("a", 7), ("z", 8))
    assert dml.bucket_column(spark, path) == "key64"
    put(("z", 9), ("y", 9))
    expected = [("a", 1), (None, 3), ("z", 8), ("y", 9), *[(f"k{n}", n) for n in range(61)]]
    assert rows(spark.read.parquet(path), "k", "v") == sorted(expected, key=repr)

    path = str(tmp_path / "from_empty")
    put()
    put(*[(f"k{n}", n) for n in range(200)])
    put(("k7", 1))
    assert dml.bucket_column(spark, path) == "key64"
    assert rows(spark.read.parquet(path), "k", "v") == sorted([(f"k{n}", n) for n in range(200)], key=repr)


def test_update_by_key(spark, rows):
    target = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    updates = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("b", 7, 1), ("z", 1, 1)],
                                    "k string, v int, no int")
    got = dml.update_by_key(target, updates, "k", "v", ["no"])
    assert rows(got) == [("a", 4), ("b", 7), ("c", 3)]


def test_model_inventory_with_a_name_twice(spark):
    rows = spark.createDataFrame([("m:1",)], "llm string")
    models = spark.createDataFrame([("m:1", 2), ("m:1", 1), ("n:1", 3)], "name string, size int")
    assert [r["size"] for r in joins.with_model(rows, "llm", models).collect()] == [1]


def test_snapshot_export_refuses_to_overwrite(spark, tmp_path):
    tables = {"t": spark.range(5)}
    folder = dml.export_snapshot(tables, str(tmp_path), 1704067200)
    assert folder.endswith("/1704067200") and spark.read.parquet(folder + "/t").count() == 5
    with pytest.raises(Exception):
        dml.export_snapshot(tables, str(tmp_path), 1704067200)


def test_export_is_observed_as_it_is_written(spark, tmp_path):
    import hashlib

    data = [("a", 1, 0.5), (None, 2, None)]
    tables = {"t": spark.createDataFrame(data, "s string, i int, d double"), "empty": spark.createDataFrame([], "s string")}
    folder = dml.export_snapshot(tables, str(tmp_path), 1)
    total = sum(int(hashlib.md5(text.encode()).hexdigest()[:8], 16) for text in ("a|1", "|2"))
    got = {tuple(r) for r in dml.manifest(spark, folder).collect()}
    assert got == {("t", 2, total), ("empty", 0, 0)}


def test_ids_go_on_from_the_stored_ones(spark, rows):
    new = spark.createDataFrame([("c",), ("a",), ("b",)], "k string")
    assert rows(dml.with_ids(None, new, ["k"]), "k", "id") == [("a", 1), ("b", 2), ("c", 3)]
    held = spark.createDataFrame([(7,), (4,)], "id int")
    assert rows(dml.with_ids(held, new, ["k"]), "k", "id") == [("a", 8), ("b", 9), ("c", 10)]


def test_row_count_history(spark, tmp_path):
    path = str(tmp_path / "h")
    tables = {"posts": spark.range(3), "row_count_history": spark.range(9), "pg_x": spark.range(1)}
    for _ in range(2):
        dml.append_row_counts(tables, path)
    got = spark.read.parquet(path)
    assert [(r["table_name"], r["row_count"]) for r in got.collect()] == [("posts", 3)] * 2


# --- trees, bundles, top -----------------------------------------------------

def thread(post, n, seed=0):
    """Comments of one post; most answer the first one."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        parent = f"t3_{post}" if i == 0 else f"t1_{post}c{0 if i % 3 else rnd.randrange(i)}"
        out.append((post, f"{post}c{i}", parent, i // 2))
    return out


COMMENTS = "post_id string, comment_id string, parent_id string, comment_created_utc int"


def tree_by_hand(rows):
    ids = {r[1] for r in rows}
    tree = {}
    for _, child, parent, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        p = parent.split("_")[1]
        if p in ids:
            tree.setdefault(p, []).append(child)
    return tree


@pytest.mark.parametrize("size", [10_000, 7, None])
def test_comment_trees(spark, size, pieces):
    import json

    data = thread("p", 60) + thread("q", 5) + [("r", "rc0", "t3_r", 0), ("s", "sc0", "t1_pc0", 0)]
    got = trees.comment_trees(spark.createDataFrame(data, COMMENTS), size).collect()
    merged = defaultdict(dict)
    for r in sorted(got, key=lambda r: (r["post_id"], r["piece"])):
        tree = json.loads(r["parent_child_tree"])
        assert size is None or sum(len(c) for c in tree.values()) <= size
        for parent, children in tree.items():
            merged[r["post_id"]].setdefault(parent, []).extend(children)
        merged[r["post_id"]]
    for post in "pqrs":
        assert merged[post] == tree_by_hand([d for d in data if d[0] == post])
    if size != 7:
        for r in got:
            own = tree_by_hand([d for d in data if d[0] == r["post_id"]])
            assert r["parent_child_tree"] == json.dumps(own, separators=(",", ":"))


def test_empty_trees_share_one_row(spark):
    data = [("r", "rc0", "t3_r", 0), ("s", "sc0", "t1_rc0", 0)]
    rows = trees.tree_rows(trees.comment_trees(spark.createDataFrame(data, COMMENTS)))
    new = dml.rows_to_insert(rows.limit(0), rows, UNIQUE_KEYS["parent_child_tree_data"], ["post_id"])
    assert [r["parent_child_tree"] for r in new.collect()] == ["{}"]


def test_array_keeps_nulls(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 3, "b")],
                               "k string, o int, v string")
    assert trees.collect_in_pieces(df, ["k"], "v", ["o"], "x").first()["x"] == ["a", None, "b"]
    cut = trees.collect_in_pieces(df, ["k"], "v", ["o"], "x", size=2).collect()
    assert sorted((r["piece"], r["x"]) for r in cut) == [(0, ["a", None]), (1, ["b"])]


def test_bundle_in_pieces_loses_nothing(spark, pieces):
    posts = spark.createDataFrame([("p", "sub", "title", "body")],
                                  "post_id string, subreddit string, post_title string, post_body string")
    comments = spark.createDataFrame(
        [("p", i, f"c{i:03d}", None if i % 7 == 0 else f"text {i}") for i in range(40)],
        "post_id string, comment_created_utc int, comment_id string, comment_body string")
    documents = spark.createDataFrame(
        [(i, f'{{"category":"post","llm":"phi4","reference_id":"p","n":{i}}}') for i in range(3)],
        "id int, analysis_document string")
    whole = service.post_bundle(posts, comments, documents).collect()
    assert len(whole) == 1 and whole[0]["post"] == "title  -  body"
    cut = sorted(service.post_bundle(posts, comments, documents, size=10).collect(),
                 key=lambda r: r["piece"])
    assert len(cut) == 5
    assert sum((r["comment_bodies"] for r in cut), []) == whole[0]["comment_bodies"]
    assert cut[0]["analysis_docs"] == whole[0]["analysis_docs"]


def test_bundle_groups_do_not_depend_on_the_cuts(spark, rows):
    """Two posts with the same comments, one with 6 documents and one with 1."""
    posts = spark.createDataFrame([(p, "sub", p, "body") for p in ("p", "q", "r")],
                                  "post_id string, subreddit string, post_title string, post_body string")
    comments = spark.createDataFrame(
        [(p, i, f"{p}{i:02d}", None if i == 4 else f"text {i}") for p in ("p", "q", "r") for i in range(9 + (p == "r"))],
        "post_id string, comment_created_utc int, comment_id string, comment_body string")
    documents = spark.createDataFrame(
        [(i, f'{{"reference_id":"{"pqr"[max(0, i - 5)]}"}}') for i in range(8)],
        "id int, analysis_document string")
    got = {size: service.bundle_groups(service.bundles(posts, comments, documents, size=size)) for size in (1000, 8)}
    assert sorted(r["posts"] for r in got[1000].collect()) == [1, 2]
    assert rows(got[8]) == rows(got[1000])


def test_top_k_per_group(spark, rows):
    df = spark.range(100).selectExpr("id % 3 AS k", "id")
    got = top.top_k_per_group(df, ["k"], 2, F.desc("id"))
    assert rows(got) == sorted([(0, 99), (0, 96), (1, 97), (1, 94), (2, 98), (2, 95)], key=repr)


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(50)] + [(None,)], "pid string")
    picks = {top.sample_one(df, "pid", s).first()["pid"] for s in range(10)}
    assert len(picks) > 1 and None not in picks
    assert top.sample_one(df, "pid", 1).first() == top.sample_one(df.repartition(5), "pid", 1).first()


# --- averages and tokens -----------------------------------------------------

def test_two_levels_of_averages(spark, rows):
    df = spark.createDataFrame([("m", 1, 10), ("m", 1, 20), ("m", 2, 30)],
                               "model string, id int, prompt_completion_time int")
    assert rows(dashboard.avg_time_by_model(df, id_is_unique=False)) == [("m", 22.5)]
    assert rows(dashboard.avg_time_by_model(df.filter("prompt_completion_time <> 20"))) == [("m", 20.0)]


def test_tokens_need_a_rate(spark, rows):
    df = spark.createDataFrame(
        [(3, None), (3, 0.0), (4, 2.5), (None, 2.0)],
        "prompt_completion_time int, tokens_per_second float"
    ).withColumn("expires_at", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    assert [r["total_tokens"] for r in dashboard.tokens_per_day(df).collect()] == [12.0]


# --- enrichment --------------------------------------------------------------

def answers(spark):
    rows = [
        (ref, cat, llm, pos, (content,), 10, 2_000_000_000, 1.5, 4.4, DAY0, "0.4.0")
        for ref, cat in (("p1", "post"), ("c1", "comment"))
        for pos, (llm, content) in enumerate([("phi4", "A"), ("gemma2:9b", "B")])
    ]
    return spark.createDataFrame(
        rows, "reference_id string, category string, llm string, llm_pos int, "
        "message struct<content:string>, eval_count bigint, eval_duration bigint, "
        "start_time double, end_time double, ts timestamp, ollama_ver string")


def test_posts_keep_the_last_answer_comments_all(spark):
    stored = enrichment.finish_answers(enrichment.stored_answers(answers(spark)))
    got = sorted((r["reference_id"], r["llm"], r["tokens_per_second"], r["prompt_completion_time"])
                 for r in stored.collect())
    assert got == [("c1", "gemma2:9b", 5.0, 2), ("c1", "phi4", 5.0, 2), ("p1", "gemma2:9b", 5.0, 2)]


def test_encrypted_answers_keep_the_plain_hash(spark):
    plain = enrichment.finish_answers(answers(spark)).select("shasum_512").distinct().collect()
    hidden = enrichment.finish_answers(answers(spark), "0123456789abcdef")
    assert sorted(plain) == sorted(hidden.select("shasum_512").distinct().collect())
    assert not {"A", "B"} & {r["analysis"] for r in hidden.collect()}


def test_performance_rows_of_known_models_only(spark):
    models = spark.createDataFrame(
        [("phi4:latest", "phi4", 7, ("f", None), DAY0, 3)],
        "name string, model string, size bigint, details struct<family:string,quant:string>, "
        "expires_at timestamp, size_vram bigint")
    stored = enrichment.finish_answers(enrichment.stored_answers(answers(spark)))
    got = enrichment.performance_rows(stored, models).collect()
    assert [(r["name"], r["ollama_host"], r["details"]) for r in got] == [
        ("phi4:latest", "", '{"family":"f","quant":null}')]
    assert got[0]["digest"] == got[0]["doc_shasum_512"]


def test_language_of_known_and_empty_text(spark):
    labelled = spark.createDataFrame(
        [("the cat and the dog sat there", "en"), ("le chat et le chien sont là", "fr"),
         ("12345 !!!", None)], "text string, lang string")
    profiles = language.train_profiles(labelled, "text", "lang")
    items = spark.createDataFrame(
        [(1, "the dog there"), (2, "LE CHIEN"), (3, "1234"), (4, ""), (5, None), (6, "zzz qqq")],
        "id int, text string")
    got = {r["id"]: r["detected"] for r in
           language.detect_language(items, "id", "text", profiles).collect()}
    assert got == {1: "en", 2: "fr", 3: None, 4: None, 5: None, 6: None}


def test_rare_words_score_like_common_ones(spark, monkeypatch):
    rnd = random.Random(2)
    data = [(i, " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6)))
                         for _ in range(30)), rnd.choice(["x", "y", "z"])) for i in range(60)]
    df = spark.createDataFrame(data, "id int, text string, lang string")

    def run():
        p = language.train_profiles(df, "text", "lang")
        return {r["id"]: r["detected"]
                for r in language.detect_language(df, "id", "text", p).collect()}

    usual = run()
    monkeypatch.setattr(language, "COMMON_WORDS", 3)
    assert run() == usual


def test_hot_and_cold_bundles_agree(spark, rows):
    """Posts with and without documents, comments or a readable text, one of them heavy."""
    posts = spark.createDataFrame(
        [(f"p{i}", "s", "t", "[ Removed by Reddit ]" if i == 3 else "b") for i in range(6)],
        "post_id string, subreddit string, post_title string, post_body string")
    comments = spark.createDataFrame(
        [(f"p{0 if i % 2 else i % 6}", i, f"c{i:03d}", f"x{i}") for i in range(60)]
        + [("p9", 1, "z", "z")],
        "post_id string, comment_created_utc int, comment_id string, comment_body string")
    documents = spark.createDataFrame(
        [(i, f'{{"reference_id":"p{i % 5}","category":"post","llm":"phi4"}}') for i in range(14)
         if i % 5 != 2],
        "id int, analysis_document string")
    whole = service.bundles(posts, comments, documents, size=1000)
    assert {r["post_id"] for r in whole.collect()} == {"p0", "p4"}
    assert rows(service.bundles(posts, comments, documents)) == rows(whole)
    assert rows(service.bundles(posts, comments, joins.with_id_columns(documents))) == rows(whole)
    assert rows(service.bundles(posts, comments, documents, "p0")) == [
        r for r in rows(whole) if r[0] == "p0"]
    assert service.bundles(posts, comments, documents, "p1").count() == 0
    assert rows(service.bundles(posts, comments, documents, "p0", 7)) == rows(
        service.bundles(posts, comments, documents, size=7).filter("post_id = 'p0'"))


def test_small_batch_against_a_large_target(spark, monkeypatch, rows):
    target = spark.range(1000).selectExpr("id AS a", "id * 7 AS b")
    batch = spark.createDataFrame([(5, 1), (2000, 14), (2001, 3)], "a bigint, b bigint")
    unique = [["a"], ["b"]]
    few = dml.conflicting_rows(target, batch, unique)
    assert rows(few) == [(2, 14), (5, 35)]
    expected = rows(dml.rows_to_insert(target, batch, unique, ["a"]))
    assert rows(dml.rows_to_insert(few, batch, unique, ["a"])) == expected == [(2001, 3)]
    monkeypatch.setattr(dml, "BROADCAST_ROWS", 2)
    assert dml.conflicting_rows(target, batch, unique) is target


def test_stored_id_columns_give_the_same_answer(spark, rows):
    posts = spark.createDataFrame(
        [(f"i{n}", "text") for n in range(10)], "post_id string, post_body string")
    comments = spark.createDataFrame(
        [(f"i{n}", "text") for n in range(10)], "comment_id string, comment_body string")
    documents = spark.createDataFrame(
        [('{"post_id":"i1"}',), ('{"comment_id":"i2"}',), ('{"reference_id":"i3"}',), ("{bad",)],
        "analysis_document string")
    stored = joins.with_id_columns(documents)
    for query in (
        lambda d: dashboard.remaining_to_analyze(posts, comments, d),
        lambda d: enrichment.unanalyzed_posts(posts, d),
        lambda d: enrichment.unanalyzed_comments(comments, d),
    ):
        assert rows(query(stored)) == rows(query(documents))
    assert rows(dashboard.remaining_to_analyze(posts, comments, stored)) == [
        ("comments", 8), ("posts", 8)]
    plan = enrichment.unanalyzed_posts(posts, stored.drop("analysis_document"))
    assert plan.count() == 8
