"""Hand-made edge rows for the column functions."""

import hashlib
import random
import string

from pyspark.sql import functions as F

from forumlake.functions import documents as docs
from forumlake.functions import keys, predicates, text, times, versions


def one(spark, column, **values):
    """The value of ``column`` on one row with the given columns."""
    schema = ", ".join(
        f"{k} {'string' if v is None or isinstance(v, str) else type_of(v)}"
        for k, v in values.items()
    )
    frame = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def type_of(value):
    return {int: "bigint", float: "double", bool: "boolean", bytes: "binary"}[type(value)]


def kept(spark, values, test):
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in frame.filter(test("x")).collect()]


def test_literal_not_in_drops_null(spark):
    assert kept(spark, [None, "", "[removed]", "[deleted]", "x"], predicates.has_text) == ["x"]
    assert kept(spark, [None, "", "[removed]", "[deleted]", "x"],
                predicates.has_text_or_deleted) == ["[deleted]", "x"]


def test_hash_form_equals_literal_form(spark):
    values = [None, "", "[removed]", "[deleted]", "x", " ", "[Removed]"]
    assert kept(spark, values, predicates.has_text_by_hash) == kept(
        spark, values, predicates.has_text)


def test_underscore_is_a_wildcard(spark):
    assert kept(spark, ["u_bob", "ukpol", "u", "news"], predicates.not_profile_page) == [
        "u", "news"]
    assert kept(spark, ["pg_stats", "pgxyz", "pg", "posts"], predicates.not_system_table) == [
        "pg", "posts"]


def test_brackets_in_like_are_literal(spark):
    assert kept(spark, ["[ Removed by Reddit ] x", "R", None],
                predicates.not_removed_by_site) == ["R"]


def test_purge_keeps_null_authors(spark):
    assert kept(spark, [None, "AutoModerator", "bob"], predicates.survives_purge) == [None, "bob"]
    assert kept(spark, [None, "AutoModerator", "bob"], predicates.human_author) == ["bob"]


def test_language_gate_passes_unknown(spark):
    assert kept(spark, ["en", "fr", None], predicates.passes_language_gate) == ["en", None]


def test_comment_routes(spark):
    cases = [
        ("[removed]", "bob", "comment"), ("[deleted]", None, "comment"),
        ("x", "bob", "comment_and_post"), ("x", "AutoModerator", "none"), ("x", None, "none"),
        ("[removed]", "AutoModerator", "comment"),
    ]
    frame = spark.createDataFrame(cases, "body string, author string, expected string")
    got = frame.select(predicates.comment_route("body", "author").alias("r"), "expected")
    assert all(r["r"] == r["expected"] for r in got.collect())


def test_day_range_is_half_open(spark):
    frame = spark.createDataFrame(
        [("2024-08-21 23:59:59",), ("2024-08-22 00:00:00",), ("2024-09-06 23:59:59",),
         ("2024-09-07 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"), "t")
    got = frame.toDF("ts", "s").filter(predicates.in_days("ts", "2024-08-22", "2024-09-07"))
    assert [r["s"] for r in got.collect()] == ["2024-08-22 00:00:00", "2024-09-06 23:59:59"]


def test_format_width(spark):
    cases = {
        "": None,
        "ab\ncd": "ab",
        "x" * 100: "x" * 80 + "\n" + " " * 80,
        "y" * 90 + "\nzz": "y" * 80 + "\n" + " " * 78 + "zz",
    }
    for given, expected in cases.items():
        assert one(spark, text.format_width("s"), s=given) == expected
    assert one(spark, text.format_width("s"), s=None) is None


def format_width_by_hand(s):
    n = (len(s) + 79) // 80
    if n == 0:
        return None
    parts = (s.split("\n") + [""] * n)[:n]
    lines = [p[:80] for p in parts]
    return lines[0] + "".join("\n" + " " * (80 - len(x)) + x for x in lines[1:])


def test_text_functions_against_python(spark):
    rnd = random.Random(7)
    alphabet = string.ascii_letters + string.punctuation + " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 é漢😀" * 3
    texts = ["", " ", "a"] + [
        "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 400))) for _ in range(200)
    ]
    frame = spark.createDataFrame([(s,) for s in texts], "s string")
    got = frame.select(
        "s", text.word_count("s").alias("w"), text.punctuation_count("s").alias("p"),
        text.format_width("s").alias("f"), docs.sha512_hex("s").alias("h512"),
        docs.sha256_hex("s").alias("h256"), F.md5("s").alias("m"),
    ).collect()
    for r in got:
        s = r["s"]
        assert r["w"] == len(s.split())
        assert r["p"] == sum(c in string.punctuation for c in s)
        assert r["f"] == format_width_by_hand(s)
        assert r["h512"] == hashlib.sha512(s.encode()).hexdigest()
        assert r["h256"] == hashlib.sha256(s.encode()).hexdigest()
        assert r["m"] == hashlib.md5(s.encode()).hexdigest()


def test_word_and_punctuation_example(spark):
    s = "Hello, world! This is a test string. It contains words and punctuation."
    assert one(spark, F.struct(text.word_count("s"), text.punctuation_count("s")), s=s) == (12, 4)
    assert one(spark, F.struct(text.word_count("s"), text.punctuation_count("s")), s="") == (0, 0)


def test_sanitize_replaces_every_phrase(spark):
    for phrase in text.BOILERPLATE:
        assert one(spark, text.sanitize("s"), s=f"{phrase} yes. {phrase}") == "FWIW -  yes. FWIW - "
    assert one(spark, text.sanitize("s"), s="as an ai language model") == "as an ai language model"


def test_semver_precedence(spark):
    ordered = ["0.3.9", "0.3.12", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta",
               "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0"]
    frame = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r[0] for r in frame.orderBy(versions.version_key("v")).collect()] == ordered
    # Build metadata does not count; a hyphen inside it starts no pre-release.
    assert one(spark, versions.version_key(F.lit("1.0.0+a-b")) == versions.version_key(
        F.lit("1.0.0"))) is True


def test_semver_validity(spark):
    for v, ok in {"0.4.4": True, "0.3.10-rc1": False, "1.2": False, "": False}.items():
        assert one(spark, versions.is_plain_version("v"), v=v) is ok


def test_model_names_and_keys(spark):
    assert one(spark, keys.full_model_name("m"), m="phi4") == "phi4:latest"
    assert one(spark, keys.full_model_name("m"), m="phi4:14b") == "phi4:14b"
    assert one(spark, keys.registry_key("post_id", "m"), m="abc") == "post_id_abc"
    assert one(spark, keys.strip_kind("m", "post_id"), m="post_id_a_post_id_b") == "a_b"
    assert one(spark, text.parent_comment_id("m"), m="t1_abc") == "abc"


def test_edited_flag(spark):
    for given, expected in {"false": "false", None: "false", "1704070000.0": "1704070000",
                            "0": "false", "1704070000": "1704070000"}.items():
        assert one(spark, text.edited_text("m"), m=given) == expected


def test_json_fields(spark):
    d = '{"a": null, "n": 12, "t": "x", "o": {"k": true}}'
    for key, expected in {"a": None, "n": "12", "t": "x", "missing": None, "o.k": "true"}.items():
        assert one(spark, docs.field("d", key), d=d) == expected
    assert one(spark, docs.is_json("d"), d="{bad json") is False
    for bad in ('{"a":1} x', "", " ", "1, 2", "1], [2", '1,"w":2', "[1", "{'a':1}"):
        assert one(spark, docs.is_json("d"), d=bad) is False, bad
    for good in ('{"a":1,"a":2}', ' {"a":1} ', "null", "[]", "1", '"x"', '[{"a":[1,2]}]'):
        assert one(spark, docs.is_json("d"), d=good) is True, good
    assert one(spark, docs.is_json("d"), d=d) is True
    made = one(spark, docs.to_document(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b")))
    assert made == '{"a":"x","b":null}'
    parsed = one(spark, docs.parsed_documents(F.array(F.lit(d), F.lit("null")), "t string"))
    assert parsed[0]["t"] == "x" and (parsed[1] is None or parsed[1]["t"] is None)


def test_times(spark):
    assert one(spark, times.iso_text(times.epoch_to_timestamp("e")), e="1704067207") == (
        "2024-01-01 00:00:07+00:00")
    assert one(spark, times.epoch_text(F.lit("2024-01-01 00:00:07.9").cast("timestamp"))) == (
        "1704067207")
    assert one(spark, times.elapsed_seconds("a", "b"), a=10.9, b=13.8) == 2
    assert one(spark, times.tokens_per_second("a", "b"), a=5, b=2_000_000_000) == 2.5
    assert one(spark, times.tokens_per_second("a", "b"), a=5, b=0) is None


def test_encryption(spark, tmp_path):
    (tmp_path / "key").write_bytes(b"0123456789abcdef\n")
    key = docs.read_key(str(tmp_path / "key"))
    token = docs.encrypt_text("s", key)
    assert one(spark, docs.decrypt_text(token, key), s="grüße 😀") == "grüße 😀"
    assert one(spark, token != F.col("s"), s="abc") is True


def test_internal_id_is_repeatable(spark):
    a = one(spark, text.internal_id("k"), k="x")
    assert a == one(spark, text.internal_id("k"), k="x") and len(a) == 10
    assert a != one(spark, text.internal_id("k", 1), k="x")
