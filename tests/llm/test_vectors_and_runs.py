"""Periodic runs, whitening and exact search against brute force, and their results for odd rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlake.llm import catalog, runs, topk, whitening
from forumlake.llm.bidiagonal import largest_right

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_rest(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_against_all_lags():
    pick = random.Random(3)
    total = 0
    for _ in range(1500):
        words = [b"%d" % pick.randint(0, pick.choice([1, 2, 3, 6])) for _ in range(pick.randint(0, 70))]
        for _ in range(pick.randint(0, 3) if len(words) > 8 else 0):
            a = pick.randrange(len(words))
            p = pick.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a, pick.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        found = runs.periodic_runs(words)
        assert found == plain_runs(words)
        assert runs.collapsed(words, found) == plain_rest(words, found)
        total += len(found)
    assert total > 300


def test_runs_of_long_texts():
    assert runs.periodic_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    words = [b"%d" % (i % 9_000) for i in range(40_000)]
    assert runs.periodic_runs(words) == [(0, 40_000, 9_000)]
    # Words that become rare one after the other, each by the split before.
    chain = [b"%d" % (i // 3) for i in range(30_000)]
    assert runs.segments(chain) == []
    assert runs.periodic_runs([*chain, *[b"x", b"y"] * 4]) == [(30_000, 8, 2)]


def test_runs_query(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(documents)
    planted = 0
    for doc, text in documents:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found, row = plain_runs(words), got[doc]
        planted += bool(found)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == want
        assert row["n_runs"] == len(found)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(plain_rest(words, found))).hexdigest()
    assert planted > 5


def test_runs_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, " \t\n"), (3, "é " * 7), (3, "é " * 7), (4, "a b " * 6 + "c")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, `a.b` string")
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(df).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, [], ""), (None, [], ""), (2, [], ""), (3, [(0, 7, 1)], "é"), (3, [(0, 7, 1)], "é"),
        (4, [(0, 6, 1)], "a b c")], key=repr)
    assert runs.find_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["random", "equal", "graded", "low rank", "zero", "diagonal", "short"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(1)
    q, p = (np.linalg.qr(rng.normal(size=(30, 30)))[0] for _ in range(2))
    m = {
        "random": rng.normal(size=(90, 30)), "equal": q * np.repeat([3.0, 1.0], 15) @ p,
        "graded": q * 10.0 ** -np.arange(30) @ p, "low rank": rng.normal(size=(90, 4)) @ rng.normal(size=(4, 30)),
        "zero": np.zeros((30, 30)), "diagonal": np.diag(np.arange(30.0)), "short": rng.normal(size=(3, 30)),
    }[kind]
    top, vectors, total = largest_right(m, 8)
    gram = m.T @ m
    scale = max(1.0, gram.max())
    assert np.allclose(top, np.sort(np.linalg.eigvalsh(gram))[::-1][:8], rtol=1e-12, atol=1e-12 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-11)
    assert np.allclose(gram @ vectors, vectors * top, atol=1e-12 * scale)
    assert np.isclose(total, (m * m).sum())


def vectors_of(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)


def test_whitening_query(spark):
    ids, c = vectors_of(spark)
    x = np.floor(1024 * c).astype("int64") + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    deviations = dict(zip(ids, ((n * x - sums) ** 2).sum(axis=1).tolist(), strict=True))
    got = catalog.QUERIES["op12_embedding_whitening"](spark, SF_DIR).toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert (got["deviation"] == got["vec_id"].map(deviations)).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table - want * signs).max() < 1e-7
    for i in range(8):
        assert np.allclose(got.loc[got["component"] == i + 1, "explained"], values[i] / values.sum(), rtol=1e-9)
    measured = np.abs(np.cov(table.T, bias=True) - np.eye(8)).max()
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9 and measured < 1e-9


BAD = [(90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [1.0, float("inf")])]


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, n int, `a.b` string"
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, 1.0]), (3, [0.125]), *BAD]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in got if r["vec_id"] is not None) == [
        (False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 3, 1), (False, 3, 2)]
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9
    assert np.isclose(sum({r["component"]: r["explained"] for r in got}.values()), 1)
    flat = whitening.whiten(spark.createDataFrame([(i, [0.5, float(i)], 1, "x") for i in range(4)], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.5], 1, "x") for i in range(2)], schema)).collect()
    assert len(same) == 4 and all(r["whitened"] is r["explained"] is r["identity_error"] is None for r in same)
    assert {r["deviation"] for r in same} == {0}
    assert whitening.whiten(df.limit(0)).count() == 0
    large = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0], 1, "x"), (2, [0.0, 1.0], 1, "x")], schema)).collect()
    assert len(large) == 4 and {r["deviation"] for r in large} == {None}


def nearest(rows, asked, k=5, scale=256):
    out = []
    vectors = [(i, np.floor(scale * np.array(v, dtype=float)).astype("int64")) for i, v in rows]
    for q, x in asked:
        x = np.floor(scale * np.array(x, dtype=float)).astype("int64")
        others = sorted(((-int(x @ v), i is None, i or 0, i) for i, v in vectors if i != q))
        out += [(q, n + 1, o[3], -o[0]) for n, o in enumerate(others[:k])]
    return sorted(out, key=repr)


def test_topk_query(spark):
    ids, c = vectors_of(spark)
    rows = list(zip(ids, c.tolist(), strict=True))
    got = catalog.QUERIES["op13_exact_topk"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=repr) == nearest(rows, [r for r in rows if r[0] % 50 == 0])


@pytest.mark.parametrize("cells", [3, 256])
def test_topk_copies_and_ties(spark, monkeypatch, cells):
    """A third of the rows are copies, a third near copies, and many scores are equal."""
    monkeypatch.setattr(topk, "CELLS", cells)
    rng = np.random.default_rng(2)
    hot = rng.integers(-9, 9, 6).astype(float)
    rows = [(i, hot / 256) for i in range(0, 300, 3)]
    rows += [(i, (hot + (rng.integers(0, 2, 6))) / 256) for i in range(1, 300, 3)]
    rows += [(i, rng.integers(-2, 3, 6) / 256) for i in range(2, 300, 3)]
    rows += [(400, np.zeros(6)), (450, np.zeros(6)), (None, hot / 256), (500, hot / 256)]
    rows = [(i, v.tolist()) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = nearest(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0])
    assert sorted(map(tuple, got), key=repr) == want


def test_topk_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, score int, `a.b` string"
    rows = [(0, [1.0, 0.5]), (50, [0.25]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (None, [0.0, 1.0]), *BAD]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted(map(tuple, got)) == [
        (0, 1, 1, 81_920), (0, 2, 1, 81_920), (0, 3, None, 32_768),
        (50, 1, 0, 16_384), (50, 2, 1, 16_384), (50, 3, 1, 16_384)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(large, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
