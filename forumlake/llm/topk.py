"""Exact nearest neighbours by inner product with a vector-approximation file.

Each component falls into one of CELLS cells of its dimension, cut so that all hold about
as many vectors: also inside a dense group of near copies. One byte a component makes the
approximation file. A scan of it bounds every score from both sides and leaves the
vectors that may be among the best. Their exact vectors are then read in the order of the
better bounds: first a few of each query, which fix what the others must reach.

Equal vectors are one class with its smallest ids, so a group of copies is met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.llm.common import ship_package
from forumlake.llm.vectors import matrix, padded, whole_vectors
from forumlake.session import durable

CELLS = 256
#: Vectors in a row of the file, queries that are compared with them at once.
CHUNK, LOT = 1024, 1024
#: Rows of the file and queries that one task holds: about 90 MB and 70 MB of 64 dimensions.
ROW_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 17
LAST = np.iinfo("int64").max


class Cells:
    """The cells of each dimension: where they part, their least and greatest number."""

    def __init__(self, least: list[int], greatest: list[int], cuts: list[list[int]]):
        self.dims = len(least)
        # A cell begins at a cut; numbers below the first cut are in cell 0.
        self.cuts = [np.unique([c for c in own if c > low]) for own, low in zip(cuts, least, strict=True)]
        self.low = np.zeros((self.dims, CELLS))
        self.high = np.zeros((self.dims, CELLS))
        for j, own in enumerate(self.cuts):
            self.low[j, : len(own) + 1] = [least[j], *own]
            self.high[j, : len(own) + 1] = [*(own - 1), greatest[j]]
        self.largest = max((max(abs(a), abs(b)) for a, b in zip(least, greatest, strict=True)), default=0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, "uint8")
        for j, own in enumerate(self.cuts):
            out[:, j] = np.searchsorted(own, x[:, j], side="right")
        return out

    def exact(self) -> bool:
        """Whether sums of products of any two vectors fit into 62 bits."""
        return self.dims * self.largest**2 < 1 << 62

    def kind(self) -> str:
        """The floating type in which bounds are exact, or else the wider one."""
        return "float32" if 2 * self.dims * self.largest**2 < 1 << 24 else "float64"

    def slack(self) -> float:
        """What rounding may add to a bound."""
        product = 2 * self.dims * self.largest**2
        return 0.0 if product < 1 << 53 else product * 2.0 * self.dims * 2.0**-52


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors, stored: place, a digest (h, g), x, and their k + 1 smallest ids, null last.

    A map task passes on at most k + 1 rows of a class.
    """
    order = Window.partitionBy("h", "g").orderBy("member")
    member = F.struct(F.col("id").isNull().alias("absent"), "id").alias("member")
    ranked = rows.select("h", "g", "x", member).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    grouped = ranked.groupBy("h", "g").agg(
        F.first("x").alias("x"), F.sort_array(F.collect_list("member")).alias("members"))
    return durable(grouped.withColumn("place", F.monotonically_increasing_id()))


def cells_of(classes: DataFrame) -> Cells:
    """Cut points of all vectors, dimension by dimension; the driver sees CELLS numbers of each."""
    shares = [i / CELLS for i in range(1, CELLS)]
    found = classes.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.min("v").alias("least"), F.max("v").alias("greatest"),
        F.percentile_approx("v", shares, 2_000).alias("cuts")).orderBy("j").collect()
    return Cells([r["least"] for r in found], [r["greatest"] for r in found], [r["cuts"] for r in found])


def approximation_file(classes: DataFrame, cells: Cells, groups: int) -> DataFrame:
    """The file, stored: rows of up to CHUNK vectors (places, smallest ids, codes), dealt to groups."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, turn = shared.value, TaskContext.get().partitionId()
        for batch in batches:
            codes = cells.codes(matrix(batch.column("x"), cells.dims))
            places = batch.column("place").to_numpy()
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            out = []
            for i in range(0, len(places), CHUNK):
                own = slice(i, i + CHUNK)
                out.append((turn % groups, places[own].tobytes(), ids[own].tobytes(), codes[own].tobytes()))
                turn += 1
            if out:
                names = ["r", "places", "ids", "codes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], "int32"), *[pa.array([o[i] for o in out], "binary") for i in (1, 2, 3)]],
                    names)

    first = F.coalesce(F.col("members")[0]["id"].cast("long"), F.lit(int(LAST))).alias("id")
    return durable(classes.select("place", first, "x").mapInArrow(
        write, "r int, places binary, ids binary, codes binary"))


def query_file(queries: DataFrame, dims: int, groups: int) -> DataFrame:
    """Query vectors in rows of up to CHUNK: c, places, x as 64-bit numbers."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            x, places = matrix(batch.column("x"), dims).astype("int64"), batch.column("place").to_numpy()
            for i in range(0, len(places), CHUNK):
                own = slice(i, i + CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([turn % groups], "int32"), pa.array([places[own].tobytes()], "binary"),
                     pa.array([x[own].tobytes()], "binary")], ["c", "places", "x"])
                turn += 1

    return queries.select("place", "x").mapInArrow(write, "c int, places binary, x binary")


class Survivors:
    """What a lot of queries keeps while it goes over the file: all that k others do not beat for sure.

    One beats another if its lower bound is above the other's upper bound, or equal to it
    with a smaller id.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.k, n = k, len(queries)
        self.sides = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        self.least, self.id = np.full(n, -np.inf), np.full(n, LAST)
        self.kept = [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), np.zeros(0)]

    def meet(self, places: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> None:
        below = self.sides @ np.concatenate([low, high], axis=1).T
        above = self.sides @ np.concatenate([high, low], axis=1).T
        if slack:
            below, above = below - slack, above + slack
        if len(places) >= self.k and np.isneginf(self.least).any():
            own = np.partition(below, len(places) - self.k, axis=1)[:, len(places) - self.k]
            self.least = np.maximum(self.least, own)
        row, at = np.nonzero(above >= self.least[:, None])
        if not len(row):
            return
        found = [row, places[at], ids[at], below[row, at].astype("float64"), above[row, at].astype("float64")]
        row, place, id_, below, above = map(np.concatenate, zip(self.kept, found, strict=True))
        order = np.lexsort((id_, -below, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        last = order[rank == self.k - 1]
        self.least[row[last]], self.id[row[last]] = below[last], id_[last]
        least = self.least[row]
        stay = (above > least) | ((above == least) & (id_ <= self.id[row]))
        self.kept = [v[stay] for v in (row, place, id_, below, above)]


SCANNED = "q long, place long, id long, low double, high double"


def scan(file: DataFrame, queries: DataFrame, cells: Cells, k: int, rows: int, columns: int) -> DataFrame:
    """Bounds of all pairs that may be among the k best of the query, SCANNED.

    The file is cut into ``rows`` groups and the queries into ``columns``; each pair of groups
    is a task, so the file is sent ``columns`` times and the queries ``rows`` times.
    """
    shared = file.sparkSession.sparkContext.broadcast(cells)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cells = shared.value
        kind, dims, slack, axis = cells.kind(), cells.dims, cells.slack(), np.arange(cells.dims)
        low_of, high_of = cells.low.astype(kind), cells.high.astype(kind)
        names = np.concatenate([np.frombuffer(p, "int64") for p in right["places"]] or [np.zeros(0, "int64")])
        x = b"".join(right["x"])
        x = np.frombuffer(x, "int64").reshape(len(names), dims).astype(kind)
        lots = [Survivors(x[i : i + LOT], k) for i in range(0, len(names), LOT)]
        for places, ids, codes in zip(left["places"], left["ids"], left["codes"], strict=True):
            places, ids = np.frombuffer(places, "int64"), np.frombuffer(ids, "int64")
            codes = np.frombuffer(codes, "uint8").reshape(len(places), dims)
            low, high = low_of[axis, codes], high_of[axis, codes]
            for lot in lots:
                lot.meet(places, ids, low, high, slack)
        out = []
        for i, lot in enumerate(lots):
            row, place, id_, low, high = lot.kept
            out.append(pd.DataFrame({"q": names[row + i * LOT], "place": place, "id": id_, "low": low, "high": high}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCANNED.split(", ")])

    def dealt(frame: DataFrame, key: str, other: int) -> DataFrame:
        cell = F.expr(f"explode(sequence(0, {other - 1}))")
        number = f"r * {columns} + n" if key == "r" else f"n * {columns} + c"
        spread = frame.withColumn("n", cell).withColumn("cell", F.expr(number)).drop("n", key)
        return spread.repartition(rows * columns, "cell")

    left, right = dealt(file, "r", columns), dealt(queries, "c", rows)
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(compare, SCANNED)


def beaten_by(bounds: DataFrame, worth: Column, k: int) -> DataFrame:
    """q, and what the k-th best by ``worth`` and id has (``worth``, ``least_id``), where there are k."""
    best = Window.partitionBy("q").orderBy(worth.desc(), "id")
    ranked = bounds.select("q", worth.alias("worth"), F.col("id").alias("least_id"), F.row_number().over(best).alias("n"))
    return ranked.where(F.col("n") <= k).where(F.col("n") == k).drop("n")


def not_beaten(bounds: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose upper bound and id still reach what ``marks`` ask; all where there is no mark."""
    may = F.expr("worth IS NULL OR high > worth OR (high = worth AND id <= least_id)")
    return bounds.join(marks, "q", "left").where(may).drop("worth", "least_id")


def with_scores(pairs: DataFrame, classes: DataFrame, asked: DataFrame, cells: Cells) -> DataFrame:
    """q, place, id, score and the members of the class, from the exact vectors of both, stored."""
    exact = cells.exact()

    @F.pandas_udf("long")
    def product(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        a, b = np.stack(x.to_numpy()), np.stack(y.to_numpy())
        if exact:
            return pd.Series(np.einsum("ij,ij->i", a, b))
        sums = (a.astype(object) * b.astype(object)).sum(axis=1)
        return pd.Series([min(max(int(s), -LAST - 1), LAST) for s in sums], dtype="int64")

    joined = pairs.join(classes.select("place", "x", "members"), "place").join(
        asked.select(F.col("place").alias("q"), F.col("x").alias("y")), "q")
    return durable(joined.select("q", "place", "id", product("x", "y").alias("score"), "members"))


def exact_top_k(
    df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row that ``is_query`` selects.

    Components are taken as floor(scale * x). Candidates are all rows with another id than the
    query's; equal scores go by smaller id, null ids last. Rows whose vector is null or holds
    null, NaN or infinite components take no part. Repeated candidate rows are all
    candidates; a query row that is repeated as a whole is answered once. A vector shorter
    than others counts as if zeros followed. Scores beyond the range of a long stop at
    its end. ``is_query`` is a condition on columns of ``df``. With fewer than k candidates
    all are returned; an empty table gives no rows. Other columns are not read.
    """
    ship_package(df.sparkSession)
    digest = [F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g")]
    longest = whole_vectors(df, id_col, vec_col, scale).agg(F.max(F.size("x"))).first()[0] or 0
    x = padded("x", longest, 0).alias("x")
    rows = whole_vectors(df, id_col, vec_col, scale).select("id", x).select("id", "x", *digest)
    asking = whole_vectors(df.where(is_query), id_col, vec_col, scale).select("id", x).select("id", "x", *digest)
    classes = classes_of(rows, k)
    queries = durable(asking.join(classes.select("h", "g", "place"), ["h", "g"]).select("id", "place", "x"))
    asked = durable(queries.select("place", "x").dropDuplicates(["place"]))
    cells = cells_of(classes)

    columns = max(1, -(-asked.count() // QUERY_BLOCK))
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-classes.count() // ROW_BLOCK), -(-4 * cores // columns))
    # One class more than asked for: a query's own class may hold nothing but the query.
    most = k + 1
    file = approximation_file(classes, cells, groups)
    bounds = durable(scan(file, query_file(asked, cells.dims, columns), cells, most, groups, columns))
    bounds = not_beaten(bounds, beaten_by(bounds, F.col("low"), most))

    by_bound = Window.partitionBy("q").orderBy(F.col("high").desc(), "id")
    ordered = durable(bounds.withColumn("n", F.row_number().over(by_bound)))
    first = with_scores(ordered.where(F.col("n") <= 2 * most), classes, asked, cells)
    rest = not_beaten(ordered.where(F.col("n") > 2 * most), beaten_by(first, F.col("score"), most))
    scored = first.union(with_scores(rest, classes, asked, cells))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    scored = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)

    found = queries.select(F.col("id").alias("query_id"), F.col("place").alias("q")).distinct().join(
        scored.select("q", "score", "members"), "q").select(
        "query_id", "q", "score", F.explode("members").alias("member"))
    others = found.where(~F.col("member.id").eqNullSafe(F.col("query_id")))
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "member")
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("member.id").alias("vec_id"), "score")
