"""Embedding whitening: blockwise QR of the centred rows, then a bidiagonal qd solver.

Tasks reduce their rows to triangles block by block and a tree of tasks reduces the
triangles to one, which has as many rows as the vectors have dimensions. It is all the
driver sees. Its right singular vectors are the components: the covariance, whose condition
is the square of the data's, is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.bidiagonal import EPS, largest_right
from forumlake.llm.common import ship_package
from forumlake.llm.vectors import matrix, padded, whole_vectors
from forumlake.session import durable

#: Triangles that one task of the tree reduces.
FAN_IN = 16
#: Rows that are reduced at once.
BLOCK = 4096


class Centre:
    """The exact mean of n whole vectors, as a whole part and a rest, and what it takes to leave it."""

    def __init__(self, n: int, sums: list[int], least: list[int], greatest: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], "int64")
        self.rest = np.array([s % n for s in sums], "int64")
        far = [max(abs(n * g - s), abs(n * v - s)) for s, v, g in zip(sums, least, greatest, strict=True)]
        self.small = sum(f * f for f in far) < 1 << 63

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n x - S; null where they leave the range of a long."""
        if self.small:
            off = self.n * (x - self.base) - self.rest
            return np.einsum("ij,ij->i", off, off).tolist()
        off = self.n * (x.astype(object) - self.base.astype(object)) - self.rest.astype(object)
        return [s if s < 1 << 63 else None for s in (off * off).sum(axis=1)]


def centre_of(rows: DataFrame) -> Centre | None:
    """Exact sums per dimension, reduced in the map tasks; one row per dimension reaches the driver."""
    found = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("sum"),
        F.min("v").alias("least"), F.max("v").alias("greatest")).orderBy("j").collect()
    if not found:
        return None
    return Centre(found[0]["n"], [int(r["sum"]) for r in found], [r["least"] for r in found], [r["greatest"] for r in found])


def triangle(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    shared, dims = rows.sparkSession.sparkContext.broadcast(centre), len(centre.base)

    def packed(r: np.ndarray) -> bytes:
        whole = np.zeros((dims, dims))
        whole[: len(r)] = r
        return whole.tobytes()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            x = shared.value.centred(matrix(batch.column("x"), dims))
            for i in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, x[i : i + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([packed(r)], "binary")], ["r"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, dims))
        for own in group.sort_values("n")["r"]:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(own).reshape(dims, dims)]), mode="r")
        return pd.DataFrame({"n": [group["n"].min()], "r": [packed(r)]})

    found = durable(rows.select("x").mapInArrow(reduce, "r binary").select(
        F.monotonically_increasing_id().alias("n"), "r"))
    while (left := found.count()) > 1:
        lots = -(-left // FAN_IN)
        number = F.pmod(F.xxhash64("n"), F.lit(lots)).alias("lot")
        found = durable(found.withColumn("lot", number).groupBy("lot").applyInPandas(join, "n long, r binary"))
    return np.frombuffer(found.first()["r"]).reshape(dims, dims)


def whitened_rows(rows: DataFrame, centre: Centre, directions: np.ndarray) -> DataFrame:
    """id, deviation and w, the centred vector along each of ``directions``, stored."""
    context = rows.sparkSession.sparkContext
    shared, dims = context.broadcast((centre, directions)), len(centre.base)
    schema = "id " + rows.schema["id"].dataType.simpleString() + ", deviation long, w array<double>"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, directions = shared.value
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            w = centre.centred(x) @ directions
            ends = np.arange(len(w) + 1, dtype="int32") * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(centre.deviations(x), "int64"),
                 pa.ListArray.from_arrays(ends, w.reshape(-1))], ["id", "deviation", "w"])

    return durable(rows.select("id", "x").mapInArrow(project, schema))


def identity_error(stored: DataFrame, n: int, kept: int) -> float | None:
    """The largest absolute entry of the covariance of ``w``, of its first ``kept`` numbers, minus the identity."""
    if not kept:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((kept + 1, kept + 1))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            w = np.hstack([w[:, :kept], np.ones((len(w), 1))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["at", "v"])

    sums = stored.select("w").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at")
    total = np.array([r["v"] for r in sums.collect()]).reshape(kept + 1, kept + 1)
    mean = total[kept, :kept] / n
    return float(np.abs(total[:kept, :kept] / n - np.outer(mean, mean) - np.eye(kept)).max())


def whiten(
    df: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error; one row per vector and component.

    Components of the vectors are taken as x = floor(scale * c) + shift. Rows whose vector is null
    or holds null, NaN or infinite components are left out. A vector shorter than others
    counts as if zeros followed. Directions without variance have no whitened value
    (null) and explain 0; without any variance ``explained`` and ``identity_error`` are null.
    Repeated rows and null ids count like all others; an empty table gives no rows. Other
    columns are not read. Fewer dimensions than ``components`` give as many components.
    """
    ship_package(df.sparkSession)
    whole = whole_vectors(df, id_col, vec_col, scale, shift)
    longest = whole.agg(F.max(F.size("x"))).first()[0] or 0
    rows = durable(whole.select("id", padded("x", longest, shift).alias("x")))
    kind = rows.schema["id"].dataType.simpleString()
    centre = centre_of(rows)
    if centre is None:
        empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)

    n, wanted = centre.n, min(components, longest)
    top, directions, total = largest_right(triangle(rows, centre), wanted)
    kept = int((top > (longest * EPS) ** 2 * top[0]).sum()) if top[0] > 0 else 0
    stored = whitened_rows(rows, centre, directions[:, :kept] / np.sqrt(top[:kept] / n))
    error = identity_error(stored, n, kept)
    explained = [float(v / total) if v and i < kept else 0.0 for i, v in enumerate(top)] if kept else [None] * wanted

    def literal(value: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if value is None else f"{value!r}D"

    parts = ", ".join(
        f"named_struct('component', {i + 1}, 'whitened', get(w, {i}), 'explained', {literal(e)})"
        for i, e in enumerate(explained))
    each = stored.select("id", "deviation", F.expr(f"inline(array({parts}))"))
    return each.select(
        F.col("id").alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        "explained", F.expr(literal(error)).alias("identity_error"))
