"""The registry of seen keys: claim once, expire, migrate, list.

The accepted claims of a key form a chain: from each to the first that comes late enough.
Range partitions cut the claims into pieces, in order of key and time. A piece follows
the chains inside itself, from every claim to its exit, the last claim of its chain here.
Only keys that go on in the next piece need more: their exits are linked to the exits of
later pieces, and the links are put together until they reach over all pieces of a key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlake.functions.keys import registry_key, strip_kind
from forumlake.session import durable

TTL_SECONDS = 30 * 24 * 3600  # fixed value: a claim holds for 30 days
# Rows that a task holds before it follows their chains; one key of a piece may have more.
LOT = 200_000
# Places within a piece.
PLACES = 40


def keys_of(registry: DataFrame, kind: str, key: str = "key", out: str = "id") -> DataFrame:
    """Members of one kind without their prefix."""
    return registry.filter(F.col(key).startswith(kind)).select(
        strip_kind(key, kind).alias(out)
    )


def live(registry: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS,
         claimed_at: str = "claimed_at") -> DataFrame:
    """Entries that have not expired."""
    return registry.filter(
        F.col(claimed_at) > as_of - F.make_dt_interval(secs=F.lit(ttl_seconds))
    )


def migrate(members: DataFrame, member: str, kind: str, registry: DataFrame,
            key: str = "key") -> DataFrame:
    """Set members as prefixed keys, without those that the registry holds."""
    wanted = members.select(registry_key(kind, member).alias(key)).distinct()
    return wanted.join(registry.select(key), key, "left_anti")


def follow(times: np.ndarray, start: int, ttl: int) -> np.ndarray:
    """The chain from ``start`` on in sorted ``times``, as places."""
    chain = []
    while start < len(times):
        chain.append(start)
        start = max(start + 1, int(np.searchsorted(times, times[start] + ttl)))
    return np.array(chain, "int64")


def exits(times: np.ndarray, ttl: int) -> np.ndarray:
    """For every claim the last one of the chain that begins with it, by pointer doubling."""
    jump = np.maximum(np.searchsorted(times, times + ttl), np.arange(1, len(times) + 1))
    jump = np.where(jump < len(times), jump, np.arange(len(times)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _pieces(claims: DataFrame, key: str, tie: str, last: DataFrame | None, ttl: int) -> DataFrame:
    """Claims in pieces by key and time, each piece followed on its own, stored.

    Columns: key, row (null for an entry of the registry), us, part, at, edge (the key may lie
    in another piece too), out (place of the exit, at edges), won (if the key begins here).
    """
    rows = claims.select(
        F.col(key).alias("key"), F.lit(1).alias("kind"), "us", F.col(tie).alias("tie"), F.struct(*[
            c for c in claims.columns if c != "us"]).alias("row"))
    if last is not None:
        kinds = {f.name: f.dataType for f in rows.schema}
        rows = rows.unionByName(last.select(
            F.col("key").cast(kinds["key"]), F.lit(0).alias("kind"), "us",
            F.lit(None).cast(kinds["tie"]).alias("tie"), F.lit(None).cast(kinds["row"]).alias("row")))
    order = ["key", "kind", "us", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    extra = "part int, at long, edge boolean, out long, won boolean"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, waiting = TaskContext.get().partitionId(), 0, None

        def followed(table: pa.Table, first: bool, final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done
            us, kind = (table[c].to_numpy() for c in ("us", "kind"))
            ends = _ends(table["key"])
            edge, out, won = np.zeros(len(us), bool), np.full(len(us), -1), np.zeros(len(us), bool)
            for i, (low, high) in enumerate(zip([0, *ends[:-1]], ends)):
                begin, limit = (low + 1, us[low] + ttl) if kind[low] == 0 else (low, None)
                times = us[begin:high]
                start = 0 if limit is None else int(np.searchsorted(times, limit))
                won[begin + follow(times, start, ttl)] = True
                if (first and i == 0) or (final and i == len(ends) - 1):
                    edge[low:high] = True
                    out[begin:high] = done + begin + exits(times, ttl)
            at = done + np.arange(len(us))
            done += len(us)
            table = table.append_column("part", pa.array(np.full(len(us), part, "int32")))
            for name, values in (("at", at), ("edge", edge), ("out", out), ("won", won)):
                table = table.append_column(name, pa.array(values))
            yield from table.to_batches()

        first = True
        for batch in batches:
            own = pa.Table.from_batches([batch])
            waiting = own if waiting is None else pa.concat_tables([waiting, own])
            if len(waiting) >= LOT and len(ends := _ends(waiting["key"])) > 1:
                yield from followed(waiting.slice(0, ends[-2]), first, False)
                waiting, first = waiting.slice(ends[-2]), False
        if waiting is not None and len(waiting):
            yield from followed(waiting, first, True)

    fields = [*dealt.schema.fields, *T.StructType.fromDDL(extra).fields]
    return durable(dealt.mapInArrow(walk, T.StructType(fields)))


def _ends(keys: pa.ChunkedArray) -> list[int]:
    """Where the stretches of equal keys end."""
    codes = keys.combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    codes = codes.indices.to_numpy()
    return [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]


def _shared(edges: DataFrame) -> list[tuple]:
    """(key, part, latest claim, latest of the registry) of keys in several pieces.

    A piece has at most two keys of this kind, so the driver sees two rows a piece at most.
    """
    found = edges.groupBy("key", "part").agg(
        F.max(F.when(F.col("kind") == 1, F.col("us"))).alias("latest"),
        F.max(F.when(F.col("kind") == 0, F.col("us"))).alias("held"))
    rows = sorted(found.collect(), key=lambda r: r["part"])
    pieces = Counter(r["key"] for r in rows)
    return [r for r in rows if pieces[r["key"]] > 1]


def _entries(edges: DataFrame, segments: list[tuple], ttl: int) -> dict[tuple[int, int], int]:
    """Where the chain of a key enters its pieces: (key number, part) -> place."""
    spark = edges.sparkSession
    numbers: dict = {}
    parts: dict[int, list] = {}
    starts: dict[int, int] = {}
    for key, part, latest, held in segments:
        k = numbers.setdefault(key, len(numbers))
        if latest is not None:
            parts.setdefault(k, []).append((part, latest))
        if held is not None:
            starts[k] = held + ttl
    where = {k: (np.array([p for p, _ in v]), np.array([u for _, u in v])) for k, v in parts.items()}
    shared = spark.sparkContext.broadcast(where)

    @F.pandas_udf("int")
    def target(number: pd.Series, part: pd.Series, late: pd.Series) -> pd.Series:
        """The first later piece of the key with a claim that late; null if there is none."""
        out = np.full(len(number), -1)
        number, part, late = number.to_numpy(), part.to_numpy(), late.to_numpy()
        for k in np.unique(number):
            own, (pieces, latest) = number == k, shared.value[k]
            i = np.maximum(np.searchsorted(pieces, part[own], "right"), np.searchsorted(latest, late[own]))
            out[own] = np.append(pieces, -1)[i]
        return pd.Series(out).where(out >= 0).astype("Int32")

    kind = edges.schema["key"].dataType
    known = spark.createDataFrame(
        [(key, k) for key, k in numbers.items()], T.StructType([T.StructField("key", kind), T.StructField("k", T.IntegerType())]))
    claims = edges.where("kind = 1").join(F.broadcast(known), "key").select("k", "part", "at", "us", "out")
    begin = spark.createDataFrame(
        [(k, -1, -(k + 1), starts.get(k, -(1 << 62))) for k in where], "k int, part int, node long, late long")
    left = claims.where("out = at").select(
        "k", "part", F.expr(f"shiftleft(CAST(part AS LONG), {PLACES}) + at").alias("node"), (F.col("us") + ttl).alias("late"))
    probes = left.unionByName(begin).withColumn("to", target("k", "part", "late")).where("to IS NOT NULL")

    def enter(piece: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("at_")
        row = piece.iloc[np.searchsorted(piece["us_"].to_numpy(), asked["late"].to_numpy())]
        return pd.DataFrame({
            "a": asked["node"].to_numpy(), "b": (row["part_"].to_numpy("int64") << PLACES) + row["out_"].to_numpy(),
            "k": row["k_"].to_numpy(), "part": row["part_"].to_numpy(), "at": row["at_"].to_numpy()})

    own = claims.select(*[F.col(c).alias(f"{c}_") for c in claims.columns])
    asking = probes.select(F.col("k").alias("number"), "to", "node", "late")
    links = durable(own.groupBy("k_", "part_").cogroup(asking.groupBy("number", "to")).applyInPandas(
        enter, "a long, b long, k int, part int, at long"))

    # Each round makes a link reach over four times as many pieces as before, and marks what is
    # reached from the start of a key on the way.
    nodes = links.withColumn("reached", F.col("a") < 0)
    longest = max((len(p) for p, _ in where.values()), default=0)
    covered = 1
    while covered <= longest:
        covered *= 4
        steps = nodes
        for i in range(3):
            onward = nodes.select(F.col("a").alias("c"), F.col("b").alias(f"b{i}"))
            steps = steps.join(onward, F.col(f"b{i - 1}" if i else "b") == F.col("c"), "left").drop("c")
        kinds = {f.name: f.dataType for f in nodes.schema}
        own = F.struct("a", F.col("b2").alias("b"), "k", "part", "at", "reached")
        passed = [F.struct(
            F.when(F.col("reached"), F.col(c)).alias("a"),
            *[F.lit(None).cast(kinds[n]).alias(n) for n in ("b", "k", "part", "at")],
            F.lit(True).alias("reached")) for c in ("b", "b0", "b1")]
        both = steps.select(F.explode(F.array(own, *passed)).alias("n")).select("n.*").where("a IS NOT NULL")
        nodes = durable(both.groupBy("a").agg(*[F.max(c).alias(c) for c in ("b", "k", "part", "at", "reached")]))
    found = nodes.where("reached AND part IS NOT NULL").select("k", "part", "at").collect()
    return {(r["k"], r["part"]): r["at"] for r in found}


def claim_flags(
    claims: DataFrame, key: str, ts: str, tie: str, registry: DataFrame | None = None,
    ttl_seconds: int = TTL_SECONDS, out: str = "claimed",
) -> DataFrame:
    """Every claim with the answer its caller gets.

    Accepted are the first claim of a key, and then the first that comes at least
    ``ttl_seconds`` after the last accepted one. A refused claim extends nothing. Equal times
    are taken in ``tie`` order. ``registry`` (key, claimed_at) holds earlier accepted
    claims. A claim without key or time is refused.
    """
    ttl = ttl_seconds * 1_000_000
    complete = F.col(key).isNotNull() & F.col(ts).isNotNull()
    stamped = claims.filter(complete).withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))
    last = None
    if registry is not None:
        last = registry.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
            F.max(F.unix_micros(F.col("claimed_at").cast("timestamp"))).alias("us")).where("us IS NOT NULL")
    pieces = _pieces(stamped, key, tie, last, ttl)
    segments = _shared(pieces.where("edge"))
    refused = claims.filter(~complete).withColumn(out, F.lit(False))
    if not segments:
        return _answers(pieces, out, refused)

    entries = _entries(pieces.where("edge"), segments, ttl)
    numbers = {k: i for i, k in enumerate(dict.fromkeys(s[0] for s in segments))}
    spark = claims.sparkSession
    pairs = [(s[0], s[1], entries.get((numbers[s[0]], s[1]), -1)) for s in segments]
    marks = spark.createDataFrame(pairs, T.StructType([
        T.StructField("key", pieces.schema["key"].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("enter", T.LongType())]))

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        start = table["enter"][0].as_py() - table["at"][0].as_py()
        won = np.zeros(len(table), bool)
        if start >= 0:
            won[start + follow(table["us"].to_numpy()[start:], 0, ttl)] = True
        at = table.schema.get_field_index("won")
        return table.set_column(at, "won", pa.array(won)).drop_columns("enter")

    # One row a key and piece, at most two a piece.
    marks = F.broadcast(marks)
    whole = pieces.join(marks.select("key", "part"), ["key", "part"], "left_anti")
    cut = pieces.join(marks, ["key", "part"]).select(*pieces.columns, "enter")
    cut = cut.groupBy("key", "part").applyInArrow(walk, pieces.schema)
    return _answers(whole.unionByName(cut), out, refused)


def _answers(pieces: DataFrame, out: str, refused: DataFrame) -> DataFrame:
    return pieces.where("kind = 1").select("row.*", F.col("won").alias(out)).unionByName(refused)


def claim_keys(
    claims: DataFrame, key: str, ts: str, tie: str, registry: DataFrame | None = None,
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """Accepted claims (key, claimed_at, tie); see ``claim_flags``."""
    flags = claim_flags(claims.select(key, ts, tie), key, ts, tie, registry, ttl_seconds, "_won")
    return flags.where("_won").select(key, F.col(ts).alias("claimed_at"), tie)
