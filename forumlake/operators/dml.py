"""Changes to tables as DataFrames (the new state) and as writes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from forumlake.functions.predicates import survives_purge
from forumlake.operators.joins import BROADCAST_ROWS
from forumlake.operators.numbering import running_number
from forumlake.session import durable, list_folder, path_exists

Keys = Sequence[Sequence[str]]


def _order(order) -> list[Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _conflict_key(i: int, cols: Sequence[str], row_id: str) -> list[Column]:
    """Key columns as text. A row with a NULL in the key conflicts with nothing, so
    its first column gets a value of its own; that also spreads such rows."""
    texts = [F.col(c).cast("string") for c in cols]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    alone = F.concat(F.lit("\u0000"), F.col(row_id).cast("string"))
    texts = [F.when(complete, texts[0]).otherwise(alone), *texts[1:]]
    return [t.alias(f"_u{i}_{j}") for j, t in enumerate(texts)]


def _names(i: int, cols: Sequence[str]) -> list[str]:
    return [f"_u{i}_{j}" for j in range(len(cols))]


def _without(rows: DataFrame, i: int, cols: Sequence[str], taken: DataFrame) -> DataFrame:
    """Rows whose i-th key is not among the keys of ``taken``."""
    right = taken.select(*[F.col(c).cast("string").alias(f"_t{j}") for j, c in enumerate(cols)])
    cond = [F.col(n) == F.col(f"_t{j}") for j, n in enumerate(_names(i, cols))]
    return rows.join(right, cond, "left_anti")


def _firsts(rows: DataFrame, i: int, cols: Sequence[str], order) -> DataFrame:
    """The first row per i-th key; a map task passes on one row of each key."""
    w = Window.partitionBy(*_names(i, cols)).orderBy(*_order(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rows_to_insert(target: DataFrame, batch: DataFrame, unique: Keys, order) -> DataFrame:
    """The rows of ``batch`` that insert-or-ignore would add, taken in ``order``.

    ``order`` must be total. One key: the first row per key, cut to one row per
    key in every map task before the shuffle, then an anti-join on the same
    partitioning. Several keys: a row goes in when it is first in all its keys
    among the undecided ones; what conflicts with it goes out; repeat. Each round
    is stored, and its joins are by row number or between stored tables, which
    the adaptive skew join can split.
    """
    if not unique:
        return batch
    columns = batch.columns
    rows = batch.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select(
        "*", *[c for i, cols in enumerate(unique) for c in _conflict_key(i, cols, "_row")]
    )
    if len(unique) == 1:
        first = _firsts(rows, 0, unique[0], order)
        return _without(first, 0, unique[0], target).select(*columns)

    rows = durable(rows)
    for i, cols in enumerate(unique):
        rows = _without(rows, i, cols, target)
    undecided = durable(rows)
    accepted: list[DataFrame] = []
    while not undecided.isEmpty():
        winners = reduce(
            lambda a, b: a.join(b, "_row"),
            [_firsts(undecided, i, cols, order).select("_row") for i, cols in enumerate(unique)],
        )
        won = durable(undecided.join(winners, "_row", "left_semi"))
        accepted.append(won)
        for i, cols in enumerate(unique):
            names = _names(i, cols)
            taken = won.select(*[F.col(n).alias(f"_t{j}") for j, n in enumerate(names)])
            undecided = undecided.join(
                taken, [F.col(n) == F.col(f"_t{j}") for j, n in enumerate(names)], "left_anti"
            )
        undecided = durable(undecided)
    if not accepted:
        return undecided.select(*columns)
    return reduce(DataFrame.unionByName, accepted).select(*columns)


def insert_ignore(target: DataFrame, batch: DataFrame, unique: Keys, order) -> DataFrame:
    """The target after the insert; rows already there are never changed."""
    return target.unionByName(rows_to_insert(target, batch, unique, order))


def conflicting_rows(target: DataFrame, batch: DataFrame, unique: Keys) -> DataFrame:
    """The part of ``target`` that the batch could conflict with.

    A batch of few keys is sent to the target, so that a large target is scanned
    but not shuffled. Beyond ``BROADCAST_ROWS`` keys the target is returned as it is.
    """
    parts = []
    for cols in unique:
        wanted = batch.select(*cols).distinct()
        if wanted.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return target
        parts.append(target.join(F.broadcast(wanted), list(cols), "left_semi"))
    return reduce(DataFrame.unionByName, parts) if parts else target


# A table with one unique key is stored in so many folders by the key's hash once it has as many
# rows; the name of the folders' column tells the number, so that another one can be used for
# other tables.
BUCKETS = 64
# A batch puts the files of a folder together when there are more of them.
MOST_FILES = 16
_BUCKET_NAME = re.compile(r"^key(\d+)$")


def bucket_column(spark: SparkSession, path: str) -> str | None:
    """The column by which the table at ``path`` is stored, if it is stored by key."""
    names = {f.getPath().getName().split("=")[0] for f in list_folder(spark, path)}
    return next((n for n in names if _BUCKET_NAME.match(n)), None)


def bucket(cols: Sequence[str], column: str) -> Column:
    texts = [F.col(c).cast("string") for c in cols]
    return F.pmod(F.xxhash64(*texts), F.lit(int(_BUCKET_NAME.match(column)[1]))).cast("int").alias(column)


def touched_rows(
    spark: SparkSession, path: str, staged: DataFrame, cols: Sequence[str], column: str
) -> DataFrame:
    """The key columns of the folders that the batch falls into; the others are not read."""
    touched = sorted(r[0] for r in staged.select(column).distinct().collect())
    schema = staged.select(*cols, column).schema
    held = spark.read.schema(schema).parquet(path)
    return held.where(F.col(column).isin(touched)).select(*cols)


def compact(spark: SparkSession, path: str, column: str, most_files: int = MOST_FILES) -> list[int]:
    """Put together the folders that hold more than ``most_files`` files; which ones.

    Their rows are staged in the shared folder first, so that a broken run loses none.
    """
    full = []
    for folder in list_folder(spark, path):
        name = folder.getPath().getName()
        if name.startswith(f"{column}=") and len(list_folder(spark, str(folder.getPath()))) > most_files:
            full.append(int(name.split("=")[1]))
    if full:
        staged = durable(spark.read.parquet(path).where(F.col(column).isin(full)))
        staged.repartition(column).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return sorted(full)


def append_ignore(
    spark: SparkSession, path: str, batch: DataFrame, unique: Keys, order
) -> None:
    """Insert-or-ignore into the Parquet table at ``path``. With a unique key, running it
    again adds nothing.

    A table with one unique key is stored by the hash of the key. The batch is computed
    once, meets the key columns of its own folders only, and puts their files together
    when they have become many. Readers see the folders' column behind the table's own.
    A table of fewer rows than folders has no folders and no such column; its rows are written
    anew by key when a batch brings it to as many. Larger ones without folders stay as they are.
    """
    exists = path_exists(spark, path)
    column = bucket_column(spark, path) if exists else None
    held = 0
    if len(unique) == 1 and exists and column is None:
        keys = spark.read.schema(batch.select(*unique[0]).schema).parquet(path)
        held = keys.limit(BUCKETS).count()
    by_key = len(unique) == 1 and (column is not None or held < BUCKETS)
    if by_key and column is None:
        batch = durable(batch)
        by_key = held + batch.count() >= BUCKETS
    if not by_key:
        new = batch
        if unique and exists:
            columns = sorted({c for cols in unique for c in cols})
            target = spark.read.schema(batch.select(*columns).schema).parquet(path)
            new = rows_to_insert(conflicting_rows(target, batch, unique), batch, unique, order)
        elif unique:
            new = rows_to_insert(batch.limit(0), batch, unique, order)
        new.write.mode("append").parquet(path)
        return
    cols = unique[0]
    if column is None:
        column = f"key{BUCKETS}"
        if held:
            few = durable(spark.read.parquet(path).select("*", bucket(cols, column)))
            few.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)
        exists = held > 0
        staged = batch.select("*", bucket(cols, column))
    else:
        staged = durable(batch.select("*", bucket(cols, column)))
    target = touched_rows(spark, path, staged, cols, column) if exists else staged.limit(0)
    new = rows_to_insert(target, staged, unique, order)
    new.repartition(column).write.mode("append").partitionBy(column).parquet(path)
    compact(spark, path, column)


def update_by_key(
    target: DataFrame, updates: DataFrame, key: str, column: str, order
) -> DataFrame:
    """Set ``column`` by key. The last by ``order`` of several updates of a key holds;
    updates of unknown keys do nothing."""
    by = _order(order)
    new = updates.groupBy(F.col(key).alias("_k")).agg(
        F.max_by(column, by[0] if len(by) == 1 else F.struct(*by)).alias("_new")
    )
    kind = target.schema[column].dataType
    return (
        target.join(new, F.col(key) == F.col("_k"), "left")
        .withColumn(column, F.coalesce(F.col("_new").cast(kind), F.col(column)))
        .select(*target.columns)
    )


def purge_bot(table: DataFrame, author: str) -> DataFrame:
    return table.filter(survives_purge(author))


def count_rows(tables: Mapping[str, DataFrame], *excluded: str) -> DataFrame:
    """(table_name, rows_n) per table, empty tables included.

    Each table is counted on its own. Of a table read by ``footer_table``, also behind
    projections, only the files' footers are read.
    """
    from forumlake.sources.tables import table_names

    names = table_names(tables, *excluded)
    spark = next(iter(tables.values())).sparkSession
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = [tables[n].agg(F.count(F.lit(1)).alias("rows_n")).select(F.lit(n).alias("table_name"), "rows_n")
              for n in names]
    return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame(
        [], "table_name string, rows_n long")


def row_count_snapshot(tables: Mapping[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """Rows for the count history, which does not count itself."""
    stamp = F.current_timestamp() if as_of is None else as_of
    return count_rows(tables, "row_count_history").select(
        "table_name", F.col("rows_n").cast("bigint").alias("row_count"),
        stamp.cast("timestamp_ntz").alias("created_at"),
    )


def append_row_counts(tables: Mapping[str, DataFrame], path: str,
                      as_of: Column | None = None) -> None:
    row_count_snapshot(tables, as_of).coalesce(1).write.mode("append").parquet(path)


def checksum(columns: Sequence[str]) -> Column:
    """Sum over all rows of a number taken from the row's MD5; the order of rows does not matter."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")), F.lit(0))


def exact_columns(table: DataFrame) -> list[str]:
    """The columns whose text is the same everywhere: all but floating and nested ones."""
    kinds = ("string", "int", "bigint", "boolean", "date")
    return [f.name for f in table.schema if f.dataType.simpleString() in kinds]


def export_snapshot(
    tables: Mapping[str, DataFrame], base: str, epoch: int, compression: str = "zstd"
) -> str:
    """All tables, compressed, below ``base``/``epoch``. Refuses to write over an export.

    A manifest beside them has a row per table: table_name, rows_n, checksum. Both are observed
    while the rows are written, so that no table is read again for them.
    """
    folder = f"{base.rstrip('/')}/{int(epoch)}"
    found = []
    for name, table in tables.items():
        seen = Observation(f"export {name}")
        watched = table.observe(
            seen, F.count(F.lit(1)).alias("rows_n"), checksum(exact_columns(table)).alias("checksum"))
        watched.write.mode("errorifexists").option("compression", compression).parquet(
            f"{folder}/{name}"
        )
        found.append((name, seen.get["rows_n"], seen.get["checksum"]))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(found, "table_name string, rows_n long, checksum long").coalesce(1).write.json(
        f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What an export holds, as it was observed."""
    return spark.read.schema("table_name string, rows_n long, checksum long").json(f"{folder}/manifest")


def with_ids(target: DataFrame | None, new: DataFrame, order) -> DataFrame:
    """``new`` with ``id``, which goes on from the largest id of ``target`` in ``order``."""
    largest = 0 if target is None else target.agg(F.max("id")).first()[0] or 0
    numbered = running_number(new.withColumn("_all", F.lit(0)), "_all", order, "id").drop("_all")
    return numbered.withColumn("id", (F.col("id") + largest).cast("int"))
