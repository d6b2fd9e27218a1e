"""Join forms that keep to hash or sort-merge joins at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.functions.documents import fields
from forumlake.functions.keys import full_model_name

# A side is broadcast by hint only after a count showed it to be below this.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, otherwise leave it to the planner.

    The count stops after ``max_rows`` + 1 rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


DOCUMENT_FIELDS = ("post_id", "comment_id", "reference_id", "category", "llm")


def with_id_columns(documents: DataFrame, document: str = "analysis_document") -> DataFrame:
    """Documents with the ids they name, their category and model as columns.

    Stored like this, the queries read the narrow columns and leave the JSON text alone.
    """
    return with_named(documents, DOCUMENT_FIELDS, document)


def with_named(
    documents: DataFrame, names: Sequence[str], document: str = "analysis_document"
) -> DataFrame:
    """Documents with the given fields as columns: stored columns if the table has them
    all, otherwise one parse of the document."""
    if set(names) <= set(documents.columns):
        return documents
    return fields(documents.drop(*names), document, *names)


def named_ids(
    documents: DataFrame, names: Sequence[str], document: str = "analysis_document"
) -> DataFrame:
    """The given fields only, one column each."""
    return with_named(documents, names, document).select(*names)


def document_ids(
    documents: DataFrame, names: Sequence[str], document: str = "analysis_document",
    out: str = "id",
) -> DataFrame:
    """Distinct ids found under any of the given fields.

    Distinct before the join: many documents of one item become one row on the
    map side, so a heavily documented item does not make a heavy partition.
    """
    return (
        named_ids(documents, names, document).select(F.explode(F.array(*names)).alias(out))
        .filter(F.col(out).isNotNull()).distinct()
    )


def without_documents(
    items: DataFrame, key: str, documents: DataFrame, names: Sequence[str],
    document: str = "analysis_document",
) -> DataFrame:
    """Items that no document names under any of the fields.

    Takes the place of NOT EXISTS with an OR and of LEFT JOIN … IS NULL, which
    would run as nested loops.
    """
    ids = document_ids(documents, names, document, "_id")
    return items.join(ids, F.col(key) == F.col("_id"), "left_anti")


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """SQL ``key NOT IN (SELECT right_key …)``: any NULL on the right leaves nothing,
    and a NULL on the left stays only if the right side is empty.

    One scalar aggregate tells the three cases apart; the rest is a plain anti-join.
    """
    rows, known = F.count(F.lit(1)), F.count(right_key)
    all_or_none = right.agg(
        F.when(rows == 0, True).when(rows > known, False).alias("all_or_none")
    ).scalar()
    other = right.select(F.col(right_key).alias("_r")).distinct()
    kept = left.join(other, F.col(key) == F.col("_r"), "left_anti")
    return kept.filter(F.coalesce(all_or_none, F.col(key).isNotNull()))


def new_ids(feed: DataFrame, feed_key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Distinct feed ids that the table does not hold."""
    known = table.select(F.col(table_key).alias("_known"))
    ids = feed.select(feed_key).distinct()
    return ids.join(known, F.col(feed_key) == F.col("_known"), "left_anti")


def subtract_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def with_model(rows: DataFrame, name: str, models: DataFrame) -> DataFrame:
    """Join the model inventory by full name; rows of unknown models are dropped. Of several
    inventory rows with a name one counts, the first by its values."""
    named = models.withColumnRenamed("name", "model_name")
    row = F.struct(*named.columns)
    inventory = named.groupBy("model_name").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    inventory = inventory.select("_row.*")
    return rows.join(
        broadcast_if_small(inventory), full_model_name(name) == F.col("model_name"), "inner"
    )


def each_of(rows: DataFrame, values: Sequence[str], out: str, pos: str) -> DataFrame:
    """One row per row and list value, with the position in the list."""
    listed = F.array(*[F.lit(v) for v in values])
    return rows.select("*", F.posexplode(listed).alias(pos, out))


def with_price(
    usage: DataFrame, model: str, prices: DataFrame, tokens: Column, kind: str = "chat",
    size: str = "completion", per: float = 1000.0,
) -> DataFrame:
    """Cost of the tokens of each row; models without a price get NULL."""
    listed = prices.filter((F.col("kind") == kind) & (F.col("size") == size)).select(
        F.col("model").alias("_model"), F.col("price")
    )
    return (
        usage.join(broadcast_if_small(listed), F.col(model) == F.col("_model"), "left")
        .drop("_model")
        .withColumn("cost", tokens.cast("double") / F.lit(per) * F.col("price"))
    )
