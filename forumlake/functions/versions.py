"""Semantic versions: validity test and sort key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_plain_version(version) -> Column:
    """Three numbers with dots and nothing else."""
    return _col(version).rlike(r"^\d+\.\d+\.\d+$")


def version_key(version) -> Column:
    """A struct that sorts by SemVer precedence.

    Numbers compare as numbers, a pre-release comes before its release, numeric
    identifiers come before textual ones, build metadata is ignored.
    """
    plain = F.split_part(_col(version), F.lit("+"), F.lit(1))
    core = F.split_part(plain, F.lit("-"), F.lit(1))
    pre = F.when(plain.contains("-"), F.expr("NULL").cast("string")).otherwise(F.lit(""))
    pre = F.coalesce(pre, F.regexp_extract(plain, r"^[^-]*-(.*)$", 1))

    def identifier(x):
        number = F.when(x.rlike(r"^[0-9]+$"), x.try_cast("bigint"))
        return F.struct(
            number.isNull().alias("is_text"),
            F.coalesce(number, F.lit(0)).alias("number"),
            x.alias("text"),
        )

    return F.struct(
        F.transform(F.split(core, r"\."), lambda x: x.try_cast("bigint")).alias("core"),
        (pre == "").alias("is_release"),
        F.transform(F.split(pre, r"\."), identifier).alias("pre"),
    )
