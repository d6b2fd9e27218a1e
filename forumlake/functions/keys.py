"""Registry keys ``<kind>_<id>`` and model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def registry_key(kind: str, member) -> Column:
    return F.concat(F.lit(f"{kind}_"), _col(member).cast("string"))


def strip_kind(key, kind: str) -> Column:
    """Removes every occurrence of the prefix text, not only the first."""
    return F.replace(_col(key), F.lit(f"{kind}_"), F.lit(""))


def full_model_name(name) -> Column:
    c = _col(name)
    return F.when(c.contains(":"), c).otherwise(F.concat(c, F.lit(":latest")))
