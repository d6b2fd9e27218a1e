"""Time functions. "Now" is always a parameter so that a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts=None) -> Column:
    return F.unix_timestamp(F.current_timestamp() if ts is None else _col(ts).cast("timestamp"))


def epoch_text(ts=None) -> Column:
    return epoch_seconds(ts).cast("string")


def epoch_to_timestamp(epoch) -> Column:
    """Epoch seconds as a number or as text."""
    return F.timestamp_seconds(_col(epoch).cast("bigint"))


def iso_text(ts) -> Column:
    """``2024-01-01 00:00:07+00:00``"""
    return F.date_format(_col(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ssxxx")


def iso_json(ts) -> Column:
    """``2024-01-01T00:00:07+00:00``, with six decimals if there is a fraction."""
    c = _col(ts).cast("timestamp")
    return F.when(
        F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def day_of(ts) -> Column:
    return F.to_date(_col(ts))


def day_start(ts) -> Column:
    return F.date_trunc("day", _col(ts))


def parse_day(text, pattern: str = "yyyy-MM-dd") -> Column:
    return F.to_date(_col(text), pattern)


def elapsed_seconds(start, end) -> Column:
    """Whole seconds between two epoch times, cut off."""
    return (_col(end) - _col(start)).cast("int")


def tokens_per_second(eval_count, eval_duration_ns) -> Column:
    return F.try_divide(
        _col(eval_count).cast("double"), _col(eval_duration_ns).cast("double")
    ) * F.lit(1e9)
