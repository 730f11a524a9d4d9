"""Times: lenient parsing, microseconds since the epoch, logical clocks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The accepted forms of a time, most precise first. The last one is common in bank exports.
FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm[:ss]")


def parse_timestamp(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first form that fits, null if none does; the first T counts as a blank."""
    spaced = F.regexp_replace(text, "^([^T]*)T", "$1 ")
    return F.coalesce(*(F.try_to_timestamp(spaced, F.lit(f)) for f in formats))


def timestamp_value(value: Column, kind: T.DataType) -> Column:
    """A time from a column of any type; strings are parsed, what does not fit is null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(kind, T.DateType):
        return value.cast("timestamp_ntz")
    return parse_timestamp(value) if isinstance(kind, T.StringType) else value.try_cast("timestamp")


def time_us(value: Column) -> Column:
    """Microseconds since the epoch; the session's time zone should be UTC."""
    return F.unix_micros(value.cast("timestamp"))


def from_epoch_us(value: Column) -> Column:
    return F.timestamp_micros(value)


def logical_time(step: Column, step_size: timedelta, origin: datetime) -> Column:
    """origin + step * step_size for ordinal steps. The origin must carry a time zone."""
    if origin.tzinfo is None:
        raise ValueError("the origin of logical time needs a time zone")
    if step_size <= timedelta(0):
        raise ValueError("step_size must be positive")
    us = timedelta(microseconds=1)
    start = (origin - datetime(1970, 1, 1, tzinfo=origin.tzinfo) - (origin.utcoffset() or timedelta(0))) // us
    return F.timestamp_micros(F.lit(start) + step.cast("long") * F.lit(step_size // us))
