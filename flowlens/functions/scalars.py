"""Scalar expressions, all built from functions that Catalyst can generate code for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\f\v  　"


def strip(text: Column) -> Column:
    """A string without white space at its ends."""
    return F.btrim(text, F.lit(_BLANKS))


def strip_string(value: Column) -> Column:
    """Any value as a stripped string."""
    return strip(value.cast("string"))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def floor_divide(a: Column, b: int) -> Column:
    """The greatest whole number up to a / b of whole numbers, exactly: quotients of decimals and doubles are rounded before a floor sees them."""
    b = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def bucket_of(value: Column, bins: Sequence[int]) -> Column:
    """The last bin whose lower bound value reaches, from 0; -1 below the first. The last bin is open-ended."""
    out = F.lit(-1)
    for k, low in enumerate(bins):
        out = F.when(value >= low, F.lit(k)).otherwise(out)
    return out


def bucket_counts(value: Column, bins: Sequence[int], weight: Column | None = None) -> list[Column]:
    """One sum per bin of weight (1 by default) over the rows whose value falls into it."""
    weight = F.lit(1) if weight is None else weight
    at = bucket_of(value, bins)
    return [F.coalesce(F.sum(F.when(at == k, weight)), F.lit(0)).cast("long") for k in range(len(bins))]


def register_functions(spark: SparkSession) -> None:
    """The functions here under names in SQL, for this session: flow_strip, flow_safe_divide, flow_clamp, flow_sigmoid, flow_bucket (array of lower bounds)."""
    blanks = "".join(f"\\u{ord(c):04x}" for c in _BLANKS)
    made = {
        "flow_strip(x STRING) RETURNS STRING": f"btrim(x, '{blanks}')",
        "flow_safe_divide(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "coalesce(try_divide(a, b), 0D)",
        "flow_clamp(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "greatest(least(x, high), low)",
        "flow_sigmoid(x DOUBLE) RETURNS DOUBLE": "1D / (1D + exp(-x))",
        "flow_bucket(x BIGINT, bins ARRAY<INT>) RETURNS INT": "size(filter(bins, b -> b <= x)) - 1",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
