"""Global order without a single task: rows are range-partitioned by the whole order key, and parts carry offsets.

The sorted rows are written once, so that what counts the parts and what reads the rows see the same ones, also after
lost executors. How many parts there are follows from the size of the data; a value of the first key that
very many rows share is split by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stage

#: Bytes of input files, compressed as they are, that a part should stand for.
PART_BYTES = 64 << 20
_PART, _AT = "__ord_part", "__ord_at"


def input_bytes(df: DataFrame) -> int:
    """The size of all that df is computed from; Catalyst's estimates of joins multiply their sides, so only sources count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.length()))


def sorted_parts(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """df, written in the order of order_by: __ord_part rises with the order, __ord_at is the place within it from 0.

    The size of the input sets the number of parts where it asks for more than the session's shuffle partitions; below that,
    adaptive execution merges small ones.
    """
    parts = min(-(-input_bytes(df) // PART_BYTES), 1_000_000)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order_by) if parts > usual else df.repartitionByRange(*order_by)
    place = F.monotonically_increasing_id()  # the partition above, the row within it in the low 33 bits
    placed = dealt.sortWithinPartitions(*order_by).withColumn(_AT, place)
    table = stage(placed, "sorted")
    return table.withColumns({_PART: F.shiftright(_AT, 33).cast("int"), _AT: F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))})


def with_row_index(df: DataFrame, order_by: list[Column], name: str = "row_index") -> DataFrame:
    """df with the position of each row from 0 in the order of order_by."""
    rows = sorted_parts(df, order_by)
    return _offset(rows, {name: F.col(_AT)}, {name: F.count(F.lit(1))})


def running_sums(df: DataFrame, order_by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the running sum, up to and including each row, of every column in sums."""
    w = W.partitionBy(_PART).orderBy(_AT).rowsBetween(W.unboundedPreceding, 0)
    return _offset(sorted_parts(df, order_by), {n: F.sum(c).over(w) for n, c in sums.items()}, {n: F.sum(c) for n, c in sums.items()})


def running_max(df: DataFrame, order_by: list[Column], columns: list[str]) -> DataFrame:
    """df with each of columns replaced by its greatest value up to and including the row; null before the first one."""
    rows = sorted_parts(df, order_by)
    w = W.partitionBy(_PART).orderBy(_AT).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(_PART).agg(*(F.max(c).alias(f"__before_{c}") for c in columns))  # a row for each part
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(_PART, *(F.max(f"__before_{c}").over(before).alias(f"__before_{c}") for c in columns))
    out = rows.withColumns({c: F.max(c).over(w) for c in columns}).join(F.broadcast(ends), _PART)
    return out.withColumns({c: F.greatest(c, f"__before_{c}") for c in columns}).drop(_PART, _AT, *(f"__before_{c}" for c in columns))


def with_previous(df: DataFrame, order_by: list[Column], columns: dict[str, str]) -> DataFrame:
    """df with columns (new name: column) of the row ahead in the order of order_by, null for the first."""
    rows = sorted_parts(df, order_by)
    w = W.partitionBy(_PART).orderBy(_AT)
    ends = rows.groupBy(_PART).agg(*(F.max_by(F.struct(F.col(c).alias("v")), _AT).alias(f"__end_{n}") for n, c in columns.items()))
    nexts = W.orderBy(_PART)  # a row for each part
    ends = ends.select(F.lead(_PART).over(nexts).alias(_PART), *(f"__end_{n}" for n in columns)).where(F.col(_PART).isNotNull())
    out = rows.withColumns({n: F.lag(c).over(w) for n, c in columns.items()}).join(F.broadcast(ends), _PART, "left")
    return out.withColumns({n: F.when(F.col(_AT) > 0, F.col(n)).otherwise(F.col(f"__end_{n}.v")) for n in columns}).drop(_PART, _AT, *(f"__end_{n}" for n in columns))


def _offset(rows: DataFrame, inside: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    per_part = rows.groupBy(_PART).agg(*(c.alias(n) for n, c in totals.items()))  # a row for each part
    w = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    before = per_part.select(_PART, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"__before_{n}") for n in totals))
    out = rows.withColumns(inside).join(F.broadcast(before), _PART)
    return out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in totals}).drop(_PART, _AT, *(f"__before_{n}" for n in totals))
