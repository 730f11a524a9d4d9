from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlens.functions import bucket_of, clamp, logical_time, parse_timestamp, safe_divide, sigmoid, strip, time_us
from flowlens.operators.ordering import running_sums, with_row_index
from flowlens.operators.schema import RESERVED, canonicalise, clean, concat_relaxed, find_column, repair_ids, usable_rows, with_unique_ids

from .helpers import us


def test_canonical_names(spark):
    raw = spark.createDataFrame([(" A ", "B", "2025-01-01", 10.0, 1)], ["Account", "Account_duplicated_0", "Timestamp", "Amount Received", "Is Laundering"])
    r = canonicalise(raw, source="Account").first()
    assert (r.transaction_id, r.source, r.target, r.timestamp, r.amount, r.label) == ("tx_0", "A", "B", "2025-01-01", 10.0, 1)
    assert r.Account == " A "


def test_date_and_time_columns(spark):
    raw = spark.createDataFrame([("a", "b", "2025-01-01", "10:35:19"), ("a", "b", "2025-01-02", "2025-01-01 09:00:00"), ("a", "b", "2025-01-03", "late")], ["Sender_account", "Receiver_account", "Date", "Time"])
    got = [r.timestamp for r in canonicalise(raw).orderBy("Date").collect()]
    assert got == [datetime(2025, 1, 1, 10, 35, 19), datetime(2025, 1, 1, 9), datetime(2025, 1, 3)]


def test_explicit_names_fall_back_to_aliases(spark):
    raw = spark.createDataFrame([("a", "b", "x")], ["source", "target", "id"])
    assert canonicalise(raw, source="nowhere").first().source == "a"
    assert find_column(["Source"], "nowhere", "source", missing="none") is None
    assert find_column(["a_b", "A.B"], "a b", "source") == "A.B"  # the later one wins


def test_missing_endpoint_and_reserved_name(spark):
    with pytest.raises(ValueError):
        canonicalise(spark.createDataFrame([(1.0,)], ["amount"]))
    with pytest.raises(ValueError):
        canonicalise(spark.createDataFrame([("a", "b", 1)], ["source", "target", RESERVED]))


def test_ids_are_kept_where_given(spark):
    raw = spark.createDataFrame([("a", "b", " t9 "), ("a", "b", " "), ("a", "b", None)], "source string, target string, id string").coalesce(1)
    assert sorted(r.transaction_id for r in canonicalise(raw).collect()) == ["t9", "tx_1", "tx_2"]


def test_clean(spark):
    rows = [("a", "x", 1.0, "known"), (None, "y", 2.0, None), ("", "z", 3.0, ""), ("b", "q", None, None), (None, None, None, None)]
    got = sorted((r.source, r.amount, r.category) for r in clean(spark.createDataFrame(rows, "source string, target string, amount double, category string")).collect())
    assert got == [("a", 1.0, "known"), ("b", 1.0, "UNKNOWN")]


def test_clean_parses_times_and_keeps_their_text(spark):
    df = spark.createDataFrame([("a", "b", "2022/09/01 00:20"), ("a", "b", "bad")], "source string, target string, `Booking Date` string")
    got = clean(df).orderBy("`Booking Date__raw`").collect()
    assert [r["Booking Date"] for r in got] == [datetime(2022, 9, 1, 0, 20), None] and [r["Booking Date__raw"] for r in got] == ["2022/09/01 00:20", "bad"]


def test_repair_ids(spark):
    given = ["dup", "dup", None, "one", "tx_0", "", "tx_5", "tx_0_1", "x"]
    df = spark.createDataFrame([(g, k) for k, g in enumerate(given)], f"transaction_id string, {RESERVED} long")
    got = {r[RESERVED]: r.transaction_id for r in repair_ids(df).collect()}
    assert got == {0: "tx_0_2", 1: "tx_1", 2: "tx_2", 3: "one", 4: "tx_0", 5: "tx_5_1", 6: "tx_5", 7: "tx_0_1", 8: "x"}
    assert len(set(got.values())) == len(given)


def test_row_index_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("one"))
    assert {(r.k, r.row_index) for r in with_row_index(df, [F.col("k")]).collect()} == {(k, k) for k in range(1000)}
    sums = running_sums(df, [F.desc("k")], {"c": F.col("one")}).collect()
    assert {(r.k, r.c) for r in sums} == {(k, 1000 - k) for k in range(1000)}
    assert with_row_index(df.limit(0), [F.col("k")]).count() == 0


def test_scalars(spark):
    r = spark.range(1).select(
        strip(F.lit(" \t x y\n")).alias("s"), safe_divide(F.lit(1), F.lit(0)).alias("z"), safe_divide(F.lit(1), F.lit(4)).alias("q"), clamp(F.lit(30.0), 0, 24).alias("c"), sigmoid(F.lit(0.0)).alias("g"), bucket_of(F.lit(5), [2, 4, 9]).alias("b"), bucket_of(F.lit(1), [2]).alias("below"),
        time_us(logical_time(F.lit(2), timedelta(hours=1), datetime(1970, 1, 1, tzinfo=timezone.utc))).alias("t"), parse_timestamp(F.lit("2025-01-01T09:00:00.25")).alias("p"), parse_timestamp(F.lit("x")).alias("n"),
    ).first()
    assert (r.s, r.z, r.q, r.c, r.g, r.b, r.below, r.t) == ("x y", 0.0, 0.25, 24.0, 0.5, 1, -1, 7_200_000_000)
    assert us(r.p) == us(datetime(2025, 1, 1, 9, 0, 0, 250_000)) and r.n is None
    with pytest.raises(ValueError):
        logical_time(F.lit(1), timedelta(hours=1), datetime(1970, 1, 1))


def test_a_hot_first_key_is_split(spark, monkeypatch):
    """Nearly all rows tie in the first key: parts hold about as much as the mean all the same."""
    from flowlens.operators import ordering

    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(5)).alias("a"), (F.col("id") * 7919 % 40_009).alias("b"))
    monkeypatch.setattr(ordering, "PART_BYTES", max(1, ordering.input_bytes(df) // 16))
    sizes = [r["count"] for r in ordering.sorted_parts(df, [F.col("a"), F.col("b")]).groupBy("__ord_part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = {(r.a, r.b): r.row_index for r in with_row_index(df, [F.col("a"), F.col("b")]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(40_000))


def test_previous_rows_and_running_greatest(spark, monkeypatch):
    import random

    from flowlens.operators import ordering

    r = random.Random(3)
    rows = [(k, r.choice([None, r.randrange(100)])) for k in range(500)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k int, v int").repartition(5)
    monkeypatch.setattr(ordering, "PART_BYTES", max(1, ordering.input_bytes(df) // 7))
    before = {x.k: x.p for x in ordering.with_previous(df, [F.col("k")], {"p": "v"}).collect()}
    assert before == {k: rows[k - 1][1] if k else None for k in range(500)}
    top = {x.k: x.v for x in ordering.running_max(df, [F.col("k")], ["v"]).collect()}
    assert top == {k: max((v for _, v in rows[: k + 1] if v is not None), default=None) for k in range(500)}


def test_unique_ids_are_neither_sorted_nor_joined(spark):
    df = spark.createDataFrame([(f" {k} ", k) for k in range(50)], "transaction_id string, t int")
    out = with_unique_ids(df, order_by=["t"])
    assert RESERVED not in out.columns and {r.transaction_id for r in out.collect()} == {str(k) for k in range(50)}
    again = with_unique_ids(df.unionByName(df.limit(1)), order_by=["t"])
    assert {r.transaction_id for r in again.collect()} == {"tx_0", "tx_1", *(str(k) for k in range(1, 50))}


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_few_and_many_bad_ids(spark, monkeypatch, size):
    from flowlens.operators import schema

    monkeypatch.setattr(schema, "ID_BYTES", size)
    df = spark.createDataFrame([(g, k) for k, g in enumerate(["a", "b", "a", None, "c", ""])], f"transaction_id string, {RESERVED} long")
    assert {r[RESERVED]: r.transaction_id for r in repair_ids(df).collect()} == {0: "tx_0", 1: "b", 2: "tx_2", 3: "tx_3", 4: "c", 5: "tx_5"}


def test_relaxed_concat(spark):
    a = spark.createDataFrame([(1, 2, "x", None)], "k int, v int, s string, n int")
    b = spark.createDataFrame([(10**10, 2.5, 7)], "k long, v double, s int")
    out = concat_relaxed([a, b])
    assert dict(out.dtypes) == {"k": "bigint", "v": "double", "s": "string", "n": "int"} and {(r.k, r.v, r.s) for r in out.collect()} == {(1, 2.0, "x"), (10**10, 2.5, "7")}
    with pytest.raises(ValueError):
        concat_relaxed([])
    with pytest.raises(ValueError):
        usable_rows(a, ["k"], limit=0)
