import pytest
from pyspark.sql import functions as F

from flowlens.llm.arrow import pieces, raw
from flowlens.llm.common import HOT_SHARE, attach, fold_ascii, shared_dir, stage


def test_fold_ascii_touches_a_to_z_only(spark):
    rows = [("ABCxyz",), ("ÉÀ ABC ß ſ \u212a",), (None,), ("",), ("İI",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(fold_ascii(F.col("t"))).collect()]
    assert got == ["abcxyz", "ÉÀ abc ß ſ \u212a", "", "", "İi"]


def test_attach_equals_a_left_join(spark):
    left = spark.range(5_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("top")).where("k != 5")
    assert right.where(F.col("rows") > 5_000 // HOT_SHARE).count() >= 1
    got = attach(left, right, ["k"], "rows", 5_000)
    assert sorted(map(tuple, got.select("id", "top").collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").select("id", "top").collect()), key=str)


def test_stage_writes_to_the_named_folder(spark):
    df = stage(spark.range(3).toDF("x"), "some")
    assert df.count() == 3 and df.inputFiles()[0].startswith(shared_dir(spark).replace("file:", "file://", 1)[:5])


def test_pieces_are_bounded_and_whole():
    import pyarrow as pa

    texts = ["a" * k for k in (10, 0, 5_000, 30, 30)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], ["t", "k"])
    parts = list(pieces(iter([batch, batch.slice(0, 0)]), "t", 200))
    assert [x for p in parts for x in raw(p, "t")] == [(t or "").encode() for t in texts]
    assert len(parts) > 2 and [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
