import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlens.plans.experiment import TabularExperiment, baseline
from flowlens.plans.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame = frame.assign(**{c: frame[c].round(5) + 0.0})
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False)))


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, str(SF)).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_experiment(spark):
    rows = [(k, float(k % 10), float(k % 3), int(k % 10 > 6)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, label int")
    e = TabularExperiment(baseline("forest", numTrees=5), ["a", "b"]).fit(df)
    r = e.evaluate(df, tie="k", budgets=[20]).first()
    assert r.roc_auc > 0.95 and r.precision_at_20 == 1.0 and e.importances()["a"] > 0.8
    assert e.evaluate(df.where("label = 1"), tie="k") is None
    weighted = TabularExperiment(baseline("logistic", weight_col="w"), ["a"]).fit(df.withColumn("w", F.lit(2.0)))
    assert 0 <= weighted.score(df).first().score <= 1
    with pytest.raises(ValueError):
        weighted.importances()
    with pytest.raises(ValueError):
        baseline("none")
    with pytest.raises(ValueError):
        TabularExperiment(baseline(), ["a"]).score(df)


def test_entry_works_without_the_llm_folders(tmp_path):
    import shutil

    shutil.copytree(ROOT / "flowlens", tmp_path / "flowlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith(('op', 'pipeline')) and n[2:3].isdigit() for n in q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"}, check=True, timeout=120)


def test_evaluation_computes_its_rows_once(spark):
    n = spark.sparkContext.accumulator(0)

    def counted(x: float) -> float:
        n.add(1)
        return x

    df = spark.range(60).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("a"))
    e = TabularExperiment(baseline("logistic", maxIter=3), ["a"]).fit(df)
    out = e.evaluate(df.withColumn("a", F.udf(counted, "double")("a")), tie="id", threshold=0.3, budgets=[5]).collect()
    assert len(out) == 1 and n.value == 60
