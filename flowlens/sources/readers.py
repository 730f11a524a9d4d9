"""Scans. Give a schema where there is one: inferring it reads the whole file once more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, *, schema: str | None = None, quote: str = '"', header: bool = True, rename: dict[int, str] | None = None) -> DataFrame:
    """A CSV file or folder; rename: names of columns by position, for files without a header.

    Only whole times are taken for times when types are inferred: a clock alone stays text, and gets no date of today.
    """
    reader = spark.read.option("header", header).option("quote", quote).option("inferSchema", schema is None).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    df = (reader.schema(schema) if schema else reader).csv(str(path))
    return df.withColumnsRenamed({df.columns[k]: n for k, n in (rename or {}).items()})


def read_lines(spark: SparkSession, path: str, column: str = "pattern") -> DataFrame:
    """The first tab-separated field of each line."""
    return spark.read.option("header", False).option("sep", "\t").option("quote", "").schema(f"{column} string").csv(str(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(str(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV, by the path's ending."""
    return read_parquet(spark, path) if str(path).lower().endswith(".parquet") else read_csv(spark, path)
