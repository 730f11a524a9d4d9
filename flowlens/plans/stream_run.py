"""Running a streaming plan over what is there and reading its result as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import new_path


def drain(stream: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows that stream gives for all data there is now, as a table in the shared folder.

    Progress and state are checkpointed there too, so that lost executors are made up for. Without keys rows
    are appended. With keys, which tell a result's rows apart, each batch writes the rows that it changed into a folder of its
    own, and the last version of each row counts: state is still dropped behind the watermark, and windows that
    the watermark has not passed at the end are there all the same.
    """
    spark = stream.sparkSession
    out, progress = new_path(spark, "stream-out"), new_path(spark, "stream-progress")
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: E731  a batch that is tried again replaces its folder
    run = writer.outputMode("update" if keys else "append").foreachBatch(each).start()
    run.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(out)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__x"))
    return last.select(*keys, "__x.*").select(*stream.columns)
