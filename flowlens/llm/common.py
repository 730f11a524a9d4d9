"""Shared helpers: folders every executor sees, ASCII folding, row keys, joins that survive hot keys."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import new_path, remove, shared_dir, stage

__all__ = ["attach", "fold_ascii", "free", "new_path", "remove", "shared_dir", "ship", "stage"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key is hot once it holds more than one row in HOT_SHARE; so at most HOT_SHARE keys are hot.
HOT_SHARE = 256
#: Side tables up to this many bytes may be broadcast; beyond it every operator has a shuffled way.
BROADCAST_BYTES = 16 << 20

def free(spark: SparkSession, wait: bool = True) -> None:
    """Let Spark drop the shuffle files of finished jobs, whose results are written, before the next ones need disk.

    Python's references to plans go first, in the background, and the JVM's cleaner follows its collector, so both get a
    moment, but for small tables, whose files do not matter (wait).
    """
    for _ in range(1 + wait):
        gc.collect()
        time.sleep(0.5 * wait)
        spark._jvm.System.gc()
    time.sleep(1.0 * wait)


def fold_ascii(text: Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else. Pure-ASCII texts take the cheaper lower()."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def attach(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, *, wide: str | None = None) -> DataFrame:
    """Left join to a right side that is unique on keys, where column rows counts the left rows of each key.

    Keys with over total / HOT_SHARE rows are at most HOT_SHARE and are broadcast, so their left rows
    stay where they are; the rest is joined by a shuffle. Keys must not be null. rows is dropped. wide: a column that may be
    long; of the hot rows only as many are broadcast, the hottest first, as BROADCAST_BYTES holds, the others
    being left to the shuffle, where adaptive execution splits them.
    """
    least = max(1, total // HOT_SHARE)
    if wide:
        size = F.octet_length(wide) if right.schema[wide].dataType.typeName() in ("string", "binary") else F.size(wide) * 16
        held = 0
        for n, size in right.where(F.col(rows) > least).select(rows, size.alias("size")).orderBy(F.desc(rows)).limit(2 * HOT_SHARE).collect():
            held += size or 0
            if held > BROADCAST_BYTES:
                least = n
                break
    hot = F.broadcast(right.where(F.col(rows) > least).drop(rows))
    cold = right.where(F.col(rows) <= least).drop(rows)
    return left.join(hot, keys, "inner").unionByName(left.join(hot.select(keys), keys, "left_anti").join(cold, keys, "left"))


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context, where they have no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_flowlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # Spark's file server hands it out for as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/flowlens_package.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{folder}/flowlens_package.zip")
    sc._flowlens_shipped = True
