"""Exact dedup: 128-bit content hashes, then bytes compared inside groups. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, attach, fold_ascii, stage


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after A-Z is lower-cased; a null text counts as empty. Rows are
    grouped by digest (128 bits) over narrow rows with map-side combining, so a text that a third of all
    rows share meets as one partial row a task. Only rows of groups of two or more are read again with
    their texts, which are grouped by (digest, bytes): a digest with more than one text is a collision,
    and its rows are grouped by the bytes themselves.

    keep: which id stays, "smallest" or "largest"; null ids come last, so one stays only where a group
    has nothing else. Exactly one row a group is kept, also where a row is repeated with its id. An
    empty table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = fold_ascii(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm"))
    hashed = rows.select("id", digest(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    sig = stage(hashed.withColumn("rid", F.monotonically_increasing_id()), "exact-sig")
    groups = stage(_grouped(sig, ["h"], keep), "exact-groups")
    total, many = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()

    again = groups.where("n > 1").select("h")
    if many * 24 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    texts = rows.select("id", "norm", digest(F.col("norm")).alias("h")).join(again, "h", "left_semi")
    byte_groups = texts.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n")).select("h")
    collided = stage(byte_groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "exact-collided")

    out = attach(sig, groups, ["h"], "rows", total)
    if not collided.isEmpty():
        apart = texts.withColumn("rid", F.monotonically_increasing_id()).join(collided, "h", "left_semi")
        apart = stage(apart.select("id", "rid", "norm", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-apart")
        own = attach(apart, stage(_grouped(apart, ["norm"], keep), "exact-apart-groups"), ["norm"], "rows", total, wide="norm").drop("norm")
        out = out.join(collided, "h", "left_anti").unionByName(own)
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _grouped(sig: DataFrame, by: list[str], keep: str) -> DataFrame:
    # the smallest id comes first in an order where null ids are last
    best = F.max(F.struct("id", "rid")) if keep == "largest" else F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid"))
    return sig.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), best.alias("best")).withColumn("best", F.struct("best.id", "best.rid")).withColumn("rows", F.col("n"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; of equal texts the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
