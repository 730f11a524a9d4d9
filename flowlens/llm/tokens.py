"""Token ids in Parquet: list columns, dictionary or delta encoding, small row groups and pages with indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import pieces, raw
from .common import new_path, ship
from .unit_encoder import encoder_for

#: Bytes of texts encoded at once; what numpy holds meanwhile is some thirty times as much.
PIECE = 2 << 20
#: How token tables are written: dictionary pages for ids, delta encoding for the rising columns,
#: row groups of 16 MB, and pages of few rows, whose indexes let a reader fetch some documents alone.
LAYOUT = {
    "compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size": str(128 << 10), "parquet.page.row.count.limit": "256",
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#seq": "false", "parquet.enable.dictionary#start": "false", "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(docs: DataFrame, path: str, *, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write path/data: (doc_id, part, seq, ids) in ascending id order over files, parts and rows, and path/index.

    The texts, not the ids, are shuffled by ranges of the id; each task encodes its range in order, so files
    grow with the number of ranges and no task holds more than one. Rows with equal ids are ordered by
    text, null ids come first; null texts are empty and still get the end id. path/index has (doc_id, part,
    seq, start, n_tokens, ids_crc32), taken from the files in path/data: start is the number of ids of
    all rows before. Only the totals of parts, one row for each, meet in one task. Any tokenizer file works: where texts cannot
    be cut into units, they are encoded whole. An empty table gives empty tables; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocab)
        part, seq = TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text", PIECE):
            body = raw(piece, "text")
            ids, counts = encoder.encode(b"".join(body), np.array([len(t) for t in body], np.int64), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))
            n = len(body)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), lists], ["doc_id", "part", "seq", "ids"])
            seq += n

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, f"doc_id {kind}, part int, seq long, ids array<int>").write.options(**LAYOUT).parquet(f"{path}/data")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at, at[1:])]
            arrays = [b.column("doc_id"), b.column("part"), b.column("seq"), pa.array(np.diff(at).astype(np.int64)), pa.array(np.array(crc, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    meta = spark.read.parquet(f"{path}/data").mapInArrow(measure, f"doc_id {kind}, part int, seq long, n_tokens long, ids_crc32 long")
    meta.write.options(**LAYOUT).parquet(f"{path}/counts")
    meta = spark.read.parquet(f"{path}/counts")
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    index = meta.withColumn("inside", inside).join(before, "part").select("doc_id", "part", "seq", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    index.write.options(**LAYOUT).parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, seq, start, n_tokens, ids_crc32: no ids are read."""
    return spark.read.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, ids of the documents from low to high; the bounds reach the row groups and pages of the files."""
    data = spark.read.parquet(f"{path}/data").select("doc_id", "ids")
    if low is not None:
        data = data.where(F.col("doc_id") >= low)
    return data if high is None else data.where(F.col("doc_id") <= high)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written, read back and located."""
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocab=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
