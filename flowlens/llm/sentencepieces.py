"""SentencePiece encoding and decoding of tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import pieces, texts
from .common import ship
from .pieces_model import SPACE, PieceModel

_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    return _models.get(path) or _models.setdefault(path, PieceModel(path))


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_pieces(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ids (array of int).

    Words are encoded once while a worker remembers them; no shuffle, and memory is bounded by pieces of batches, of which a
    very long text is one. Null and empty texts have no ids; rows may repeat, their id may be null; an empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("id"), _lists(m.encode(texts(piece, "text")))], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, *, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id, text; a U+2581 in the encoded text comes back as a blank.

    Ids are decoded from where the batch holds them, a text at a time. A null list or null in one counts as nothing; rows may
    repeat, their id may be null; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    ship(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            lists = b.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values
            none = lists.is_null().to_numpy(zero_copy_only=False)
            for at in range(0, len(lists), 256):
                out = []
                for k in range(at, min(at + 256, len(lists))):
                    part = flat.slice(ends[k], 0 if none[k] else ends[k + 1] - ends[k]).drop_null()
                    out.append(m.decode(part.to_numpy()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(out)), pa.array(out, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def piece_digest(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: the id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_bytes_spelled (ids of
    byte pieces), restored (whether decoding the ids gives the text back, a U+2581 as a blank), and with_ids the ids themselves.

    Null and empty texts have no ids, crc 0, and are restored. Rows may repeat, their id may be null; an empty table
    gives no rows; very long texts are worked on alone; other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        spelled = np.zeros(len(m.surface), bool)
        spelled[list(m.byte.values())] = True
        for piece in pieces(batches, "text"):
            body = texts(piece, "text")
            ids = m.encode(body)
            arrays = [np.frombuffer(x, "<u4") for x in ids]
            back = [m.decode(x) == t.replace(SPACE, " ") for x, t in zip(arrays, body)]
            columns = [[len(x) for x in arrays], [zlib.crc32(x) for x in ids], [int(spelled[x].sum()) for x in arrays]]
            made = [piece.column("id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(back)]
            yield pa.RecordBatch.from_arrays([*made, *([_lists(ids)] if with_ids else [])], ["id", "n_pieces", "ids_crc32", "n_bytes_spelled", "restored", *(["ids"] if with_ids else [])])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_pieces long, ids_crc32 long, n_bytes_spelled long, restored boolean" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: encoded, digested, and decoded again."""
    return piece_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model=default_model())
