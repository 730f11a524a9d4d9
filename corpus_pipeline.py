"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Every stage works on all that the one before kept. The first four return the columns of documents; the
last returns the encoded documents, ids and all. Columns that documents have beside these stay, whatever their
names; very long texts and null texts, null ids and empty tables pass through each stage as its
operator defines. Decisions are by id: where several texts share an id, they stay if one of them does;
of rows that repeat id and text, exact dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import new_path
from flowlens.llm.decontaminate import decontaminate
from flowlens.llm.exact_dedup import exact_dedup
from flowlens.llm.quality import held_out, quality_scores
from flowlens.llm.sentencepieces import default_model, piece_digest
from flowlens.llm.simhash import simhash_components


def _free_name(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose id is among decided's; the ids that stay are distinct."""
    kept = _free_name(docs, "kept_id")
    ids = decided.select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[kept]), "left_semi")


def _once(docs: DataFrame) -> DataFrame:
    """docs with one row of each that repeat id and text; texts are only compared where ids repeat."""
    again, rows = _free_name(docs, "again_id"), _free_name(docs, "rows_of_id")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 1).select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return docs
    same = docs["doc_id"].eqNullSafe(repeated[again])
    return docs.join(repeated, same, "left_anti").unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier predicts as label 1; held-out rows are never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _keep(docs, quality_scores(docs, labels, train_on=~held_out(F.col("id"))).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents that are equal but for the case of A-Z, the one with the smallest id."""
    return _keep(_once(docs), exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that SimHash links connect."""
    return _keep(docs, simhash_components(docs).where("doc_id <=> component_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _keep(docs, decontaminate(docs, items).where("NOT contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, how many, their crc, and whether decoding them restores the text."""
    return piece_digest(docs, model=default_model(), with_ids=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", encode)]

#: SQL can express neither the classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "pipeline-" + name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
