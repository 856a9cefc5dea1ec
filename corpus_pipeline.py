"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. Quality is learnt from the labels of documents that the
quality query doesn't hold out. Texts that a stage shortens get a new n_chars.

Null and empty texts are documents without content: one of them stays, and packing gives it the end id alone. Null and
repeated ids are rows like others; rows of equal id and text are copies. Without labels of both classes, quality is one
constant. Empty tables give no rows. Columns of any name besides doc_id and text go through unchanged (n_chars follows
the text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peergraph.llm import labelled, packing, quality, queries, repeats, secrets, simhash
from peergraph.llm.common import shared_dir, table


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that no name of theirs meets an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("own"))


def _together(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns again, with that text."""
    return rows.select(*[F.col("doc_id") if c == "doc_id" else F.col(text).alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in columns])


def _counted(documents: DataFrame) -> DataFrame:
    """documents with n_chars to match the text."""
    return documents.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), labelled.fold("doc_id", 5) != 0)
    return _together(quality.score(_apart(docs), model).where("score >= 0.3"), docs.columns, "text")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity 0.8 or more on 5-word shingles), the document with the smallest id stays."""
    return simhash.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that occur earlier go from the texts; every document stays."""
    return _counted(_together(repeats.remove(_apart(docs), as_text=True, array=1 << 18), docs.columns, "kept"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), remembered=1 << 17)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scans),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
