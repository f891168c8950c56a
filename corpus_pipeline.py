"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote and returns the columns of documents; the last returns pieces of
sequences. A stage that loses an executor repeats its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapscore.llm.line_dedup import GONE, without_repeated_chunks, without_repeated_passages
from gapscore.llm.mixing import mixed_documents
from gapscore.llm.near_copies import without_near_copies
from gapscore.llm.packing import packed
from gapscore.llm.quality import good_documents
from gapscore.llm.queries import vocabulary
from gapscore.llm.work import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled good text takes; the others go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks and passages of two or more lines that occur earlier in the table.

    Chunks meet as in operator 7. They miss passages whose chunk ends differ, so what they leave is then found exactly, by
    pairs of lines in a row.
    """
    chunks = without_repeated_chunks(docs, counts=False, gone=GONE)
    return without_repeated_passages(docs, with_chunks=chunks)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies (Jaccard similarity of 0.8 over five-word runs) of an earlier one.

    SimHash fingerprints link rows as in operator 9, and an exact comparison follows. 4 differing bits of 64 are a similarity
    of about 0.97, so the near copies that fingerprints leave in are then found exactly, by rare shingles.
    """
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that a document, or part of it, is taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packed(docs, *vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Model weights, XXH64 and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between the stages lie in the shared folder until the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
