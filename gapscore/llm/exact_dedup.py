"""Exact duplicates up to white space: one 128-bit hash, then the bytes themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The six characters that the comparison ignores, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: which document of its group of equal texts stays.

    Texts are equal if the same without white space. Of a group the text with the most code points
    stays, then the one with the smallest id. Returns doc_id, keep_id, group_size, kept and
    text_sha256.

    Texts meet under their MD5, as grouping keys beside it: Spark compares the bytes of such keys, so
    a collision gives two groups. Copies are counted before the shuffle, so a group of any size
    arrives as one row from each task. Documents then look up their group by MD5 and SHA-256
    without the text; this join has no aggregate behind it and adaptive execution splits a hot key.

    Defined cases: a null text is an empty one, and all empty texts are one group; a null id comes
    last and can be kept only by a longer text or for want of another; of rows that repeat the id and
    length of the text that stays one is kept, the first in reading order, and each counts in
    group_size; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    body = normalised(F.col(text))
    groups = (
        docs.select(
            F.unhex(F.md5(body)).alias("hash"),
            body.alias("body"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("length"),
            F.col(doc_id).alias("id"),
        )
        .groupBy("hash", "body", "length")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"))
        .select("hash", F.unhex(F.sha2("body", 256)).alias("sha"), "length", "id", "n")
        .groupBy("hash", "sha")
        .agg(
            F.max(F.struct(F.col("length"), F.bitwise_not("id").alias("id"))).alias("best"),
            F.sum("n").alias("group_size"),
        )
        .select(
            "hash",
            "sha",
            F.bitwise_not(F.col("best.id")).alias("keep_id"),
            F.col("best.length").alias("keep_length"),
            "group_size",
        )
    )
    members = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.md5(body)).alias("hash"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("length"),
    )
    found = members.join(groups, ["hash", "sha"]).withColumn("row", F.monotonically_increasing_id())
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    # Rows that cannot stay are spread by their number; one row, as a rule, is left for each group.
    in_group = Window.partitionBy("hash", "sha", F.when(best, -1).otherwise(F.col("row"))).orderBy("row")
    return found.withColumn("place", F.row_number().over(in_group)).select(
        "doc_id",
        "keep_id",
        "group_size",
        (best & (F.col("place") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
