"""Training items from files named ``training_<goal>.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore import schemas

FILE_PATTERN = r"training_([^/]+?)\.json(?:/|$)"


def read_training(spark: SparkSession, paths: str | list[str], one_array_per_file: bool = True) -> DataFrame:
    """Rows ``(goal, resume_text, label, file, broken)``; the goal comes from the file name.

    A file may be one JSON array, which is read as a stream of items, or hold one item per line,
    which Spark can split. ``training_<goal>.json`` may also be a folder of such files. Unreadable
    content becomes rows with ``broken`` set instead of failing the job; an array with an unreadable
    item is unreadable as a whole.
    """
    file = F.col("_metadata.file_path")
    # File paths are URL-encoded.
    goal = F.url_decode(F.regexp_extract(file, FILE_PATTERN, 1)).alias("goal")
    reader = spark.read.schema(f"{schemas.TRAINING_ITEM}, broken STRING")
    read = reader.json(paths, multiLine=one_array_per_file, columnNameOfCorruptRecord="broken")
    # Spark refuses to read the column of broken records alone, so it is tied to another one.
    broken = F.when(F.col("resume_text").isNotNull() | F.col("broken").isNotNull(), F.col("broken")).alias("broken")
    items = read.select(goal, "resume_text", "label", file.alias("file"), broken)
    # A file without items still names its goal. Only the names are read here.
    named = spark.read.format("binaryFile").load(paths).select(goal, file.alias("file"))
    empty = named.join(items.select("file").distinct(), "file", "left_anti")
    nothing = F.lit(None).cast("string")
    return items.unionByName(
        empty.select("goal", nothing.alias("resume_text"), nothing.alias("label"), "file", nothing.alias("broken"))
    )


def readable(items: DataFrame) -> DataFrame:
    return items.filter(F.col("broken").isNull()).select("goal", "resume_text", "label")


def quarantined(items: DataFrame) -> DataFrame:
    """Unreadable records per file."""
    bad = items.filter(F.col("broken").isNotNull())
    return bad.groupBy("goal", "file").agg(F.count("*").alias("records"))
