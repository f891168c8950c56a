"""Vocabulary, model and registry tables on shared storage, as versions of one set.

A version is a folder with all four tables. A pointer file names the current one and is switched last, by a rename, so
a reader sees one version whole, and a save that fails changes nothing.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore import files
from gapscore.operators.linear import GoalModels, unpack_models
from gapscore.operators.linear_joined import JoinedModels
from gapscore.operators.tfidf import MAX_VOCABULARY, load_vocabulary
from gapscore.storage import local_table

TABLES = ("vocabulary", "stop_words", "models", "registry")
_POINTER = "CURRENT"


def save_models(
    folder: str, vocabulary: DataFrame, stop_words: list[str], models: DataFrame, registry: DataFrame
) -> str:
    """Store a set of tables as the current version, and return its name."""
    spark = vocabulary.sparkSession
    version = f"{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    tables = dict(zip(TABLES, (vocabulary, _word_table(spark, stop_words), models, registry)))
    for name, table in tables.items():
        table.write.parquet(f"{folder}/versions/{version}/{name}")
    use_version(spark, folder, version)
    return version


def use_version(spark: SparkSession, folder: str, version: str) -> None:
    """Make a stored version the current one, also an earlier one again."""
    if version not in stored_versions(spark, folder):
        raise ValueError(f"{folder} has no version {version}")
    files.put_text(spark, f"{folder}/{_POINTER}", version, replace=True)


def current_version(spark: SparkSession, folder: str) -> str | None:
    return files.read_text(spark, f"{folder}/{_POINTER}")


def stored_versions(spark: SparkSession, folder: str) -> list[str]:
    """All versions, oldest first, those of failed saves included."""
    return sorted(name for name, _ in files.children(spark, f"{folder}/versions"))


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` versions and the current one."""
    stored, current = stored_versions(spark, folder), current_version(spark, folder)
    gone = [v for v in stored[: max(0, len(stored) - keep)] if v != current]
    for version in gone:
        files.delete(spark, f"{folder}/versions/{version}")
    return gone


def _word_table(spark: SparkSession, words: list[str]) -> DataFrame:
    return local_table(spark, [(word,) for word in words], "word STRING")


def read_table(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame | None:
    """A table of the current version, or of the one named; None if it was never written."""
    version = version or current_version(spark, folder)
    if version is None:
        return None
    try:
        return spark.read.parquet(f"{folder}/versions/{version}/{name}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry kept as one JSON file: ``{models: {goal: file}, metrics: {goal: {...}}}``."""
    metric = "struct<accuracy: double, samples: bigint, positive_samples: bigint, negative_samples: bigint, feature_count: int>"
    schema = f"models map<string,string>, metrics map<string,{metric}>"
    content = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    entries = content.select(F.explode("r.models").alias("goal", "model_path"), F.col("r.metrics").alias("metrics"))
    return entries.select("goal", "model_path", F.col("metrics")[F.col("goal")].alias("m")).select(
        "goal", "model_path", "m.*"
    )


def load_models(spark: SparkSession, folder: str, version: str | None = None) -> GoalModels | JoinedModels | None:
    """The stored models; None, and so scoring by coverage, without a vocabulary or models.

    A vocabulary too large for the workers stays a table. All come from one version, and are read from it for as long as they are used. A goal without a row
    in the model table is scored by coverage as well.
    """
    version = version or current_version(spark, folder)
    if version is None:
        return None
    vocabulary, words, models = (read_table(spark, folder, name, version) for name in TABLES[:3])
    if vocabulary is None or models is None:
        return None
    stop_words = [row.word for row in words.collect()] if words is not None else []
    if vocabulary.count() > MAX_VOCABULARY:
        return JoinedModels(vocabulary, *unpack_models(models), tuple(stop_words))
    return GoalModels(load_vocabulary(vocabulary, stop_words), models)
