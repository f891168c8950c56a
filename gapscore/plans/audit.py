"""The audit of everything scoring depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore.operators.audit import (
    check_config,
    check_goals,
    check_model_files,
    check_models,
    check_registry,
    check_vocabulary,
    check_vocabulary_files,
    model_file,
)
from gapscore.schemas import GOAL_MODELS
from gapscore.sources.models import current_version
from gapscore.sources.probe import probe_files
from gapscore.storage import local_table, materialise


def _usable(models: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """Goals whose model scoring can use: one coefficient for each term of the vocabulary."""
    if vocabulary is None or "coefficients" not in models.columns:
        return models.select("goal")
    return models.filter(F.size("coefficients") == vocabulary.count()).select("goal")


def audit(
    spark: SparkSession,
    config: dict,
    expected_goals: DataFrame,
    goal_sizes: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    models: DataFrame | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """One row per check; ``None`` stands for a table that is not there."""
    stored = _usable(models, vocabulary) if models is not None else local_table(spark, [], GOAL_MODELS).select("goal")
    return (
        check_config(spark, config)
        .unionByName(check_vocabulary(spark, vocabulary))
        .unionByName(check_models(expected_goals, stored))
        .unionByName(check_goals(spark, goal_sizes))
        .unionByName(check_registry(spark, registry, stored))
    )


def audit_files(
    spark: SparkSession,
    config: dict,
    folder: str,
    expected_goals: DataFrame,
    goal_sizes: DataFrame | None = None,
    version: str | None = None,
) -> DataFrame:
    """The same checks over a folder of stored models whose files may be unreadable; each is opened once.

    Checks the current version, or the one named.
    """
    version = version or current_version(spark, folder)
    at = f"{folder}/versions/{version}"
    models = materialise(probe_files(spark, f"{at}/models", "goal"), "probed-models")
    registry = materialise(probe_files(spark, f"{at}/registry", "goal"), "probed-registry")
    opened = models.select(F.explode("names").alias("goal"))
    listed = registry.select(F.explode("names").alias("goal"))
    listed = listed.select("goal", model_file(F.col("goal")).alias("model_path"), F.lit(None).cast("double").alias("accuracy"))
    readable = not registry.filter("error IS NULL").isEmpty()
    return (
        check_config(spark, config)
        .unionByName(check_vocabulary_files(probe_files(spark, f"{at}/vocabulary")))
        .unionByName(check_model_files(models, expected_goals))
        .unionByName(check_goals(spark, goal_sizes))
        .unionByName(check_registry(spark, listed if readable else None, opened))
    )
