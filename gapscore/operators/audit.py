"""Checks of the dictionaries, the vocabulary, the models and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore.config import REQUIRED_FIELDS
from gapscore.functions.text import MODEL_SUFFIX, goal_key
from gapscore.operators.extract import extract_skills
from gapscore.schemas import CHECK
from gapscore.sources.dictionaries import RuleTables, SkillRules
from gapscore.storage import local_table

# The states of a check.
OK, WARNING, DEGRADED, ERROR = "ok", "warning", "degraded", "error"

# The messages of the checks.
CONFIG_OK = "Config loaded successfully"
CONFIG_BAD = "Invalid config format"
VECTORIZER_OK = "Vectorizer loaded successfully"
VECTORIZER_BAD = "Vectorizer load failed"
VECTORIZER_ABSENT = "TF-IDF vectorizer not found"
MODELS_DONE = "Models check completed: %d loaded, %d failed"
MODELS_ABSENT = "No trained models found"
GOALS_OK = "Goals loaded successfully"
GOALS_ABSENT = "Goals not found"
REGISTRY_DONE = "Registry check completed"
REGISTRY_ABSENT = "Model registry not found (optional)"


def _details(**values: Column) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def _check(name: str, status: Column, message: Column, details: Column) -> list[Column]:
    return [F.lit(name).alias("check"), status.alias("status"), message.alias("message"), details.alias("details")]


def _names(column: str) -> Column:
    """A sorted list of dictionary keys as one string."""
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def check_config(spark: SparkSession, raw: dict) -> DataFrame:
    missing = [field for field in REQUIRED_FIELDS if field not in raw and field != "log_score_details"]
    if missing:
        row = ("config", ERROR, CONFIG_BAD, [("missing_fields", ", ".join(missing))])
    else:
        details = [
            ("version", str(raw["version"])),
            ("supported_goals", str(len(raw["model_goals_supported"]))),
            ("min_score_threshold", str(raw["minimum_score_to_pass"])),
        ]
        row = ("config", OK, CONFIG_OK, details)
    return local_table(spark, [row], CHECK)


def _absent(spark: SparkSession, name: str, status: str, message: str) -> DataFrame:
    return local_table(spark, [(name, status, message, [])], CHECK)


def check_vocabulary(spark: SparkSession, vocabulary: DataFrame | None) -> DataFrame:
    if vocabulary is None:
        return _absent(spark, "vectorizer", ERROR, VECTORIZER_ABSENT)
    size = vocabulary.agg(F.count("*").alias("size"))
    filled = F.col("size") > 0
    return size.select(
        *_check(
            "vectorizer",
            F.when(filled, OK).otherwise(ERROR),
            F.when(filled, VECTORIZER_OK).otherwise(VECTORIZER_BAD),
            _details(vocabulary_size=F.col("size")),
        )
    )


def check_models(expected: DataFrame, models: DataFrame) -> DataFrame:
    """Expected goals against stored models: all, some or none of them."""
    stored = models.select(goal_key(F.col("goal")).alias("key"), F.lit(True).alias("stored")).distinct()
    wanted = expected.select(goal_key(F.col("goal")).alias("key")).distinct()
    counts = wanted.join(stored, "key", "left").agg(
        F.count("stored").alias("loaded"), F.count_if(F.col("stored").isNull()).alias("failed")
    )
    loaded, failed = F.col("loaded"), F.col("failed")
    status = F.when(loaded == 0, ERROR).when(failed > 0, DEGRADED).otherwise(OK)
    message = F.when(loaded == 0, MODELS_ABSENT).otherwise(
        F.format_string(MODELS_DONE, loaded, failed)
    )
    return counts.select(
        *_check("models", status, message, _details(loaded=loaded, failed=failed, total_models=loaded + failed))
    )


def check_vocabulary_files(probed: DataFrame) -> DataFrame:
    """From the ``PROBED`` rows of the vocabulary: absent, unreadable, empty or fine."""
    counts = probed.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("size"), F.min("error").alias("error")
    )
    fine = F.col("error").isNull() & (F.col("size") > 0)
    message = F.when(F.col("files") == 0, VECTORIZER_ABSENT).when(fine, VECTORIZER_OK).otherwise(VECTORIZER_BAD)
    details = F.when(F.col("error").isNotNull(), _details(error=F.col("error"))).otherwise(_details(vocabulary_size=F.col("size")))
    return counts.select(*_check("vectorizer", F.when(fine, OK).otherwise(ERROR), message, details))


def check_model_files(probed: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """From the ``PROBED`` rows of the models, by goal: models that open, files that do not, and expected goals without one.

    Files that fail degrade the check, and so do goals that are expected and not in any readable file.
    """
    opened = probed.select(F.explode("names").alias("goal")).select(goal_key(F.col("goal")).alias("key")).distinct()
    broken = probed.filter("error IS NOT NULL").agg(
        F.count("*").alias("failed"), F.array_join(F.array_sort(F.collect_set(F.substring_index("path", "/", -1))), ", ").alias("failed_files")
    )
    wanted = opened.select("key") if expected is None else expected.select(goal_key(F.col("goal")).alias("key")).distinct()
    have = opened.withColumn("have", F.lit(1))
    counts = wanted.withColumn("want", F.lit(1)).join(have, "key", "full").agg(
        F.count("have").alias("loaded"), F.count_if(F.col("have").isNull()).alias("absent")
    )
    # Two tables of one row each.
    both = counts.withColumn("one", F.lit(1)).join(broken.withColumn("one", F.lit(1)), "one")
    loaded, failed, absent = F.col("loaded"), F.col("failed"), F.col("absent")
    status = F.when(loaded == 0, ERROR).when(failed + absent > 0, DEGRADED).otherwise(OK)
    message = F.when((loaded == 0) & (failed == 0), MODELS_ABSENT).otherwise(F.format_string(MODELS_DONE, loaded, failed))
    details = _details(loaded=loaded, failed=failed, absent=absent, failed_files=F.col("failed_files"))
    return both.select(*_check("models", status, message, details))


def check_goals(spark: SparkSession, sizes: DataFrame | None) -> DataFrame:
    """From the table of ``goal_sizes``. Malformed entries are counted; they do not fail the check."""
    if sizes is None:
        return _absent(spark, "goals", ERROR, GOALS_ABSENT)
    counts = sizes.agg(
        F.count("*").alias("goals"), F.sum("skills").alias("skills"), F.count_if("malformed").alias("malformed")
    )
    return counts.select(
        *_check(
            "goals",
            F.lit(OK),
            F.lit(GOALS_OK),
            _details(
                total_goals=F.col("goals"),
                total_skills=F.coalesce("skills", F.lit(0)),
                invalid_format=F.col("malformed"),
            ),
        )
    )


def registered_without_model(registry: DataFrame, models: DataFrame) -> DataFrame:
    stored = models.select(goal_key(F.col("goal")).alias("_stored")).distinct()
    return registry.join(stored, goal_key(F.col("goal")) == F.col("_stored"), "left_anti")


def check_registry(spark: SparkSession, registry: DataFrame | None, models: DataFrame) -> DataFrame:
    """Registry entries without a stored model are a warning; so is a registry that is not there."""
    if registry is None:
        return _absent(spark, "registry", WARNING, REGISTRY_ABSENT)
    missing = registered_without_model(registry, models).agg(
        F.count("*").alias("missing"), _names("model_path").alias("missing_files")
    )
    totals = registry.agg(
        F.count("*").alias("registered"), (F.count("accuracy") > 0).alias("has_metrics")
    )
    # Two tables of one row each.
    both = missing.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one")
    return both.select(
        *_check(
            "registry",
            F.when(F.col("missing") == 0, OK).otherwise(WARNING),
            F.lit(REGISTRY_DONE),
            _details(
                registered_models=F.col("registered"),
                missing_files=F.col("missing_files"),
                has_metrics=F.col("has_metrics"),
            ),
        )
    )


def roll_up(checks: DataFrame) -> DataFrame:
    """One overall status. Any check that is not ok degrades; the performance check never does."""
    blocking = checks.filter(F.col("check") != "performance")
    bad = F.count_if(F.col("status") != OK)
    return blocking.agg(
        F.when(bad > 0, DEGRADED).otherwise(OK).alias("status"),
        F.count("*").alias("checks"),
        bad.alias("not_ok"),
    )


def dictionary_survivors(universe: DataFrame, rules: SkillRules | RuleTables) -> DataFrame:
    """For each skill: is it still found in a text that is just its own name?"""
    probed = extract_skills(universe.select("skill"), "skill", rules, "found")
    return probed.select("skill", F.array_contains("found", F.col("skill")).alias("survives"))


def model_file(goal: Column) -> Column:
    return F.concat(goal_key(goal), F.lit(MODEL_SUFFIX))
