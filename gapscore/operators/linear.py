"""Per-goal linear models over TF-IDF weights, applied to all goals in one pass."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.functions.text import goal_key, preview
from gapscore.operators.tfidf import Vocabulary, tfidf
from gapscore.storage import small_side

# One model row is an array over the vocabulary: 40 KB at 5,000 terms.
MAX_BROADCAST_MODELS = 2_000

# Labels of a probed sample and the strict threshold between them.
MATCH, NO_MATCH, MATCH_ABOVE = "MATCH", "NO MATCH", 0.5


@dataclass(frozen=True)
class GoalModels:
    """A vocabulary and ``table(goal, intercept, coefficients)``, one row per goal."""

    vocabulary: Vocabulary
    table: DataFrame


def pack_models(coefficients: DataFrame, intercepts: DataFrame, vocabulary_size: int) -> DataFrame:
    """Rows ``(goal, term_id, coef)`` to one coefficient array per goal; absent terms count 0."""
    positions = intercepts.select("goal", F.explode(F.sequence(F.lit(0), F.lit(vocabulary_size - 1))).alias("term_id"))
    dense = positions.join(coefficients, ["goal", "term_id"], "left").select(
        "goal", F.struct("term_id", F.coalesce("coef", F.lit(0.0)).alias("coef")).alias("entry")
    )
    # The group of a goal has exactly vocabulary_size entries.
    packed = dense.groupBy("goal").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return intercepts.join(packed, "goal").select(
        "goal", "intercept", F.col("entries.coef").alias("coefficients")
    )


def unpack_models(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverse of ``pack_models``."""
    rows = models.select("goal", F.posexplode("coefficients").alias("term_id", "coef"))
    return rows, models.select("goal", "intercept")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _probability() -> Column:
    """NULL without a model; the intercept alone decides for a text without known terms."""
    coefficients = F.col("coefficients")
    products = F.zip_with("indices", "weights", lambda i, w: w * F.get(coefficients, i))
    return sigmoid(F.aggregate(products, F.lit(0.0), lambda total, p: total + p) + F.col("intercept"))


def by_goal_key(table: DataFrame) -> DataFrame:
    """Models under their normalised goal key; of several with one key that named like the key stays, or the first."""
    keyed = table.withColumn("_key", goal_key(F.col("goal")))
    order = F.struct(F.col("goal") != F.col("_key"), F.col("goal"))
    chosen = keyed.groupBy("_key").agg(F.min(order).alias("_first")).select("_key", F.col("_first.goal").alias("goal"))
    return keyed.join(chosen, ["_key", "goal"], "left_semi")


def apply_models(weighted: DataFrame, table: DataFrame, goal_column: str, exact: bool = False) -> DataFrame:
    """Add ``probability`` to rows that have ``indices`` and ``weights``.

    Goals meet under their key, as training files are named by it and requests by the display name;
    ``exact`` compares the names as they are.
    """
    if exact:
        keyed, goal = table.withColumn("_key", F.col("goal")), F.col(goal_column)
    else:
        keyed, goal = by_goal_key(table), goal_key(F.col(goal_column))
    keyed = keyed.select(F.col("_key").alias("_model_goal"), "intercept", "coefficients")
    joined = weighted.join(small_side(keyed, MAX_BROADCAST_MODELS), goal == F.col("_model_goal"), "left")
    return joined.withColumn("probability", _probability()).drop(
        "_model_goal", "intercept", "coefficients", "indices", "weights"
    )


def model_probability(df: DataFrame, models: GoalModels, text_column: str, goal_column: str) -> DataFrame:
    """Add the ``probability`` that the text matches its goal; NULL where the goal has no model."""
    return apply_models(tfidf(df, text_column, models.vocabulary), models.table, goal_column)


def score_all_goals(samples: DataFrame, text_column: str, models: GoalModels, keys: list[str]) -> DataFrame:
    """Every sample against every model: probability, label and the start of the text."""
    # As many names as there are models.
    goals = sorted(row.goal for row in models.table.select("goal").collect())
    weighted = tfidf(samples.select(*keys, text_column), text_column, models.vocabulary)
    each_goal = F.explode(F.from_json(F.lit(json.dumps(goals)), "array<string>")).alias("goal")
    start = preview(F.col(text_column)).alias("preview")
    per_goal = weighted.select(*keys, start, "indices", "weights", each_goal)
    scored = apply_models(per_goal, models.table, "goal", exact=True)
    label = F.when(F.col("probability") > MATCH_ABOVE, MATCH).otherwise(NO_MATCH)
    return scored.select(*keys, "goal", "probability", label.alias("label"), "preview")
