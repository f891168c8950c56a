"""Linear scores with vocabularies and models of any size, by joins of sparse rows.

A text becomes rows of terms, which meet the vocabulary and the coefficients of the text's goal; what is left of a text
is a sum of squares and a partial dot product for each of its rows, added up by text. Nothing that grows with the vocabulary is
held by the driver or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.functions.text import goal_key
from gapscore.operators import linear
from gapscore.operators.linear import GoalModels, by_goal_key, sigmoid
from gapscore.operators.tfidf import known_counts, term_counts
from gapscore.storage import local_table, materialise, small_side

#: The most frequent terms meet texts by a table of their own, so that no key of the shuffled join is in most texts.
HOT_TERMS = 10_000

_ROW = "_linear_row"


@dataclass(frozen=True)
class JoinedModels:
    """Vocabulary (term, term_id, df, idf), coefficients (goal, term_id, coef) and intercepts (goal, intercept) as tables."""

    vocabulary: DataFrame
    coefficients: DataFrame
    intercepts: DataFrame
    stop_words: tuple[str, ...] = ()


def _met(keyed: DataFrame, vocabulary: DataFrame, stop_words: list[str]) -> DataFrame:
    """(row, goal, term_id, raw): the known terms of the texts with their unscaled weights."""
    keys, ranks = [_ROW, "_goal"], vocabulary.select("term", "term_id", "idf", "df")
    hot = materialise(ranks.orderBy(F.desc("df"), "term").limit(HOT_TERMS).drop("df"), "hot-terms")
    counts = term_counts(keyed, "_text", stop_words, keys)
    if (often := small_side(hot)) is hot:
        met = counts.join(hot, "term")
    else:
        # Texts are read for these terms alone, which are then numbers.
        known = [row.term for row in hot.select("term").distinct().filter(F.col("term").isNotNull()).collect()]
        numbers = local_table(keyed.sparkSession, zip(known, range(len(known))), "term STRING, place BIGINT")
        met = known_counts(keyed, "_text", stop_words, keys, known).join(F.broadcast(numbers.join(often, "term")), "place").drop("place")
    if len(ranks.select("term").take(HOT_TERMS + 1)) > HOT_TERMS:
        rest = ranks.drop("df").join(small_side(hot.select("term")), "term", "left_anti")
        seldom = counts.join(small_side(hot.select("term")), "term", "left_anti").join(rest, "term")
        met = met.unionByName(seldom)
    raw = ((1 + F.log("tf")) * F.col("idf")).alias("raw")
    return met.select(_ROW, "_goal", "term_id", raw)


def model_probability(df: DataFrame, models: GoalModels | JoinedModels, text_column: str, goal_column: str) -> DataFrame:
    """Add ``probability``; NULL where the goal has no model. A text without known terms has its intercept alone.

    Models that workers can hold are applied in the text's row. For others goals meet under their key as well, and
    coefficients are looked up by goal and term. A small table of them meets the terms where they are counted, and sums
    leave the task. With a larger one terms are written and shuffled; that join has no aggregate behind it, so adaptive
    execution splits a pair that very many texts share.
    """
    if isinstance(models, GoalModels):
        return linear.model_probability(df, models, text_column, goal_column)
    rows = materialise(df.withColumn(_ROW, F.monotonically_increasing_id()), "linear-rows")
    chosen = by_goal_key(models.intercepts).select("goal", F.col("_key").alias("_goal"), "intercept")
    keyed = rows.select(_ROW, goal_key(F.col(goal_column)).alias("_goal"), F.col(text_column).alias("_text"))
    # A text whose goal has no model keeps its row, and has no use for terms.
    keyed = keyed.join(small_side(chosen.select("_goal")), "_goal", "left_semi")
    terms = _met(keyed, models.vocabulary, list(models.stop_words))
    coefficients = models.coefficients.join(small_side(chosen.select("goal", "_goal")), "goal").select("_goal", "term_id", "coef")
    if (of_goal := small_side(coefficients)) is coefficients:
        terms = materialise(terms, "linear-terms")
    product = (F.col("raw") * F.coalesce("coef", F.lit(0.0))).alias("product")
    products = terms.join(of_goal, ["_goal", "term_id"], "left").select(_ROW, "raw", product)
    sums = products.groupBy(_ROW).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"), F.sum("product").alias("_dot"))
    heads = chosen.select(F.col("_goal").alias("_key"), "intercept")
    joined = rows.join(sums, _ROW, "left").join(small_side(heads), goal_key(F.col(goal_column)) == F.col("_key"), "left")
    margin = F.coalesce(F.col("_dot") / F.col("_norm"), F.lit(0.0)) + F.col("intercept")
    return joined.withColumn("probability", sigmoid(margin)).drop(_ROW, "_norm", "_dot", "_key", "intercept")
