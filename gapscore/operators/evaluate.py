"""Hold-out metrics per goal from rows ``(goal, label, probability)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.operators.linear import MATCH_ABOVE


def predicted() -> Column:
    return (F.col("probability") > MATCH_ABOVE).cast("int")


def _count(actual: int, guess: int) -> Column:
    return F.count_if((F.col("label") == actual) & (predicted() == guess))


def accuracy(predictions: DataFrame) -> DataFrame:
    right = (predicted() == F.col("label")).cast("double")
    return predictions.groupBy("goal").agg(F.count("*").alias("tested"), F.avg(right).alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("goal").agg(
        _count(0, 0).alias("tn"), _count(0, 1).alias("fp"), _count(1, 0).alias("fn"), _count(1, 1).alias("tp")
    )


def precision_recall(predictions: DataFrame) -> DataFrame:
    """For goals with both labels among the tested rows; 0 where nothing can be divided."""
    counts = predictions.groupBy("goal").agg(
        _count(0, 1).alias("fp"),
        _count(1, 0).alias("fn"),
        _count(1, 1).alias("tp"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    both = counts.filter(F.col("low") < F.col("high"))
    return both.select(
        "goal",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
