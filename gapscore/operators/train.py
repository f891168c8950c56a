"""One logistic regression per goal over shared TF-IDF features."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore import schemas
from gapscore.functions.text import MODEL_SUFFIX
from gapscore.operators.evaluate import accuracy, confusion, precision_recall, predicted
from gapscore.operators.linear import apply_models
from gapscore.operators.solve import MEDIUM_VALUES, SMALL_ROWS, SMALL_VALUES, fit_shared, fit_small
from gapscore.operators.split import (
    CROSS_VALIDATE,
    TRAIN,
    class_weights,
    content_id,
    folds,
    stratified_split,
    training_counts,
    training_gate,
    usable_items,
)
from gapscore.operators.tfidf import Vocabulary, tfidf_batches
from gapscore.storage import local_table, materialise, small_side

# Fixed value: the solver's iteration limit.
MAX_ITERATIONS = 1000

# Fits are driver-side loops of small jobs; a few at a time keep the cluster busy.
PARALLEL_FITS = 8


@dataclass(frozen=True)
class Training:
    """What a training run leaves: models, registry and metrics tables, and why goals were skipped."""

    models: DataFrame
    registry: DataFrame
    metrics: DataFrame
    cross_validated: DataFrame
    skipped: DataFrame


def vector_parts(indices: Column, weights: Column, size: int) -> Column:
    """A sparse vector as Spark ML stores it: read under ``VectorUDT`` it is one."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        indices.cast("array<int>").alias("indices"),
        weights.alias("values"),
    )


def fit(rows: DataFrame, n: int) -> tuple[float, list[float]]:
    """L2-regularised logistic regression on ``(label, weight, features)`` rows.

    ``regParam`` 1/n turns Spark's averaged loss into the summed loss with unit penalty.
    """
    solver = LogisticRegression(
        weightCol="weight",
        maxIter=MAX_ITERATIONS,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
    )
    model = solver.fit(rows.select(F.col("label").cast("double"), "weight", "features"))
    return float(model.intercept), [float(c) for c in model.coefficients.toArray()]


def _fit_all(train_rows: DataFrame, size: int) -> tuple[DataFrame, list[tuple]]:
    """(models, failures): every goal of ``train_rows`` fitted; one that fails is reported and the others go on.

    All goals small enough for a task are fitted by one job, whatever their number. Medium ones share their passes over the rows,
    as a job for each step of each goal would cost more than its work. A larger goal is a Spark ML job of its own, and a few of
    these run at a time.
    """
    spark = train_rows.sparkSession
    values = F.size(F.unwrap_udt("features").indices)
    # Written, because the goals are told apart by it, and read for the failures.
    sizes = materialise(
        train_rows.groupBy("goal").agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"), F.sum(values).alias("values")), "sizes"
    )
    in_a_task = (F.col("n") <= SMALL_ROWS) & (F.col("values") <= SMALL_VALUES)
    small = train_rows.join(small_side(sizes.filter(in_a_task).select("goal")), "goal", "left_semi")
    fitted = materialise(fit_small(small, size), "fitted")

    def one(row):
        try:
            return (row.goal, *fit(train_rows.filter(F.col("goal") == row.goal), row.n)), None
        except Exception as error:  # noqa: BLE001 - one goal must not stop the others
            return None, (row.goal, f"failed: {error}")

    rest, done = sizes.filter(~in_a_task).collect(), []
    failed = [(r.goal, "failed: all training samples have the same label") for r in rest if r.classes < 2]
    medium = {r.goal: r.n for r in rest if r.classes > 1 and r["values"] <= MEDIUM_VALUES}
    shared = fit_shared(train_rows, medium, size)
    failed += [(goal, f"failed: {found}") for goal, found in shared.items() if isinstance(found, Exception)]
    found = [(goal, float(x[-1]), x[:-1].tolist()) for goal, x in shared.items() if not isinstance(x, Exception)]
    large = [r for r in rest if r.classes > 1 and r.goal not in medium]
    if large:
        with ThreadPool(min(PARALLEL_FITS, len(large))) as pool:
            done = pool.map(inheritable_thread_target(spark)(one), large)
    found += [model for model, _ in done if model]
    models = fitted.filter("error IS NULL").drop("error")
    if found:
        models = models.unionByName(local_table(spark, found, schemas.GOAL_MODELS))
    unfit = [(r.goal, r.error) for r in fitted.filter("error IS NOT NULL").select("goal", "error").collect()]
    return models, unfit + failed + [reason for _, reason in done if reason]


def _with_weights(rows: DataFrame) -> DataFrame:
    return rows.join(small_side(class_weights(rows)), ["goal", "label"])


def _predict(rows: DataFrame, models: DataFrame, goal_column: str) -> DataFrame:
    parts = F.unwrap_udt("features")
    weighted = rows.withColumns({"indices": parts.indices, "weights": parts["values"]}).drop("features")
    return apply_models(weighted, models, goal_column, exact=True)


def _cross_validate(small: DataFrame, size: int) -> tuple[DataFrame, list[tuple]]:
    """Mean and spread of the fold accuracies of goals with few samples. No model is kept.

    A goal with a fold that cannot be fitted is reported as failed.
    """
    folded = materialise(folds(small, "item_id"), "folds")
    # Each fold's training rows under a goal name of their own: "goal<tab>fold".
    held = folded.select("goal", "fold").distinct().withColumnRenamed("fold", "held")
    training = folded.join(held, "goal").filter(F.col("fold") != F.col("held"))
    named = training.withColumn("goal", F.concat_ws("\t", "goal", "held")).drop("held", "fold")
    table, failed = _fit_all(materialise(_with_weights(named), "fold-training", ["goal"]), size)
    reasons = dict((goal.split("\t")[0], reason) for goal, reason in sorted(failed))
    tested = folded.withColumn("_fold_goal", F.concat_ws("\t", "goal", "fold"))
    right = (predicted() == F.col("label")).cast("double")
    by_fold = (
        _predict(tested, table, "_fold_goal").groupBy("goal", "fold").agg(F.avg(right).alias("accuracy"))
    )
    summary = by_fold.groupBy("goal").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy")
    )
    return summary.filter(~F.col("goal").isin(list(reasons))), sorted(reasons.items())


def train(training: DataFrame, vocabulary: Vocabulary) -> Training:
    """Train every goal of ``training(goal, resume_text, label)`` that has enough samples.

    A column ``item_id``, unique within a goal, fixes the split; without it the content does, whatever the
    files and their order. Ids are drawn by the part before a ``#``.

    More than 20 samples: 60 % of them, stratified, train a model and the rest measure it.
    10 to 20: cross-validated accuracy only. Fewer: skipped.
    """
    spark = training.sparkSession
    size = len(vocabulary.terms)
    items = usable_items(training)
    # One row per goal.
    gate = training_gate(training.select("goal").distinct(), items).collect()
    action = {row.goal: row.action for row in gate}
    skipped = [(g, a) for g, a in sorted(action.items()) if a not in (TRAIN, CROSS_VALIDATE)]

    if "item_id" not in items.columns:
        items = items.withColumn("item_id", content_id())
    kept = [(g, a) for g, a in action.items() if (g, a) not in skipped]
    wanted = local_table(spark, kept, "goal STRING, action STRING")
    texts = items.join(small_side(wanted), "goal").select("goal", "action", "item_id", "label", "resume_text")
    weighted = tfidf_batches(texts, "resume_text", vocabulary)
    vector = vector_parts(F.col("indices"), F.col("weights"), size)
    # Written once, by goal: each fit then reads its own goal only. Rebalancing splits a goal
    # that holds much of the data over several files.
    features = materialise(
        weighted.select("goal", "action", "item_id", "label", "indices", "weights")
        .hint("rebalance", "goal")
        .select("goal", "action", "item_id", "label", vector.alias("features")),
        "features",
        ["goal"],
        {"features": VectorUDT()},
    )

    large = features.filter(F.col("action") == TRAIN).drop("action")
    split = stratified_split(large, "item_id")
    # Written with split and weights, so that a fit reads its goal and repeats no join.
    split = materialise(split, "split", ["goal"])
    train_rows = materialise(_with_weights(split.filter(~F.col("is_test"))), "training", ["goal"])
    models, failed = _fit_all(train_rows, size)
    test_rows = split.filter("is_test").join(small_side(models.select("goal")), "goal", "left_semi")
    # Kept, because registry and metrics each read them.
    predictions = materialise(
        _predict(test_rows, models, "goal").select("goal", "label", "probability"), "predictions"
    )

    metrics = (
        accuracy(predictions)
        .join(confusion(predictions), "goal")
        .join(precision_recall(predictions), "goal", "left")
    )
    counts = training_counts(items)
    registry = accuracy(predictions).join(counts, "goal").select(
        "goal",
        F.concat(F.replace(F.col("goal"), F.lit(" "), F.lit("_")), F.lit(MODEL_SUFFIX)).alias("model_path"),
        "accuracy",
        "samples",
        "positive_samples",
        "negative_samples",
        F.lit(size).alias("feature_count"),
    )

    small = features.filter(F.col("action") == CROSS_VALIDATE).drop("action")
    if CROSS_VALIDATE in action.values():
        cross_validated, fold_failures = _cross_validate(small, size)
        failed += fold_failures
    else:
        cross_validated = local_table(
            spark, [], "goal STRING, mean_accuracy DOUBLE, std_accuracy DOUBLE"
        )
    return Training(
        models=models,
        registry=registry,
        metrics=metrics,
        cross_validated=cross_validated,
        skipped=local_table(spark, skipped + failed, "goal STRING, reason STRING"),
    )
