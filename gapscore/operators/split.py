"""Training gates, stratified split, folds and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapscore.storage import small_side

# The share held out, the seed, and the sample counts that decide a goal's fate.
TEST_SHARE_PERCENT = 40
SEED = 42
MIN_SAMPLES = 10
CROSS_VALIDATE_UP_TO = 20
MAX_FOLDS = 5

# What the gate lets through; any other action names a reason for skipping the goal.
TRAIN, CROSS_VALIDATE = "train", "cross-validate"


def usable_items(training: DataFrame) -> DataFrame:
    """Items with both text and label; the label becomes a number, NULL if it is none."""
    complete = training.filter(F.col("resume_text").isNotNull() & F.col("label").isNotNull())
    return complete.withColumn("label", label_number(F.col("label")))


def label_number(label: Column) -> Column:
    """A label as a whole number: 1, 1.0, "1" and true are the same; NULL if it is none of these."""
    text = F.lower(F.trim(label.cast("string")))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(number), number).try_cast("int")


CONTENT = "#"


def content_id() -> Column:
    """An id for items without one: the hash of the content, then a number that tells equal items apart.

    Items are drawn by the hash alone. Which of several equal items is drawn makes no difference, so the
    split depends neither on the files nor on their order.
    """
    content = F.md5(F.concat_ws("\u0000", "goal", F.col("label").cast("string"), "resume_text"))
    return F.concat(content, F.lit(CONTENT), F.monotonically_increasing_id().cast("string"))


def training_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("goal").agg(
        F.count("*").alias("samples"),
        F.sum("label").alias("positive_samples"),
        (F.count("*") - F.sum("label")).alias("negative_samples"),
    )


def training_gate(goals: DataFrame, items: DataFrame) -> DataFrame:
    """What happens to each goal: training, cross-validation only, or the reason for neither."""
    per_label = items.groupBy("goal", "label").agg(F.count("*").alias("n"))
    per_goal = per_label.groupBy("goal").agg(
        F.sum("n").alias("samples"),
        F.sum(F.col("label") * F.col("n")).alias("positive_samples"),
        F.min("n").alias("rarest"),
        F.sum(F.when(F.col("label").isNull(), F.col("n"))).alias("unusable"),
    )
    counted = goals.join(per_goal, "goal", "left").fillna(0)
    samples = F.col("samples")
    action = (
        F.when(F.col("unusable") > 0, "a label is not a number")
        .when(samples == 0, "no data")
        .when(samples < MIN_SAMPLES, "not enough samples")
        .when(samples <= CROSS_VALIDATE_UP_TO, CROSS_VALIDATE)
        .when(F.col("rarest") < 2, "a label has one sample")
        .otherwise(TRAIN)
    )
    return counted.select(
        "goal",
        "samples",
        "positive_samples",
        (samples - F.col("positive_samples")).alias("negative_samples"),
        action.alias("action"),
    )


def split_sizes(strata: DataFrame) -> DataFrame:
    """From ``(goal, label, n)``: how many of each label are held out.

    The training share is rounded down per label; the labels with the largest remainders get
    the rows still missing, the lower label first on a tie.
    """
    goal = W.partitionBy("goal")  # one row per label
    total = F.sum("n").over(goal)
    test_total = F.ceil(total * TEST_SHARE_PERCENT / 100)
    product = F.col("n") * F.col("train_total")
    sized = (
        strata.withColumn("total", total)
        .withColumn("train_total", F.col("total") - test_total)
        .withColumn("base", F.floor(product / F.col("total")))
        .withColumn("remainder", product % F.col("total"))
        .withColumn("short", F.col("train_total") - F.sum("base").over(goal))
        .withColumn("turn", F.row_number().over(goal.orderBy(F.desc("remainder"), "label")))
    )
    train = F.col("base") + F.when(F.col("turn") <= F.col("short"), 1).otherwise(0)
    return sized.select("goal", "label", "n", train.alias("n_train"), (F.col("n") - train).alias("n_test"))


def draw(item_id: str, seed: int = SEED) -> Column:
    """A fixed pseudo-random order of the items."""
    drawn_by = F.substring_index(F.col(item_id).cast("string"), CONTENT, 1)
    return F.md5(F.concat(drawn_by, F.lit(f":{seed}")))


def stratified_split(items: DataFrame, item_id: str, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: within each goal and label, the items first in drawing order.

    A stratum may hold most of all rows, so it is never sorted as a whole. Counting by the first
    four digits of the draw finds the digits where the held-out share ends; only the items with
    those digits, one in 65,536, are ranked to find the exact last one.
    """
    stratum = ["goal", "label"]
    drawn = items.withColumn("_draw", draw(item_id, seed)).withColumn("_digits", F.substring("_draw", 1, 4))
    counts = drawn.groupBy(*stratum, "_digits").agg(F.count("*").alias("c"))
    sizes = split_sizes(counts.groupBy(*stratum).agg(F.sum("c").alias("n")))
    running = W.partitionBy(*stratum).orderBy("_digits")
    ends = (
        counts.withColumn("upto", F.sum("c").over(running))
        .join(sizes.select(*stratum, "n_test"), stratum)
        .filter((F.col("upto") >= F.col("n_test")) & (F.col("upto") - F.col("c") < F.col("n_test")))
        .select(*stratum, "_digits", (F.col("n_test") - F.col("upto") + F.col("c")).alias("take"))
    )
    ranked = drawn.join(small_side(ends), [*stratum, "_digits"]).withColumn(
        "rank", F.row_number().over(W.partitionBy(*stratum).orderBy("_draw", item_id))
    )
    lasts = ranked.filter(F.col("rank") == F.col("take")).select(
        *stratum, F.struct(F.col("_draw"), F.col(item_id)).alias("_last")
    )
    held_out = F.coalesce(F.struct(F.col("_draw"), F.col(item_id)) <= F.col("_last"), F.lit(False))
    return (
        drawn.join(small_side(lasts), stratum, "left")
        .withColumn("is_test", held_out)
        .drop("_draw", "_digits", "_last")
    )


def class_weights(items: DataFrame) -> DataFrame:
    """``(goal, label, weight)``: samples over twice the samples of the label."""
    per_label = items.groupBy("goal", "label").agg(F.count("*").alias("n"))
    goal = W.partitionBy("goal")  # one row per label
    classes = F.count("*").over(goal)
    return per_label.select(
        "goal", "label", (F.sum("n").over(goal) / (classes * F.col("n"))).alias("weight")
    )


def folds(small_goals: DataFrame, item_id: str, seed: int = SEED) -> DataFrame:
    """Add ``fold``. Only for goals up to the cross-validation limit, so each group is tiny."""
    order = W.partitionBy("goal", "label").orderBy(draw(item_id, seed), item_id)
    count = F.count("*").over(W.partitionBy("goal"))
    return small_goals.withColumn(
        "fold", F.pmod(F.row_number().over(order) - 1, F.least(F.lit(MAX_FOLDS), count)).cast("int")
    )
