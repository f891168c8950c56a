"""Plans that must hold at any size, and the ways taken when a side is not small."""

import pytest
from pyspark.sql import functions as F

from gapscore import storage
from gapscore.operators import linear, split
from gapscore.operators.tfidf import Vocabulary, fit_vocabulary
from workload import fixtures as fx
from workload.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def nothing_is_small(spark, monkeypatch):
    """No side passes for small, and Spark may not broadcast on its own either."""
    monkeypatch.setattr(storage, "MAX_BROADCAST_BYTES", -1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def skewed(spark):
    """Three quarters of all rows in one goal and label."""
    number = F.col("id")
    goal = F.when(number % 4 > 0, "hot").otherwise(F.concat(F.lit("g"), (number % 7).cast("string")))
    label = F.when((goal == "hot") & (number % 50 > 0), 1).otherwise((number % 2).cast("int"))
    return spark.range(0, 4000, 1, 8).select(goal.alias("goal"), label.alias("label"), "id")


def test_split_of_a_hot_stratum(spark):
    rows = skewed(spark)
    done = split.stratified_split(rows, "id")
    text = plan(done)
    # The items themselves are neither sorted nor shuffled.
    assert "Window" not in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
    counts = {(r.goal, r.label): (r.n, r.t) for r in done.groupBy("goal", "label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    sizes = {(r.goal, r.label): (r.n, r.n_test) for r in split.split_sizes(
        rows.groupBy("goal", "label").agg(F.count("*").alias("n"))).collect()}
    assert counts == sizes


def test_split_without_broadcasts(spark, nothing_is_small):
    rows = skewed(spark)
    done = split.stratified_split(rows, "id")
    assert "BroadcastHashJoin" not in plan(done)
    assert done.count() == 4000
    hot = done.filter("goal = 'hot'")
    n = hot.count()
    assert hot.filter("is_test").count() == -(-n * 40 // 100)


@pytest.fixture
def scores(spark, sf):
    return {r.student_id: r.score for r in QUERIES["coverage_score"](spark, sf).collect()}


def test_scoring_without_broadcasts(spark, sf, scores, nothing_is_small):
    again = QUERIES["coverage_score"](spark, sf)
    assert "BroadcastHashJoin" not in plan(again)
    assert {r.student_id: r.score for r in again.collect()} == scores


def test_vocabulary_without_broadcasts(spark, sf, nothing_is_small):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    shuffled = fit_vocabulary(docs, "text", fx.STOP_WORDS, max_features=60).collect()
    storage.MAX_BROADCAST_BYTES = 64 * 1024 * 1024
    assert shuffled == fit_vocabulary(docs, "text", fx.STOP_WORDS, max_features=60).collect()


def test_models_without_broadcasts(spark, nothing_is_small):
    table = spark.createDataFrame([("g", 0.0, [1.0])], "goal STRING, intercept DOUBLE, coefficients ARRAY<DOUBLE>")
    rows = spark.range(10).select(F.concat(F.lit("g"), F.when(F.col("id") > 4, "x").otherwise("")).alias("goal"), F.lit("cat").alias("t"))
    scored = linear.model_probability(rows, linear.GoalModels(Vocabulary(("cat",), (1.0,)), table), "t", "goal")
    assert scored.filter(F.col("probability").isNotNull()).count() == 5


def test_vocabulary_shuffles_by_term_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    text = plan(fit_vocabulary(docs, "text", fx.STOP_WORDS, max_features=60))
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(term" in text
    assert "partial_sum(tf" in text and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["coverage_score", "score_response", "linear_score", "tfidf_l2", "extract_skills", "tokens"])
def test_row_work_is_not_shuffled(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "hashpartitioning" not in text and "SortMergeJoin" not in text
    assert "Window" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_unset_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.work_dir(Session())
