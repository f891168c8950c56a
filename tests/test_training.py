"""Split, weights, folds, fitting and evaluation."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from gapscore.operators import evaluate, linear, split
from gapscore.operators.tfidf import Vocabulary
from gapscore.operators import solve as solve_module
from gapscore.operators import train as train_module
from gapscore.operators.solve import Sparse, solve
from gapscore.operators.train import fit, train, vector_parts
from gapscore.plans.training import train_and_save
from gapscore.sources.models import load_models, read_table
from gapscore.storage import materialise


def expected_test_ids(rows):
    """Plain computation of the stratified split."""
    result = set()
    for goal in {g for g, _, _ in rows}:
        strata = {}
        for g, label, item in rows:
            if g == goal:
                strata.setdefault(label, []).append(item)
        n = sum(map(len, strata.values()))
        n_train = n - math.ceil(n * 40 / 100)
        base = {label: len(ids) * n_train // n for label, ids in strata.items()}
        order = sorted(strata, key=lambda label: (-(len(strata[label]) * n_train % n), label))
        for label in order[: n_train - sum(base.values())]:
            base[label] += 1
        for label, ids in strata.items():
            drawn = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
            result |= {(goal, i) for i in drawn[: len(ids) - base[label]]}
    return result


@pytest.mark.parametrize("sizes", [{("a", 0): 45, ("a", 1): 55}, {("a", 0): 3, ("a", 1): 18, ("b", 0): 1}, {("c", 1): 3000, ("c", 0): 7}])
def test_stratified_split(spark, sizes):
    rows = [(g, label, 10_000 * k + i) for k, ((g, label), n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, id LONG")
    out = split.stratified_split(df, "id").collect()
    assert len(out) == len(rows)
    assert {(r.goal, r.id) for r in out if r.is_test} == expected_test_ids(rows)


def test_split_is_exact_per_label(spark):
    rows = [("a", 0, i) for i in range(50)] + [("a", 1, i) for i in range(100, 150)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, id LONG")
    assert split.stratified_split(df, "id").filter("is_test").count() == 40


def test_gate(spark):
    counts = {"none": 0, "few": 9, "cv": 10, "cv2": 20, "full": 21, "lone": 30, "odd": 30}
    labels = [(g, "1") for g, n in counts.items() for _ in range(n)] + [("lone", "0"), ("odd", "x"), ("odd", "0")]
    rows = spark.createDataFrame([(g, "text", label) for g, label in labels], "goal STRING, resume_text STRING, label STRING")
    items = split.usable_items(rows)
    goals = spark.createDataFrame([(g,) for g in counts], "goal STRING")
    actions = {r.goal: r.action for r in split.training_gate(goals, items).collect()}
    assert actions == {
        "none": "no data",
        "few": "not enough samples",
        "cv": "cross-validate",
        "cv2": "cross-validate",
        "full": "train",
        "lone": "a label has one sample",
        "odd": "a label is not a number",
    }


def test_class_weights(spark):
    items = spark.createDataFrame([("a", 0)] * 3 + [("a", 1)], "goal STRING, label INT")
    weights = {r.label: r.weight for r in split.class_weights(items).collect()}
    assert weights == pytest.approx({0: 4 / 6, 1: 2.0})


def test_folds_are_even_and_stratified(spark):
    rows = [("a", i % 2, i) for i in range(14)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, id LONG")
    folded = split.folds(df, "id").collect()
    for label in (0, 1):
        sizes = [sum(r.fold == k and r.label == label for r in folded) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def newton(x, y, s):
    """Minimum of 1/2 |w|^2 + sum of weighted log losses, intercept free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (s * (p - y)) + penalty @ w
        hessian = (x * (s * p * (1 - p))[:, None]).T @ x + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_fit_solves_the_balanced_objective(spark):
    rng = np.random.default_rng(0)
    x = rng.random((60, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(60) > 0.6).astype(int)
    weight = {c: 60 / (2 * (y == c).sum()) for c in (0, 1)}
    rows = [("g", int(c), float(weight[c]), [0, 1, 2], [float(v) for v in r]) for r, c in zip(x, y)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, weight DOUBLE, indices ARRAY<INT>, weights ARRAY<DOUBLE>")
    parts = df.withColumn("features", vector_parts(F.col("indices"), F.col("weights"), 3))
    assert "Python" not in parts._jdf.queryExecution().executedPlan().toString()
    vectors = materialise(parts, "vectors", read_as={"features": VectorUDT()})
    intercept, coefficients = fit(vectors, 60)
    expected = newton(x, y, np.array([weight[c] for c in y]))
    assert coefficients == pytest.approx(list(expected[:3]), abs=1e-3)
    assert intercept == pytest.approx(expected[3], abs=1e-3)


def test_all_small_goals_in_one_job(spark, monkeypatch):
    """300 goals at once equal a Newton solution and Spark ML's, and one that cannot be fitted is reported."""
    rng, rows, data = np.random.default_rng(1), [], {}
    for g in range(300):
        n = int(rng.integers(21, 40))
        x = np.where(rng.random((n, 6)) < 0.5, rng.random((n, 6)), 0)
        y = (x[:, g % 6] + 0.2 * rng.standard_normal(n) > 0.3).astype(int)
        y[:2] = 0, 1
        if g == 7:
            y[:] = 1
        s = np.array([n / (2 * max((y == c).sum(), 1)) for c in y])
        data[f"g{g}"] = (x, y, s)
        for r, label, weight in zip(x, y, s):
            at = np.flatnonzero(r).tolist()
            rows.append((f"g{g}", int(label), float(weight), at, r[at].tolist()))
    df = spark.createDataFrame(rows, "goal STRING, label INT, weight DOUBLE, indices ARRAY<INT>, weights ARRAY<DOUBLE>")
    parts = df.withColumn("features", vector_parts(F.col("indices"), F.col("weights"), 8)).drop("indices", "weights")
    vectors = materialise(parts, "many", ["goal"], {"features": VectorUDT()})
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    models, failed = train_module._fit_all(vectors, 8)
    assert len(stages.getJobIdsForGroup("fits")) < 20
    got = {m.goal: m for m in models.collect()}
    assert len(got) == 299 and failed == [("g7", "failed: all training samples have the same label")]
    for goal, model in got.items():
        x, y, s = data[goal]
        expected = newton(x, y, s)
        assert model.coefficients[:6] == pytest.approx(list(expected[:6]), abs=1e-5) and model.coefficients[6:] == [0, 0]
        assert model.intercept == pytest.approx(expected[6], abs=1e-5)
    monkeypatch.setattr(train_module, "SMALL_ROWS", 0)
    some = vectors.filter(F.col("goal").isin("g1", "g2", "g7"))
    large, failed = train_module._fit_all(some, 8)
    assert [f[0] for f in failed] == ["g7"]
    for model in large.collect():
        assert model.coefficients == pytest.approx(got[model.goal].coefficients, abs=1e-3)


def test_medium_goals_share_their_passes(spark, monkeypatch):
    """Goals beyond a task take as many jobs as one, rows without features count, and the fit is the least of the objective."""
    rng, rows, data = np.random.default_rng(2), [], {}
    for g in range(12):
        x = np.where(rng.random((150, 9)) < 0.4, rng.random((150, 9)) * [1, 1, 1, 1, 1, 1, 1, 9, 0.1], 0)
        x[-1] = x[70] = 0
        y = (x[:, g % 6] + 0.2 * rng.standard_normal(150) > 0.2).astype(int)
        y[:2] = 0, 1
        s = np.array([150 / (2 * (y == c).sum()) for c in y])
        data[f"g{g}"] = (x, y, s)
        for r, label, weight in zip(x, y, s):
            at = np.flatnonzero(r).tolist()
            rows.append((f"g{g}", int(label), float(weight), at, r[at].tolist()))
    rows += [("one", 1, 1.0, [0], [1.0])] * 5 + [("odd", i % 2, 1.0, [0], [float("nan")]) for i in range(6)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, weight DOUBLE, indices ARRAY<INT>, weights ARRAY<DOUBLE>")
    parts = df.withColumn("features", vector_parts(F.col("indices"), F.col("weights"), 9)).drop("indices", "weights")
    vectors = materialise(parts, "shared", ["goal"], {"features": VectorUDT()})
    monkeypatch.setattr(train_module, "SMALL_ROWS", 0)
    spark.sparkContext.setJobGroup("shared", "shared")
    models, failed = train_module._fit_all(vectors, 9)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("shared")) < 120
    got = {m.goal: m for m in models.collect()}
    assert set(got) == set(data)
    reasons = dict(failed)
    assert set(reasons) == {"one", "odd"} and all(r.startswith("failed: ") for r in reasons.values())
    for goal, (x, y, s) in data.items():
        expected = newton(x, y, s)
        assert [*got[goal].coefficients, got[goal].intercept] == pytest.approx(list(expected), abs=1e-4)
    monkeypatch.setattr(train_module, "MEDIUM_VALUES", 100)
    large, failed = train_module._fit_all(vectors.filter(F.col("goal").isin("g1", "g2", "one")), 9)
    assert [f[0] for f in failed] == ["one"]
    for model in large.collect():
        assert model.coefficients == pytest.approx(got[model.goal].coefficients, abs=1e-2)


def test_groups_of_medium_goals_and_blocks_of_few_values(spark, monkeypatch):
    """The fit does not depend on how goals are grouped and rows are cut into blocks."""
    rng = np.random.default_rng(3)
    rows = [(f"g{g}", int(i % 2), 1.0, [0, 1 + i % 3], [float(v) for v in rng.random(2) + [i % 2, 0]]) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, weight DOUBLE, indices ARRAY<INT>, weights ARRAY<DOUBLE>")
    parts = df.withColumn("features", vector_parts(F.col("indices"), F.col("weights"), 4)).drop("indices", "weights")
    vectors = materialise(parts, "groups", ["goal"], {"features": VectorUDT()})
    counts = {f"g{g}": 40 for g in range(3)}
    whole = solve_module.fit_shared(vectors, counts, 4)
    monkeypatch.setattr(solve_module, "SHARED_VALUES", 5)
    monkeypatch.setattr(solve_module, "BLOCK_VALUES", 1)
    cut = solve_module.fit_shared(vectors, counts, 4)
    for goal in counts:
        assert cut[goal] == pytest.approx(whole[goal], abs=1e-6)


def test_separable_and_empty_features_are_solved():
    none = np.array([], dtype=int)
    intercept, w = solve(Sparse(none, none, np.array([]), 4, 0), np.array([0.0, 1, 1, 1]), np.ones(4))
    assert intercept == pytest.approx(math.log(3)) and len(w) == 0
    x = np.array([[5.0], [5.0], [-5.0], [-5.0]])
    y, s = np.array([1.0, 1, 0, 0]), np.full(4, 1000.0)
    intercept, w = solve(Sparse(np.arange(4), np.zeros(4, dtype=int), x[:, 0], 4, 1), y, s)
    assert [*w, intercept] == pytest.approx(list(newton(x, y, s)), abs=1e-4)


VOCABULARY = Vocabulary(("bad", "good", "maybe"), (1.0, 1.0, 1.0))


def _items(goal, positive, negative):
    texts = [("good maybe" if i % 3 else "good", 1) for i in range(positive)]
    texts += [("bad maybe" if i % 3 else "bad", 0) for i in range(negative)]
    return [(goal, text, label) for text, label in texts]


def test_train_all_kinds_of_goals(spark):
    rows = _items("large one", 18, 12) + _items("single", 25, 0) + _items("small", 6, 6) + _items("tiny", 2, 2)
    rows += [("unlabelled", "text", None)] + _items("lopsided", 11, 1)
    done = train(spark.createDataFrame(rows, "goal STRING, resume_text STRING, label INT"), VOCABULARY)

    model = done.models.collect()
    assert [m.goal for m in model] == ["large one"]
    assert model[0].coefficients[1] > 0 > model[0].coefficients[0]

    registry = done.registry.collect()
    assert [tuple(r) for r in registry] == [("large one", "large_one_model.pkl", 1.0, 30, 18, 12, 3)]
    metrics = done.metrics.first()
    assert (metrics.tested, metrics.tp + metrics.tn, metrics.f1) == (12, 12, 1.0)

    cross = done.cross_validated.collect()
    assert [(c.goal, c.mean_accuracy, c.std_accuracy) for c in cross] == [("small", 1.0, 0.0)]

    reasons = {r.goal: r.reason for r in done.skipped.collect()}
    assert set(reasons) == {"single", "tiny", "unlabelled", "lopsided"}
    assert reasons["single"].startswith("failed") and reasons["lopsided"].startswith("failed")
    assert (reasons["tiny"], reasons["unlabelled"]) == ("not enough samples", "no data")


def test_split_does_not_depend_on_the_files(spark):
    rows = [("g", f"text {i % 70}", i % 2) for i in range(100)]
    splits = []
    for parts, order in ((1, rows), (8, rows[::-1])):
        items = spark.createDataFrame(order, "goal STRING, resume_text STRING, label INT").repartition(parts)
        items = materialise(items.withColumn("item_id", split.content_id()), "ids")
        done = split.stratified_split(items, "item_id")
        splits.append(sorted((r.resume_text, r.label, r.is_test) for r in done.collect()))
    assert splits[0] == splits[1] and sum(t for *_, t in splits[0]) == 40


def test_train_and_save(spark, tmp_path):
    folder = str(tmp_path / "stored")
    training = spark.createDataFrame(_items("g", 15, 15), "goal STRING, resume_text STRING, label INT")
    train_and_save(training, folder, stop_words=[], max_df=1.0)
    models = load_models(spark, folder)
    assert models.vocabulary.terms == ("bad", "bad maybe", "good", "good maybe", "maybe")
    assert read_table(spark, folder, "registry").count() == 1
    samples = spark.createDataFrame([(1, "a good day"), (2, "a bad day"), (3, "")], "id INT, text STRING")
    labels = {r.id: r.label for r in linear.score_all_goals(samples, "text", models, ["id"]).collect()}
    assert (labels[1], labels[2]) == ("MATCH", "NO MATCH")


def test_nothing_to_train(spark, tmp_path):
    empty = spark.createDataFrame([], "goal STRING, resume_text STRING, label INT")
    assert train_and_save(empty, str(tmp_path / "x"), stop_words=[]) is None


def test_default_stop_words(spark, tmp_path):
    training = spark.createDataFrame(_items("g", 15, 15) + [("g", "the of and cat", 1)], "goal STRING, resume_text STRING, label INT")
    train_and_save(training, str(tmp_path / "d"), max_df=1.0)
    terms = set(load_models(spark, str(tmp_path / "d")).vocabulary.terms)
    assert "cat" in terms and not terms & {"the", "of", "and"}


def test_linear_scores(spark):
    table = spark.createDataFrame([("g", 0.5, [1.0, -2.0, 0.0])], "goal STRING, intercept DOUBLE, coefficients ARRAY<DOUBLE>")
    texts = spark.createDataFrame([(1, "g", "good"), (2, "g", "unknown"), (3, "other", "good")], "id INT, goal STRING, t STRING")
    scored = linear.model_probability(texts, linear.GoalModels(VOCABULARY, table), "t", "goal")
    p = {r.id: r.probability for r in scored.collect()}
    assert p[1] == pytest.approx(1 / (1 + math.exp(1.5)))
    assert p[2] == pytest.approx(1 / (1 + math.exp(-0.5)))
    assert p[3] is None


def test_metrics(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.5), ("a", 0, 0.6), ("a", 0, 0.1), ("b", 1, 0.2), ("c", 0, 0.2), ("c", 1, 0.3)]
    df = spark.createDataFrame(rows, "goal STRING, label INT, probability DOUBLE")
    assert {r.goal: r.accuracy for r in evaluate.accuracy(df).collect()} == {"a": 0.5, "b": 0.0, "c": 0.5}
    assert {r.goal: (r.tn, r.fp, r.fn, r.tp) for r in evaluate.confusion(df).collect()} == {
        "a": (1, 1, 1, 1),
        "b": (0, 0, 1, 0),
        "c": (1, 0, 1, 0),
    }
    assert {r.goal: (r.precision, r.recall, r.f1) for r in evaluate.precision_recall(df).collect()} == {
        "a": (0.5, 0.5, 0.5),
        "c": (0.0, 0.0, 0.0),
    }


def test_fits_read_only_their_goal(spark):
    """The stored features are laid out by goal."""
    from gapscore.storage import materialise

    df = materialise(spark.range(10).select((F.col("id") % 2).cast("string").alias("goal"), "id"), "t", ["goal"])
    plan = df.filter("goal = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(goal" in plan


def test_training_arrays_are_of_bounded_size(spark, monkeypatch):
    """A source has as many files as its items need, and the counts are the same."""
    from gapscore.sources import training as sources
    from workload import queries as q

    read, paths, sf = sources.read_training, [], "/root/testdata/sf0.001"

    def reading(spark, files, *rest):
        paths.append(files)
        return read(spark, files, *rest)

    monkeypatch.setattr(sources, "read_training", reading)
    want = sorted(map(tuple, q.training_arrays(spark, sf).collect()))
    monkeypatch.setattr(q, "ARRAY_ITEMS", 5, raising=False)
    assert sorted(map(tuple, q.training_arrays(spark, sf).collect())) == want
    texts = [r["value"] for r in spark.read.text(paths[1], wholetext=True).collect()]
    assert len(texts) > 6 and max(t.count('"label": ') for t in texts) <= 20
