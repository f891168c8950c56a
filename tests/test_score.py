"""Goal resolution, gap, learning path and scores on small dictionaries."""

import pytest
from pyspark.sql import functions as F

from gapscore import schemas
from gapscore.config import Config, ConfigError, load_config
from gapscore.operators import gap, goals
from gapscore.operators.linear import GoalModels
from gapscore.operators.score import load_dimensions, passed, score, usage
from gapscore.operators.tfidf import Vocabulary
from gapscore.plans.scoring import answer, respond, write_responses, write_responses_with_usage

RAW = {
    "version": "1.0.0",
    "minimum_score_to_pass": 0.65,
    "log_score_details": True,
    "model_goals_supported": ["Lamplighter", "Beekeeper", "Ghost", "Lamplighter"],
    "default_goal_model": "Lamplighter",
}
GOALS = {
    "Lamplighter": ["Wicks", "Lantern Glass", "Street Maps", "Oil"],
    "Beekeeper": ["Smoker", "Honey"],
    "Hidden": ["Painting"],
}
RECOMMENDATIONS = [
    (0, "Street Maps", "Old", "Old"),
    (1, "Street Maps", "1. Corners → → 2. Bridges ", "Map course"),
    (2, "Oil", "Only step", None),
]


def dimensions(spark, raw=RAW, all_goals=GOALS):
    rows = [(g, p, s) for g, skills in all_goals.items() for p, s in enumerate(skills)]
    return load_dimensions(
        Config.from_dict(raw),
        spark.createDataFrame(rows, schemas.GOAL_SKILLS),
        spark.createDataFrame([(0, "Lantern Glass", "LG")], schemas.SYNONYMS),
        spark.createDataFrame(RECOMMENDATIONS, schemas.RECOMMENDATIONS),
    )


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.REQUEST)


def one(spark, goal, text, **options):
    return score(requests(spark, ("s", goal, text)), dimensions(spark), **options).first()


def test_full_response(spark):
    row = one(spark, "Lamplighter", "Wicks and LG, some Painting")
    assert row.score == 0.5
    assert row.matched_skills == ["Wicks", "Lantern Glass"]
    assert row.missing_skills == ["Street Maps", "Oil"]
    path = [(item.path, item.course) for item in row.suggested_learning_path]
    # The last entry of a skill counts; an entry without course is left out; one closing item.
    assert path == [(["1. Corners", "2. Bridges"], "Map course"), ([gap.TAIL_STEP], gap.TAIL_COURSE)]


def test_generic_recommendation(spark):
    row = one(spark, "Beekeeper", "honey")
    assert row.suggested_learning_path[0].path == ["Develop proficiency in Smoker through online courses and projects"]
    assert row.suggested_learning_path[0].course == goals.GENERIC_COURSE


def test_nothing_missing_has_no_path(spark):
    row = one(spark, "Beekeeper", "Smoker Honey")
    assert (row.score, row.missing_skills, row.suggested_learning_path) == (1.0, [], [])


@pytest.mark.parametrize("text", ["", None, "   \n", "!@#$%^&*()", "日本語", "éàü"])
def test_blank_text_is_all_empty(spark, text):
    row = one(spark, "Lamplighter", text)
    assert (row.score, row.matched_skills, row.missing_skills, row.suggested_learning_path) == (0.0, [], [], [])


@pytest.mark.parametrize(
    "goal, used, defaulted, skills",
    [
        ("Beekeeper", "Beekeeper", False, GOALS["Beekeeper"]),
        ("Hidden", "Lamplighter", True, GOALS["Lamplighter"]),
        ("Unknown", "Lamplighter", True, GOALS["Lamplighter"]),
        ("", "Lamplighter", True, GOALS["Lamplighter"]),
        (None, "Lamplighter", True, GOALS["Lamplighter"]),
        ("Ghost", "Ghost", False, GOALS["Lamplighter"]),
    ],
)
def test_goal_fallbacks(spark, goal, used, defaulted, skills):
    row = one(spark, goal, "nothing here")
    assert (row.goal_used, row.goal_was_defaulted) == (used, defaulted)
    assert row.missing_skills == skills


def test_default_without_skills_requires_nothing(spark):
    raw = {**RAW, "default_goal_model": "Nowhere"}
    row = score(requests(spark, ("s", "zzz", "wicks")), dimensions(spark, raw)).first()
    assert (row.goal_used, row.score, row.matched_skills, row.missing_skills) == ("Nowhere", 0.0, [], [])


def test_long_text(spark):
    row = one(spark, "Lamplighter", "wicks " * 1000)
    assert row.score == 0.25


def test_repeated_students_stay_apart(spark):
    rows = requests(spark, ("s", "Beekeeper", "smoker"), ("s", "Beekeeper", "honey smoker"))
    assert sorted(r.score for r in score(rows, dimensions(spark)).collect()) == [0.5, 1.0]


def test_incomplete_requests_are_rejected_with_reasons(spark):
    rows = requests(spark, ("a", "Beekeeper", None), (None, "Beekeeper", "x"), ("c", None, "x"), ("d", "Beekeeper", "honey"))
    done = answer(rows, dimensions(spark))
    assert [r.student_id for r in done.responses.collect()] == ["d"]
    assert {(r.student_id, *r.details) for r in done.rejected.collect()} == {
        ("a", "body.resume_text: Field required"),
        (None, "body.student_id: Field required"),
        ("c", "body.goal: Field required"),
    }


def test_empty_goal_requires_nothing(spark):
    rows = [("Beekeeper", None, None), ("Lamplighter", 0, "Wicks")]
    dims = load_dimensions(
        Config.from_dict(RAW),
        spark.createDataFrame(rows, schemas.GOAL_SKILLS),
        spark.createDataFrame([], schemas.SYNONYMS),
        spark.createDataFrame([], schemas.RECOMMENDATIONS),
    )
    row = score(requests(spark, ("s", "Beekeeper", "wicks")), dims).first()
    assert (row.goal_used, row.score, row.matched_skills, row.missing_skills) == ("Beekeeper", 0.0, [], [])
    assert score(requests(spark, ("s", "Ghost", "wicks")), dims).first().score == 1.0


def test_models_are_found_by_goal_key(spark):
    raw = {**RAW, "model_goals_supported": ["Night Lamplighter"], "default_goal_model": "Night Lamplighter"}
    dims = dimensions(spark, raw, {"Night Lamplighter": ["Wicks", "Oil"]})
    table = spark.createDataFrame(
        [("night_lamplighter", 3.0, [0.0, 0.0]), ("Night Lamplighter", -9.0, [0.0, 0.0])], schemas.GOAL_MODELS
    )
    models = GoalModels(Vocabulary(("oil", "wicks"), (1.0, 1.0)), table)
    assert respond(requests(spark, ("a", "Night Lamplighter", "wicks")), dims, models).first().score > 0.9


def _models(spark, intercept):
    table = spark.createDataFrame([("Beekeeper", intercept, [0.0, 2.0])], schemas.GOAL_MODELS)
    return GoalModels(Vocabulary(("honey", "smoker"), (1.0, 1.0)), table)


def test_model_scores_where_there_is_one(spark):
    rows = requests(spark, ("a", "Beekeeper", "smoker"), ("b", "Lamplighter", "wicks"), ("c", "Beekeeper", "cooking honey?"))
    scored = {r.student_id: r.score for r in score(rows, dimensions(spark), _models(spark, -1.0)).collect()}
    assert scored["a"] == pytest.approx(1 / (1 + 2.718281828459045 ** -1.0))
    assert scored["b"] == 0.25
    assert scored["c"] == pytest.approx(1 / (1 + 2.718281828459045**1.0))


def test_no_match_is_zero_at_the_boundary_only(spark):
    rows = requests(spark, ("a", "Beekeeper", "cooking"))
    inner = score(rows, dimensions(spark), _models(spark, 3.0)).first().score
    outer = respond(rows, dimensions(spark), _models(spark, 3.0)).first().score
    assert inner > 0.9 and outer == 0.0


def test_high_and_low_models(spark):
    rows = requests(spark, ("a", "Beekeeper", "smoker"))
    assert score(rows, dimensions(spark), _models(spark, 2.0)).first().score >= 0.8
    assert score(rows, dimensions(spark), _models(spark, -5.0)).first().score <= 0.3


def test_threshold_is_inclusive(spark):
    config = Config.from_dict(RAW)
    df = spark.createDataFrame([(0.65,), (0.64,), (0.66,)], "score DOUBLE")
    assert [r.p for r in df.select(passed(F.col("score"), config).alias("p")).collect()] == [True, False, True]


def test_usage(spark):
    rows = requests(spark, ("a", "Beekeeper", "smoker"), ("b", "Beekeeper", "cook"))
    row = usage(score(rows, dimensions(spark))).first()
    assert (row.scored, row.avg_score, row.avg_matched, row.avg_missing) == (2, 0.25, 0.5, 1.5)


def test_written_responses_keep_the_schema(spark, tmp_path):
    responses = respond(requests(spark, ("a", "Beekeeper", "smoker")), dimensions(spark))
    write_responses(responses, str(tmp_path / "out"))
    back = spark.read.schema(schemas.RESPONSE).parquet(str(tmp_path / "out"))
    assert back.collect() == responses.collect()


@pytest.mark.parametrize("field", ["version", "minimum_score_to_pass", "log_score_details"])
def test_missing_config_field(field):
    with pytest.raises(ConfigError, match=field):
        Config.from_dict({k: v for k, v in RAW.items() if k != field})


def test_config_file(spark, tmp_path):
    import json

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({**RAW, "api": {"rate_limit": {"requests_per_minute": 7}}}))
    bad.write_text("{")
    config = load_config(spark, str(good))
    assert config.supported_goals == ("Lamplighter", "Beekeeper", "Ghost")
    assert config.requests_per_minute == 7
    with pytest.raises(ConfigError):
        load_config(spark, str(bad))


def test_scoring_plan_has_no_shuffle(spark):
    number = F.col("id").cast("string")
    rows = spark.range(0, 1000, 1, 8).select(
        number.alias("student_id"), F.concat(F.lit("Goal "), number).alias("goal"), number.alias("resume_text")
    )
    plan = respond(rows, dimensions(spark))._jdf.queryExecution().executedPlan().toString()
    with_model = respond(rows, dimensions(spark), _models(spark, 1.0))._jdf.queryExecution().executedPlan().toString()
    for text in (plan, with_model):
        assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "BroadcastHashJoin" in text


def test_usage_is_collected_while_scores_are_written(spark, sf, tmp_path):
    from dataclasses import replace

    from workload import fixtures as fx

    dims, path = fx.dimensions(spark), str(tmp_path / "out")
    scored = score(fx.requests(spark, sf), dims)
    figures = write_responses_with_usage(scored, path, replace(dims.config, collect_usage_metrics=True))
    want = {r.goal_used: tuple(r)[1:] for r in usage(spark.read.parquet(path)).collect()}
    got = {r.goal_used: tuple(r)[1:] for r in figures.collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert write_responses_with_usage(scored, path, dims.config).collect() == []
    nothing = write_responses_with_usage(scored.limit(0), path, replace(dims.config, collect_usage_metrics=True))
    assert nothing.collect() == []
