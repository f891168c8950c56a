"""Scores, pass flags and usage figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gapscore.config import Config
from gapscore.functions.text import clean, is_blank
from gapscore.operators.extract import extract_skills
from gapscore.operators.gap import coverage, learning_path, skill_gap
from gapscore.operators.goals import attach_requirements, requirements, resolve_goal, skill_universe
from gapscore.operators.linear import GoalModels
from gapscore.operators.linear_joined import JoinedModels, model_probability
from gapscore.schemas import PATH_ITEM
from gapscore.sources.dictionaries import RuleTables, SkillRules, load_rules


@dataclass(frozen=True)
class Dimensions:
    """Everything scoring looks up: configuration, requirements per goal, and the term rules."""

    config: Config
    requirements: DataFrame
    rules: SkillRules | RuleTables


def load_dimensions(
    config: Config, goal_skills: DataFrame, synonyms: DataFrame, recommendations: DataFrame
) -> Dimensions:
    return Dimensions(
        config=config,
        requirements=requirements(goal_skills, recommendations, config),
        rules=load_rules(synonyms, skill_universe(goal_skills)),
    )


def passed(score: Column, config: Config) -> Column:
    """The threshold itself passes."""
    return score >= F.lit(config.minimum_score_to_pass)


def prepare(requests: DataFrame, dims: Dimensions) -> DataFrame:
    """Clean the text, flag blanks, resolve the goal, find skills and compare with the goal.

    Blank texts stay in the flow as empty ones, so the input is scanned once and the costly
    steps see nothing in them.
    """
    blank = F.col("blank")
    gapped = (
        requests.withColumn("resume_text", clean(F.col("resume_text")))
        .withColumn("blank", is_blank(F.col("resume_text")))
        .withColumn("_matchable", F.when(blank, F.lit("")).otherwise(F.col("resume_text")))
        .transform(resolve_goal, dims.config)
        .transform(extract_skills, "_matchable", dims.rules, "found_skills", dims.config.case_sensitive)
        .transform(attach_requirements, dims.requirements)
        .transform(skill_gap)
    )
    return gapped.drop("_matchable")


def score(
    requests: DataFrame,
    dims: Dimensions,
    models: GoalModels | JoinedModels | None = None,
    zero_without_match: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score every request; blank texts score 0 with empty lists. ``keep`` names columns to carry along.

    A goal with a model gets the model's probability, any other the share of required skills.
    """
    prepared = prepare(requests, dims)
    by_coverage = coverage()
    if models is not None:
        prepared = model_probability(prepared, models, "resume_text", "goal_used")
        value = F.coalesce(F.col("probability"), by_coverage)
    else:
        value = by_coverage
    if zero_without_match:
        value = F.when(F.size("matched_skills") == 0, F.lit(0.0)).otherwise(value)
    blank = F.col("blank")
    no_skills = F.expr("array()").cast("array<string>")
    no_path = F.expr("array()").cast(f"array<{PATH_ITEM}>")
    return prepared.select(
        "student_id",
        "goal",
        "goal_used",
        "goal_was_defaulted",
        F.when(blank, F.lit(0.0)).otherwise(value).alias("score"),
        F.when(blank, no_skills).otherwise(F.col("matched_skills")).alias("matched_skills"),
        F.when(blank, no_skills).otherwise(F.col("missing_skills")).alias("missing_skills"),
        F.when(blank, no_path).otherwise(learning_path()).alias("suggested_learning_path"),
        *keep,
    )


def usage(scored: DataFrame) -> DataFrame:
    """Per goal: how many scores, and the average score, matched and missing skills."""
    return scored.groupBy("goal_used").agg(
        F.count("*").alias("scored"),
        F.avg("score").alias("avg_score"),
        F.avg(F.size("matched_skills")).alias("avg_matched"),
        F.avg(F.size("missing_skills")).alias("avg_missing"),
    )


def observe_usage(scored: DataFrame, config: Config) -> tuple[DataFrame, Observation]:
    """The scores as they are, and an observation that fills while they are written: the figures of ``usage``.

    A goal that is used is supported or the default one, so the figures are a fixed number of sums.
    """
    sums = []
    for k, goal in enumerate(_goals(config)):
        of_goal = F.col("goal_used") == goal
        sums.append(F.count_if(of_goal).alias(f"{k}_scored"))
        for name, value in (("score", F.col("score")), ("matched", F.size("matched_skills")), ("missing", F.size("missing_skills"))):
            sums.append(F.sum(F.when(of_goal, value)).cast("double").alias(f"{k}_{name}"))
    observation = Observation()
    return scored.observe(observation, *sums), observation


def observed_usage(observation: Observation, config: Config) -> list[tuple[str, int, float, float, float]]:
    """``usage`` rows of goals that were scored, once the observed table has been written."""
    seen, rows = observation.get, []
    for k, goal in enumerate(_goals(config)):
        n = seen[f"{k}_scored"]
        if n:
            rows.append((goal, n, *(seen[f"{k}_{name}"] / n for name in ("score", "matched", "missing"))))
    return rows


def _goals(config: Config) -> list[str]:
    return list(dict.fromkeys((*config.supported_goals, config.default_goal)))
