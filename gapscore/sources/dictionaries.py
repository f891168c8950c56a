"""Goals, synonyms and recommendations: ordered dictionaries read as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore.functions.words import check_term
from gapscore.storage import small_side

# Up to so many rows a dictionary is held by the driver and every worker; beyond, it stays a table.
MAX_DICTIONARY_ROWS = 200_000


def json_entries(document: Column) -> Column:
    """The ``(pos, key, value)`` entries of a JSON object in file order, repeated keys included."""
    return F.posexplode(F.from_json(document, "map<string,string>"))


def last_entries(documents: DataFrame, column: str) -> DataFrame:
    """``(pos, key, body)`` of each document: a repeated key keeps its first place and its last body."""
    entries = documents.select(F.md5(column).alias("doc"), json_entries(F.col(column)).alias("pos", "key", "body"))
    kept = entries.groupBy("doc", "key").agg(
        F.min("pos").alias("pos"), F.max(F.struct("pos", "body")).alias("last")
    )
    return kept.select("pos", "key", "last.body")


def parse_goals(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects ``{goal: [skill, ...]}`` to ``(goal, skills)``; ``skills`` is NULL if malformed."""
    entries = last_entries(documents, column)
    return entries.select(F.col("key").alias("goal"), F.from_json("body", "array<string>").alias("skills"))


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    return parse_goals(spark.read.text(path, wholetext=True))


def goal_skills(goals: DataFrame) -> DataFrame:
    """``(goal, pos, skill)`` rows of well-formed goals; a goal with an empty list has one row without a skill."""
    listed = goals.filter(F.col("skills").isNotNull())
    return listed.select("goal", F.posexplode_outer("skills").alias("pos", "skill"))


def goal_sizes(goals: DataFrame) -> DataFrame:
    """Skills per goal, with a flag for entries that are not lists."""
    malformed = F.col("skills").isNull()
    size = F.when(~malformed, F.size("skills"))
    return goals.select("goal", size.alias("skills"), malformed.alias("malformed"))


def parse_synonyms(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON ``{canonical: [synonym, ...]}`` to rules numbered in file order."""
    listed = last_entries(documents, column).select(
        F.col("pos").alias("rank"),
        F.col("key").alias("canonical"),
        F.posexplode(F.from_json("body", "array<string>")).alias("place", "synonym"),
    )
    # File order as one number: the entry, then the place within its list.
    rule_no = (F.col("rank").cast("long") * 1_000_000 + F.col("place")).alias("rule_no")
    return listed.select(rule_no, "canonical", "synonym")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    return parse_synonyms(spark.read.text(path, wholetext=True))


def parse_recommendations(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON ``{skill: {path, course}}`` to ``(seq, skill, path, course)``, repeats included."""
    entries = documents.select(json_entries(F.col(column)).alias("seq", "skill", "body"))
    body = F.from_json("body", "struct<path: string, course: string>")
    return entries.select("seq", "skill", body.path.alias("path"), body.course.alias("course"))


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    return parse_recommendations(spark.read.text(path, wholetext=True))


def last_wins(table: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the row with the highest ``order`` per ``key``; ``order`` is unique within a key.

    Only keys and numbers are aggregated, so wide rows are neither sorted nor shuffled, and a
    key that repeats very often costs one row per task.
    """
    latest = table.groupBy(key).agg(F.max(order).alias(order))
    return table.join(small_side(latest), [key, order], "left_semi")


@dataclass(frozen=True)
class SkillRules:
    """The ordered rewrite rules and the skills to look for, held on the driver."""

    rules: tuple[tuple[str, str], ...]  # (synonym, canonical), in order
    skills: tuple[str, ...]


@dataclass(frozen=True)
class RuleTables:
    """The same as tables of any size: texts meet the terms whose rarest word they contain."""

    rules: DataFrame  # (rule_no, synonym, canonical), rule_no unique
    skills: DataFrame  # (skill), distinct


def load_rules(synonyms: DataFrame, universe: DataFrame) -> SkillRules | RuleTables:
    """Rules for the driver if they are few enough, otherwise as tables."""
    rules, skills = synonyms.select("rule_no", "synonym", "canonical"), universe.select("skill")
    held = [df.take(MAX_DICTIONARY_ROWS + 1) for df in (rules, skills)]
    if max(map(len, held)) > MAX_DICTIONARY_ROWS:
        return RuleTables(rules, skills.distinct())
    return SkillRules(
        rules=tuple((check_term(r.synonym), r.canonical) for r in sorted(held[0], key=lambda r: r.rule_no)),
        skills=tuple(sorted(check_term(r.skill) for r in held[1])),
    )
