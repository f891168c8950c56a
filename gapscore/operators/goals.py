"""Goal resolution, the skill universe and the requirements of each goal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore.config import Config
from gapscore.functions.text import goal_key, path_steps
from gapscore.sources.dictionaries import last_wins
from gapscore.storage import local_table, small_side

# Texts of the learning path.
GENERIC_STEP = ("Develop proficiency in ", " through online courses and projects")
GENERIC_COURSE = "General Skill Development – Coursera/Udemy/YouTube"


def skill_universe(goal_skills: DataFrame) -> DataFrame:
    return goal_skills.filter(F.col("skill").isNotNull()).select("skill").distinct()


def supported_goals(spark: SparkSession, config: Config) -> DataFrame:
    return local_table(spark, [(goal,) for goal in config.supported_goals], "goal STRING")


def resolve_goal(requests: DataFrame, config: Config) -> DataFrame:
    """Add ``goal_used`` and ``goal_was_defaulted``."""
    known = F.coalesce(F.col("goal").isin(*config.supported_goals), F.lit(False))
    used = F.when(known, F.col("goal")).otherwise(F.lit(config.default_goal))
    return requests.withColumns({"goal_used": used, "goal_was_defaulted": ~known})


def path_items(recommendations: DataFrame) -> DataFrame:
    """``(skill, path, course)`` with the path split into steps, the last entry of a skill winning."""
    latest = last_wins(recommendations, "skill", "seq")
    return latest.select("skill", path_steps(F.col("path")).alias("path"), "course")


def requirements(goal_skills: DataFrame, recommendations: DataFrame, config: Config) -> DataFrame:
    """One row per usable goal: its required skills in order, each with its learning path item.

    Recommendations meet skills here, on the dictionaries, so that requests never join or
    group by skill. A supported goal that the dictionary lacks gets the skills of the default goal; one
    with an empty list requires nothing.
    """
    spark = goal_skills.sparkSession
    items = path_items(recommendations).withColumn("known", F.lit(True))
    generic = F.array(F.concat(F.lit(GENERIC_STEP[0]), F.col("skill"), F.lit(GENERIC_STEP[1])))
    entry = F.struct(
        "pos",
        "skill",
        F.when(F.col("known"), F.col("path")).otherwise(generic).alias("path"),
        F.when(F.col("known"), F.col("course")).otherwise(F.lit(GENERIC_COURSE)).alias("course"),
    )
    # A goal's list is as long as its dictionary entry.
    packed = (
        goal_skills.join(items, "skill", "left")
        .groupBy("goal")
        .agg(F.array_sort(F.collect_list(F.when(F.col("skill").isNotNull(), entry))).alias("own"))
    )
    names = dict.fromkeys((*config.supported_goals, config.default_goal))
    usable = local_table(
        spark, [(g, config.default_goal) for g in names], "goal_used STRING, fallback STRING"
    )
    own = packed.withColumnRenamed("goal", "goal_used")
    fallback = packed.select(F.col("goal").alias("fallback"), F.col("own").alias("theirs"))
    required = F.coalesce("own", "theirs", F.expr("array()").cast(f"array<{ENTRY}>"))
    table = (
        usable.join(own, "goal_used", "left")
        .join(fallback, "fallback", "left")
        .select(
            "goal_used",
            F.when(F.col("own").isNotNull(), F.col("goal_used")).otherwise(F.col("fallback")).alias("skills_of"),
            required.alias("required"),
        )
    )
    return small_side(table)


ENTRY = "struct<pos: int, skill: string, path: array<string>, course: string>"


def attach_requirements(resolved: DataFrame, requirements: DataFrame) -> DataFrame:
    """Look up the required skills of each request's goal."""
    return resolved.join(requirements, "goal_used", "left")


def goal_consistency(supported: DataFrame, goal_skills: DataFrame, registry: DataFrame) -> DataFrame:
    """Which of the three goal lists each goal key appears in."""

    def keys(df: DataFrame, flag: str) -> DataFrame:
        return df.select(goal_key(F.col("goal")).alias("goal_key")).distinct().withColumn(flag, F.lit(True))

    joined = (
        keys(supported, "is_supported")
        .join(keys(goal_skills, "has_skills"), "goal_key", "full")
        .join(keys(registry, "is_registered"), "goal_key", "full")
    )
    return joined.fillna(False)


