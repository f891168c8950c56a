"""Matched and missing skills, coverage and the learning path, all within the request's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closing item of a learning path.
TAIL_STEP = "Create portfolio projects that showcase your skills in these areas"
TAIL_COURSE = "Not applicable"


def skill_gap(df: DataFrame) -> DataFrame:
    """From ``required`` and ``found_skills``: matched and missing skills in required order."""
    missing = _missing_entries()
    return df.withColumns(
        {
            "matched_skills": F.array_intersect(F.col("required.skill"), F.col("found_skills")),
            "missing_skills": F.transform(missing, lambda entry: entry.skill),
        }
    )


def _missing_entries() -> Column:
    found = F.col("found_skills")
    return F.filter("required", lambda entry: ~F.array_contains(found, entry.skill))


def coverage() -> Column:
    """Matched over required skills; 0 when the goal requires none."""
    required = F.size("required")
    return F.when(required > 0, F.size("matched_skills") / required).otherwise(F.lit(0.0))


def learning_path() -> Column:
    """One item per missing skill, in order, and a closing item if anything is missing.

    Items without path or course are left out.
    """
    missing = _missing_entries()
    usable = F.filter(missing, lambda entry: entry.path.isNotNull() & entry.course.isNotNull())
    items = F.transform(usable, lambda entry: F.struct(entry.path.alias("path"), entry.course.alias("course")))
    tail = F.struct(F.array(F.lit(TAIL_STEP)).alias("path"), F.lit(TAIL_COURSE).alias("course"))
    return F.when(F.size(missing) > 0, F.concat(items, F.array(tail))).otherwise(items)


def skill_rows(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per skill of an array column, with its position.

    The outer form with a filter behind it: a plain explode makes the optimiser filter on the
    array's size first, which computes the array a second time.
    """
    rows = df.select(*keys, F.posexplode_outer(column).alias("pos", "skill"))
    return rows.filter(F.col("skill").isNotNull())
