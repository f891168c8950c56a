"""Switches that a configuration can declare beyond scoring itself. All are opt-in."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.config import Config
from gapscore.functions.text import WORD_CHAR
from gapscore.storage import small_side

#: Beyond so many skills their pieces are not held by every worker.
MAX_SKILLS = 10_000
# Runs that a task remembers, and counts before it hands them on.
_REMEMBERED = 200_000


def anonymise(df: DataFrame, salt: str, column: str = "student_id") -> DataFrame:
    return df.withColumn(column, F.sha2(F.concat(F.lit(salt), F.col(column)), 256))


def over_rate_limit(requests: DataFrame, user: str, time: str, limit: int) -> DataFrame:
    """Users and minutes with more requests than ``limit``."""
    minute = F.date_trunc("minute", F.col(time))
    counts = requests.groupBy(F.col(user), minute.alias("minute")).agg(F.count("*").alias("requests"))
    return counts.filter(F.col("requests") > limit)


def low_scores(scored: DataFrame, config: Config) -> DataFrame:
    return scored.filter(F.col("score") < config.alert_threshold_score)


class _Pieces:
    """Where a run of words that nearly equals a skill must agree with it, as sets to look into.

    A run within d edits of a skill that is cut into d + 1 pieces has one of them unchanged, at most d places
    further on or back. ``places`` has (place, length) by the number of words and the length of a run, ``pieces``
    the (place, piece) that may stand there.
    """

    def __init__(self, skills: list[str], threshold: float):
        self.places: dict[tuple[int, int], set[tuple[int, int]]] = {}
        self.pieces: dict[tuple[int, int], set[tuple[int, str]]] = {}
        for name in {skill.lower() for skill in skills}:
            size, words = len(name), len(name.split(" "))
            for reach in range(math.ceil(size * threshold - 1e-9), math.floor(size / threshold + 1e-9) + 1):
                edits = math.floor((1 - threshold) * max(size, reach) + 1e-9)
                places = self.places.setdefault((words, reach), set())
                pieces = self.pieces.setdefault((words, reach), set())
                for k in range(edits + 1):
                    begin, end = k * size // (edits + 1), (k + 1) * size // (edits + 1)
                    for at in range(max(begin - edits, 0), min(begin + edits, reach - (end - begin)) + 1):
                        places.add((at, end - begin))
                        pieces.add((at, name[begin:end]))
        self.longest = max((words for words, _ in self.places), default=0)

    def hit(self, words: int, run: str) -> bool:
        found = self.pieces.get((words, len(run)))
        return found is not None and any((at, run[at : at + n]) in found for at, n in self.places[words, len(run)])


def _hits(df: DataFrame, column: str, pieces: _Pieces) -> DataFrame:
    """``(run, documents)``: the runs of words that hit a piece, with their texts counted in each task."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, known, counts = re.compile(r"\w+").findall, {}, Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["run", "documents"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                listed, found = word(text.as_py() or ""), set()
                for n in range(1, pieces.longest + 1):
                    runs = set(listed) if n == 1 else {" ".join(listed[i : i + n]) for i in range(len(listed) - n + 1)}
                    for run in runs:
                        hit = known.get(run)
                        if hit is None:
                            if len(known) >= _REMEMBERED:
                                known.clear()
                            hit = known[run] = pieces.hit(n, run)
                        if hit:
                            found.add(run)
                counts.update(found)
                if len(counts) >= _REMEMBERED:
                    yield rows()
        if counts:
            yield rows()

    counted = df.select(F.lower(column).alias("text")).mapInArrow(look, "run string, documents long")
    return counted.groupBy("run").agg(F.sum("documents").alias("documents"))


def _word_runs(df: DataFrame, column: str, longest: int) -> DataFrame:
    """``(run, documents)``: runs of up to ``longest`` words and the number of texts that have each."""
    listed = df.select(F.regexp_extract_all(F.lower(column), F.lit(WORD_CHAR + "+"), F.lit(0)).alias("w"))
    runs = [
        F.transform(
            F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i + n - 1 <= F.size("w")),
            lambda i: F.array_join(F.slice("w", i, n), " "),
        )
        for n in range(1, longest + 1)
    ]
    # strings are told apart by a hash set, structs would be compared pair by pair
    every = listed.filter(F.size("w") > 0).select(F.explode(F.array_distinct(F.concat(*runs))).alias("run"))
    return every.groupBy("run").agg(F.count("*").alias("documents"))


def _segments(universe: DataFrame, threshold: float) -> DataFrame:
    """For each skill and run length in reach: pieces of the skill and where a run may have them.

    A run within d edits of a skill that is cut into d + 1 pieces has one of them unchanged, at most d places
    further on or back.
    """
    size = F.length("name")
    shortest, longest = F.ceil(size * threshold - 1e-9).cast("int"), F.floor(size / threshold + 1e-9).cast("int")
    edits = F.floor((1 - threshold) * F.greatest("size", "reach") + 1e-9).cast("int")
    begin = F.floor(F.col("k") * F.col("size") / (F.col("edits") + 1)).cast("int")
    end = F.floor((F.col("k") + 1) * F.col("size") / (F.col("edits") + 1)).cast("int")
    named = universe.select("skill", F.lower("skill").alias("name"))
    return (
        named.withColumn("words", F.size(F.split("name", " ")))
        .withColumn("size", size)
        .withColumn("reach", F.explode(F.sequence(shortest, longest)))
        .withColumn("edits", edits)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        .withColumns({"begin": begin, "length": end - begin})
        .withColumn("at", F.explode(F.sequence(F.col("begin") - F.col("edits"), F.col("begin") + F.col("edits"))))
        .filter((F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.col("reach")))
        .withColumn("piece", F.substring("name", F.col("begin") + 1, F.col("length")))
        .select("skill", "name", "words", "reach", "at", "length", "piece")
    )


def _near(runs: DataFrame, universe: DataFrame, threshold: float) -> DataFrame:
    """Runs and skills that share a piece at its place, compared."""
    segments = _segments(universe, threshold)
    # Where to look in a run depends on its words and length only.
    places = small_side(segments.select("words", "reach", "at", "length").distinct())
    runs = runs.withColumns({"reach": F.length("run"), "words": F.size(F.split("run", " "))})
    looked = runs.join(places, ["words", "reach"]).withColumn("piece", F.substring("run", F.col("at") + 1, F.col("length")))
    pairs = looked.join(small_side(segments), ["words", "reach", "at", "length", "piece"])
    longer = F.greatest(F.length("run"), F.length("name"))
    return (
        pairs.select("skill", "name", "run", "documents")
        .distinct()
        .withColumn("similarity", 1 - F.levenshtein("run", "name") / longer)
        .filter(F.col("similarity") >= threshold - 1e-9)
        .select("skill", F.col("run").alias("word"), "documents", "similarity")
    )


def partial_matches(df: DataFrame, column: str, universe: DataFrame, threshold: float) -> DataFrame:
    """Words of the texts that nearly equal a skill: ``(skill, word, documents, similarity)``.

    Similarity is one minus the edit distance over the longer length. A skill of several words is compared with
    runs of as many words. The texts are read once, and a run leaves its task only if it has a piece of a skill where a
    match would have it, so neither the words nor the runs of the corpus are shuffled. A hit is compared with the
    skills that share a piece with it; beyond ``MAX_SKILLS`` skills these meet in parts, each with its own pieces.
    """
    skills = [r.skill for r in universe.select("skill").distinct().limit(MAX_SKILLS + 1).collect()]
    if len(skills) > MAX_SKILLS:
        return _matches_in_parts(df, column, universe, threshold)
    return _near(_hits(df, column, _Pieces(skills, threshold)), universe, threshold)


def _matches_in_parts(df: DataFrame, column: str, universe: DataFrame, threshold: float) -> DataFrame:
    """As ``partial_matches`` for any number of skills: distinct runs are shuffled once and meet pieces by a join."""
    longest = universe.agg(F.max(F.size(F.split(F.lower("skill"), " "))).alias("n")).first()["n"] or 1
    return _near(_word_runs(df, column, longest), universe, threshold)
