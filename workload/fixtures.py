"""Dictionaries made of words of the provided documents, and tables derived from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore import schemas
from gapscore.config import Config
from gapscore.operators.linear import MAX_BROADCAST_MODELS, GoalModels, pack_models
from gapscore.operators.score import Dimensions, load_dimensions
from gapscore.operators.split import training_gate
from gapscore.operators.tfidf import Vocabulary, fit_vocabulary, load_vocabulary, tfidf_rows
from gapscore.sources.dictionaries import SkillRules
from gapscore.sources.models import current_version, load_models, save_models
from gapscore.storage import local_table, materialise, small_side, spread, work_dir

# "es" is supported but has no skills of its own; "de" has skills but is not supported.
CONFIG = {
    "version": "1.0.0",
    "minimum_score_to_pass": 0.5,
    "log_score_details": True,
    "model_goals_supported": ["en", "fr", "es", "en"],
    "default_goal_model": "en",
}

GOALS = {
    "en": ["thing", "thor", "erin", "eron eror", "of that", "erly", "ered", "zzyzx"],
    "fr": ["étion", "elle", "éeau", "ment", "oument", "dans le"],
    "de": ["nicht", "keit", "ersch", "enheit"],
}

# In order. "thes" cascades thes -> thing -> thor and its second claim by "erly" never applies;
# "eron" expands into a text that contains it; "of the" has two words.
SYNONYMS = [
    ("thing", "thes"),
    ("thing", "thed"),
    ("thor", "thing"),
    ("thor", "thorr"),
    ("erin", "erat"),
    ("erin", "eran"),
    ("eron eror", "eron"),
    ("of that", "of the"),
    ("dans", "pour"),
    ("étion", "dans"),
    ("elle", "éelle"),
    ("elle", "èaux"),
    ("nicht", "sich"),
    ("keit", "heit"),
    ("keit", "lich"),
    ("erly", "thes"),
]

# "thor" repeats and its last entry counts; "ered" lacks a course.
RECOMMENDATIONS = [
    ("thor", "1. Old → 2. Older", "Old course"),
    ("erin", "1. Read → 2. Write", "Course of erin"),
    ("thor", "1. Start → → 2. Practise →  3. Finish ", "Course of thor"),
    ("erly", "One step", "Course of erly"),
    ("ered", "1. Look", None),
    ("of that", "1. This → 2. That", "Course of that"),
    ("étion", "1. Lire → 2. Écrire", "Cours"),
    ("elle", "1. Parler", "Cours d'elle"),
    ("nicht", "1. Lesen → 2. Schreiben", "Kurs"),
]

# Terms with punctuation at an edge: ".com" needs a word before it, "page=" one after it and
# "://" both. The first rule joins its result to the word before it.
EDGE_SYNONYMS = [("dotcom", ".com"), ("-org", ".org"), ("web", "http"), ("://web.", "://")]
EDGE_SKILLS = ["web", "exampledotcom", "-org", "example.net", "://", ".net", "page=", "web.m", "&", "dotcom"]

FEW_SKILLS = ["thing", "thor", "elle"]

STOP_WORDS = ["the", "and", "of", "to", "le", "la", "de", "et", "der", "die", "und", "el", "en", "que"]
MAX_DF = 0.5

# As a file: "en" is there twice and its last list counts, "fr" is an empty list, "es" is not there at
# all, and neither is the default goal.
GOALS_FILE = '{"en": ["zzyzx", "never"], "fr": [], "de": ["nicht"], "en": ["that", "with", "thing"]}'
GOALS_FILE_LAST = ["that", "with", "thing"]
GOALS_FILE_CONFIG = {**CONFIG, "default_goal_model": "it"}

SALT = "pepper"


def config() -> Config:
    return Config.from_dict(CONFIG)


def goal_skills(spark: SparkSession) -> DataFrame:
    rows = [(goal, pos, skill) for goal, skills in GOALS.items() for pos, skill in enumerate(skills)]
    return local_table(spark, rows, schemas.GOAL_SKILLS)


def synonyms(spark: SparkSession) -> DataFrame:
    rows = [(number, canonical, synonym) for number, (canonical, synonym) in enumerate(SYNONYMS)]
    return local_table(spark, rows, schemas.SYNONYMS)


def recommendations(spark: SparkSession) -> DataFrame:
    rows = [(seq, *entry) for seq, entry in enumerate(RECOMMENDATIONS)]
    return local_table(spark, rows, schemas.RECOMMENDATIONS)


def dimensions(spark: SparkSession) -> Dimensions:
    return load_dimensions(config(), goal_skills(spark), synonyms(spark), recommendations(spark))


def few_rules() -> SkillRules:
    """The first rules of the cascade and some skills they lead to."""
    return SkillRules(tuple((synonym, canonical) for canonical, synonym in SYNONYMS[:4]), tuple(FEW_SKILLS))


def edge_rules() -> SkillRules:
    return SkillRules(tuple((synonym, canonical) for canonical, synonym in EDGE_SYNONYMS), tuple(EDGE_SKILLS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    return docs.select(
        F.concat(F.lit("stu_"), F.col("doc_id").cast("string")).alias("student_id"),
        F.col("lang").alias("goal"),
        F.col("text").alias("resume_text"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    return docs.join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two goals, one per label column."""
    by_goal = F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (goal, label)")
    rows = labelled(spark, sf_dir).select("doc_id", F.col("text").alias("resume_text"), "quality", "toxic")
    return rows.select("doc_id", "resume_text", by_goal)


def training_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items without their texts."""
    by_goal = F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (goal, label)")
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select("doc_id", by_goal)


def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fate of one goal per source, and of one per source and language."""
    docs = documents(spark, sf_dir, "doc_id", "source", "lang")
    known = docs.join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left").select(
        F.explode(F.array("source", F.concat_ws("/", "source", "lang"))).alias("goal"),
        F.col("quality").alias("label"),
    )
    goals = known.select("goal").distinct()
    return training_gate(goals, known.filter(F.col("label").isNotNull()))


def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_vocabulary(documents(spark, sf_dir, "text"), "text", STOP_WORDS, max_df=MAX_DF)


def vocabulary(spark: SparkSession, sf_dir: str) -> Vocabulary:
    return load_vocabulary(vocabulary_table(spark, sf_dir), STOP_WORDS)


def log_odds(spark: SparkSession, sf_dir: str, vocab: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Coefficients that SQL can compute as well: smoothed log-odds of each term by label."""
    texts = labelled(spark, sf_dir).select("doc_id", "quality", "toxic", "text")
    present = tfidf_rows(texts, "text", vocab, ["doc_id", "quality", "toxic"])
    by_goal = F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (goal, label)")
    odds = F.round(F.log((F.sum("label") + 1) / (F.count("*") - F.sum("label") + 1)), 6)
    coefficients = present.select("term_id", by_goal).groupBy("goal", "term_id").agg(odds.alias("coef"))
    intercepts = training_ids(spark, sf_dir).groupBy("goal").agg(odds.alias("intercept"))
    return coefficients, intercepts


def save_fit(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Fit vocabulary and models on the tables and store them as a version of the folder."""
    vocab = materialise(vocabulary_table(spark, sf_dir), "vocabulary")
    loaded = load_vocabulary(vocab, STOP_WORDS)
    coefficients, intercepts = log_odds(spark, sf_dir, loaded)
    packed = pack_models(coefficients, intercepts, len(loaded.terms))
    registry = training_ids(spark, sf_dir).groupBy("goal").agg(F.count("*").alias("samples"))
    return save_models(folder, vocab, STOP_WORDS, packed, registry)


def fitted(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the models of the tables: fitted and stored by the first query of an application that asks."""
    place = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    folder = f"{work_dir(spark)}/fitted-{spark.sparkContext.applicationId}-{place}"
    if current_version(spark, folder) is None:
        save_fit(spark, sf_dir, folder)
    return folder


def models(spark: SparkSession, sf_dir: str) -> GoalModels:
    stored = load_models(spark, fitted(spark, sf_dir))
    return GoalModels(stored.vocabulary, small_side(stored.table, MAX_BROADCAST_MODELS))
