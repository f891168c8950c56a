"""Scores tables of profile documents against goals made of required skills, on Spark."""

from gapscore.config import Config, load_config
from gapscore.operators.extract import canonicalise, extract_skills
from gapscore.operators.linear import GoalModels, score_all_goals
from gapscore.operators.score import Dimensions, load_dimensions, passed, score, usage
from gapscore.operators.tfidf import fit_vocabulary, load_vocabulary, tfidf
from gapscore.operators.train import train
from gapscore.plans.audit import audit
from gapscore.plans.scoring import answer, rejects, respond, write_answers, write_responses
from gapscore.plans.training import train_and_save
from gapscore.sources.history import History, keep_history
from gapscore.sources.models import load_models, save_models
from gapscore.streaming import history_stream, reject_stream, respond_stream

__all__ = [
    "Config",
    "Dimensions",
    "GoalModels",
    "History",
    "answer",
    "audit",
    "canonicalise",
    "extract_skills",
    "fit_vocabulary",
    "history_stream",
    "keep_history",
    "load_config",
    "load_dimensions",
    "load_models",
    "load_vocabulary",
    "passed",
    "reject_stream",
    "rejects",
    "respond",
    "respond_stream",
    "save_models",
    "score",
    "score_all_goals",
    "tfidf",
    "train",
    "train_and_save",
    "usage",
    "write_answers",
    "write_responses",
]
