"""Model training: training files in, stored models out."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.operators.tfidf import MAX_DF, MAX_FEATURES, MIN_DF, fit_vocabulary, load_vocabulary
from gapscore.operators.train import Training, train
from gapscore.sources.models import save_models
from gapscore.storage import materialise


def train_and_save(
    training: DataFrame,
    folder: str,
    stop_words: list[str] | None = None,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> Training | None:
    """Fit the shared vocabulary on all texts, train all goals and store the tables.

    The vocabulary also uses items without a label. None if there is no text at all.
    """
    words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    texts = training.filter(F.col("resume_text").isNotNull())
    if texts.isEmpty():
        return None
    vocabulary = materialise(
        fit_vocabulary(texts.select("resume_text"), "resume_text", words, max_features, min_df, max_df),
        "vocabulary",
    )
    trained = train(training, load_vocabulary(vocabulary, words))
    save_models(folder, vocabulary, words, trained.models, trained.registry)
    return trained
