"""A vocabulary that grows with its texts: counts are kept, only new texts are counted, and the top terms are read from them.

Each batch of texts leaves its counts of terms and a marker with the number of its texts; a batch whose marker is
there adds nothing. ``compact`` merges what there is into a base, and a pointer to it is switched last. Counts of terms add
up over batches, so the vocabulary is that of all texts at once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gapscore import files
from gapscore.operators.tfidf import MAX_DF, MAX_FEATURES, MIN_DF, corpus_counts, ranked_parts, ranked_vocabulary
from gapscore.storage import shuffles_end_with_query

_COUNTS = "term STRING, corpus_tf BIGINT, df BIGINT, attempt STRING"


class VocabularyState:
    def __init__(self, spark: SparkSession, folder: str, stop_words: list[str]):
        """The stop words of a state are fixed by its first use."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.stop_words = list(stop_words)
        self.parts, self.markers = f"{self.folder}/counts", f"{self.folder}/batches"
        settings = json.dumps({"stop_words": sorted(stop_words)})
        if not files.put_text(spark, f"{self.folder}/settings.json", settings) and files.read_text(spark, f"{self.folder}/settings.json") != settings:
            raise ValueError(f"{folder} was counted with other stop words")

    def add(self, texts: DataFrame, column: str, batch: str) -> bool:
        """Count the texts of a new batch; false if it has been counted."""
        marker = f"{self.markers}/{batch}.json"
        if "/" in batch or not batch:
            raise ValueError(f"not usable as the name of a batch: {batch!r}")
        if files.exists(self.spark, marker):
            return False
        texts = texts.filter(F.col(column).isNotNull())
        attempt, n = uuid.uuid4().hex, texts.count()
        self._write(corpus_counts(texts, column, None, stop_words=self.stop_words), attempt)
        if files.put_text(self.spark, marker, json.dumps({"attempt": attempt, "texts": n, "plain": isinstance(texts.schema[column].dataType, StringType)})):
            return True
        files.delete(self.spark, f"{self.parts}/attempt={attempt}")
        return False

    def counts(self) -> tuple[DataFrame, int]:
        """((term, corpus_tf, df), number of texts) of all batches."""
        stored, n = self._stored()
        return stored.groupBy("term").agg(F.sum("corpus_tf").alias("corpus_tf"), F.sum("df").alias("df")), n

    def _stored(self) -> tuple[DataFrame, int]:
        """The same with a row for each term of the base and of each batch that it does not cover."""
        base, batches = self._committed()
        attempts = [b["attempt"] for b in batches.values()] + ([base["attempt"]] if base else [])
        n = sum(b["texts"] for b in batches.values()) + (base["texts"] if base else 0)
        if not attempts:
            return self.spark.createDataFrame([], _COUNTS).drop("attempt"), 0
        stored = self.spark.read.schema(_COUNTS).option("basePath", self.parts).parquet(*(f"{self.parts}/attempt={a}" for a in attempts))
        return stored.drop("attempt"), n

    def compact(self) -> None:
        """Merge all batches into one base. Readers see the old parts or the base; markers stay."""
        base, batches = self._committed()
        if not batches:
            return
        counts, n = self.counts()
        attempt, plain = uuid.uuid4().hex, self._plain(base, batches)
        self._write(counts, attempt)
        covered = sorted({*batches, *(base["batches"] if base else [])})
        files.put_text(self.spark, f"{self.folder}/BASE", json.dumps({"attempt": attempt, "texts": n, "batches": covered, "plain": plain}), replace=True)
        for old in [b["attempt"] for b in batches.values()] + ([base["attempt"]] if base else []):
            files.delete(self.spark, f"{self.parts}/attempt={old}")

    def vocabulary(self, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
        """As ``fit_vocabulary`` over all texts of all batches."""
        if not self._plain(*self._committed()):
            counts, n = self.counts()
            return ranked_vocabulary(counts, n, max_features, min_df, max_df)
        stored, n = self._stored()
        return ranked_parts(stored, n, max_features, min_df, max_df)

    @staticmethod
    def _plain(base: dict | None, batches: dict[str, dict]) -> bool:
        """Whether all words are tokens of texts. An element of a list may hold a space as pairs do."""
        return all(part.get("plain", False) for part in [*batches.values(), *([base] if base else [])])

    def _write(self, counts: DataFrame, attempt: str) -> None:
        with shuffles_end_with_query(self.spark):
            counts.select("term", "corpus_tf", "df").write.parquet(f"{self.parts}/attempt={attempt}")

    def _committed(self) -> tuple[dict | None, dict[str, dict]]:
        """The base, and the batches that it does not cover: one small file each."""
        text = files.read_text(self.spark, f"{self.folder}/BASE")
        base = json.loads(text) if text else None
        batches = {}
        for name, path in files.children(self.spark, self.markers):
            batch, dot, kind = name.rpartition(".")
            if kind == "json" and not (base and batch in base["batches"]):
                batches[batch] = json.loads(files.read_text(self.spark, path))
        return base, batches
