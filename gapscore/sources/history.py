"""The request history: an append log of scored and rejected requests in which a repeated batch adds nothing.

Rows lie below ``rows/day=.../attempt=...``; a batch counts once a marker names its attempt. The marker is
put in place by one rename that fails if the batch has one, so of several attempts at a batch (a
task run again, a stream replayed after a crash, two writers) exactly one is ever read.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapscore import files
from gapscore.operators.extensions import anonymise
from gapscore.operators.linear import GoalModels
from gapscore.operators.score import Dimensions
from gapscore.plans.scoring import rejects, respond
from gapscore.storage import small_side

SCHEMA = (
    "student_id STRING, goal STRING, goal_used STRING, accepted BOOLEAN, score DOUBLE, "
    "matched_skills ARRAY<STRING>, missing_skills ARRAY<STRING>, details ARRAY<STRING>"
)
_STORED = SCHEMA + ", day DATE, attempt STRING"
_MARKER = "batch STRING, attempt STRING"


def history_rows(
    requests: DataFrame, dims: Dimensions, models: GoalModels | None = None, time: str = "requested_at", salt: str = ""
) -> DataFrame:
    """One row for each request, scored or rejected, and its day. No text is kept.

    ``time`` is the column with the time of the request. If the configuration asks for it, students are anonymised.
    """
    day, nothing = F.to_date(time).alias("day"), F.lit(None)
    scored = respond(requests, dims, models, keep=[time]).select(
        "student_id", "goal", "goal_used", F.lit(True).alias("accepted"), "score", "matched_skills", "missing_skills",
        F.expr("array()").cast("array<string>").alias("details"), day,
    )
    refused = rejects(requests).select(
        "student_id", "goal", nothing.cast("string").alias("goal_used"), F.lit(False).alias("accepted"), nothing.cast("double").alias("score"),
        *(nothing.cast("array<string>").alias(c) for c in ("matched_skills", "missing_skills")), "details", day,
    )
    rows = scored.unionByName(refused)
    return anonymise(rows, salt) if dims.config.anonymize_student_data else rows


class History:
    """A history folder. Several writers may share it if the file system's rename is atomic."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rows, self.markers = f"{self.folder}/rows", f"{self.folder}/batches"

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add rows (of ``history_rows``) as a batch; false, and nothing added, if the batch is there already."""
        if "/" in batch or not batch:
            raise ValueError(f"not usable as the name of a batch: {batch!r}")
        if files.exists(self.spark, self._marker(batch)):
            return False
        attempt = uuid.uuid4().hex
        named = rows.select(*StructType.fromDDL(SCHEMA).names, "day", F.lit(attempt).alias("attempt"))
        named.write.mode("append").partitionBy("day", "attempt").parquet(self.rows)
        if self._commit(batch, attempt):
            return True
        self.vacuum(attempt)
        return False

    def batches(self) -> DataFrame:
        """(batch, attempt) of the batches that count."""
        empty = self.spark.createDataFrame([], _MARKER)
        if not files.exists(self.spark, self.markers):
            return empty
        return self.spark.read.schema(_MARKER).option("pathGlobFilter", "*.json").json(self.markers)

    def read(self) -> DataFrame:
        """The rows of all batches that count, with their day and batch; days are read as asked for."""
        if not files.exists(self.spark, self.rows):
            return self.spark.createDataFrame([], f"{SCHEMA}, day DATE, batch STRING")
        stored = self.spark.read.schema(_STORED).parquet(self.rows)
        return stored.join(small_side(self.batches()), "attempt").drop("attempt")

    def expire(self, before: datetime.date) -> list[str]:
        """Delete the days before ``before``. Markers stay, so a late replay does not bring a day back."""
        gone = []
        for name, path in files.children(self.spark, self.rows):
            column, _, day = name.partition("=")
            if column == "day" and day < before.isoformat():
                files.delete(self.spark, path)
                gone.append(day)
        return sorted(gone)

    def vacuum(self, attempt: str) -> None:
        """Delete the rows of an attempt that does not count."""
        for _, day in files.children(self.spark, self.rows):
            for name, path in files.children(self.spark, day):
                if name == f"attempt={attempt}":
                    files.delete(self.spark, path)

    def _marker(self, batch: str) -> str:
        return f"{self.markers}/{batch}.json"

    def _commit(self, batch: str, attempt: str) -> bool:
        return files.put_text(self.spark, self._marker(batch), json.dumps({"batch": batch, "attempt": attempt}))


def keep_history(
    history: History,
    batch: str,
    requests: DataFrame,
    dims: Dimensions,
    models: GoalModels | None = None,
    time: str = "requested_at",
    salt: str = "",
) -> bool:
    """Append a batch of requests if the configuration says ``store_request_history``; whether rows were added."""
    if not dims.config.store_request_history:
        return False
    return history.append(history_rows(requests, dims, models, time, salt), batch)
