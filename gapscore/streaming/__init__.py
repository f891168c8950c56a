"""Streaming forms of scoring and of the rate limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapscore.operators.linear import GoalModels
from gapscore.operators.score import Dimensions
from gapscore.plans.scoring import rejects, respond
from gapscore.sources.history import History, keep_history


def respond_stream(
    requests: DataFrame,
    dims: Dimensions,
    output: str,
    checkpoint: str,
    models: GoalModels | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Score a stream of requests into parquet files. Stateless, so restarts resume exactly.

    Dictionaries and models are those of the start; ``respond_stream_with`` takes new ones as it runs. Requests that cannot
    be scored go to ``reject_stream``.
    """
    return _to_files(respond(requests, dims, models), output, checkpoint, available_now)


def respond_stream_with(
    requests: DataFrame,
    current: Callable[[SparkSession], tuple[Dimensions, GoalModels | None]],
    output: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Score a stream with the dictionaries and models of the moment: ``current`` is asked at the start of each micro-batch.

    A micro-batch is scored with one answer throughout, and written under its number; one that is run again replaces
    its own rows, with what is current then.
    """

    def store(batch: DataFrame, number: int) -> None:
        dims, models = current(batch.sparkSession)
        respond(batch, dims, models).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reject_stream(requests: DataFrame, output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The rejected requests of the same stream with their details, into files of their own."""
    return _to_files(rejects(requests), output, checkpoint, available_now)


def history_stream(
    requests: DataFrame,
    dims: Dimensions,
    history: History,
    name: str,
    checkpoint: str,
    models: GoalModels | None = None,
    time: str = "requested_at",
    salt: str = "",
    available_now: bool = False,
) -> StreamingQuery:
    """Append a stream of requests to the history, a batch for each micro-batch, if the configuration says so.

    A micro-batch that is run again after a failure has the same name, so it adds nothing.
    """

    def store(batch: DataFrame, number: int) -> None:
        keep_history(history, f"{name}-{number}", batch, dims, models, time, salt)

    writer = requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _to_files(rows: DataFrame, output: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def requests_per_minute(requests: DataFrame, user: str, time: str, lateness: str = "10 minutes") -> DataFrame:
    """Requests per user and minute; state older than the allowed lateness is dropped."""
    # Watermarks need an instant, not a wall-clock time.
    timed = requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = timed.groupBy(F.window(time, "1 minute"), F.col(user)).agg(F.count("*").alias("requests"))
    return counts.select(user, F.col("window.start").alias("minute"), "requests")


def write_counts(counts: DataFrame, output: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep each batch's changed counts under its batch number; a repeated batch replaces its own."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = (
        counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_counts(stored: DataFrame, user: str) -> DataFrame:
    """The last value of each count; counts only grow."""
    return stored.groupBy(user, "minute").agg(F.max("requests").alias("requests"))
