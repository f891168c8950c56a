"""Streams give what the batch gives."""

from dataclasses import replace

from pyspark.sql import functions as F

from gapscore import schemas
from gapscore.plans.scoring import respond
from gapscore.streaming import latest_counts, requests_per_minute, respond_stream, respond_stream_with, write_counts
from workload import fixtures as fx
from workload.queries import QUERIES


def test_scoring_in_two_arrivals(spark, sf, tmp_path):
    source, output, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    batch = fx.requests(spark, sf)
    dims = fx.dimensions(spark)
    for part in (0, 1):
        batch.filter(F.pmod(F.hash("student_id"), F.lit(2)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.REQUEST).parquet(source)
        respond_stream(stream, dims, output, log, available_now=True).awaitTermination()
    columns = ["student_id", "goal_used", "score", "matched_skills", "missing_skills"]
    got = spark.read.parquet(output).select(columns)
    expected = respond(batch, dims).select(columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_counts_over_several_batches(spark, tmp_path):
    source, output, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    arrivals = [["00:00:10", "00:00:20", "00:05:00"], ["00:00:30", "00:05:30", "00:30:00"]]
    for times in arrivals:
        rows = [("u", f"2024-01-01 {t}") for t in times]
        events = spark.createDataFrame(rows, "user STRING, t STRING")
        events.selectExpr("user", "CAST(t AS TIMESTAMP_NTZ) AS ts").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user STRING, ts TIMESTAMP_NTZ").parquet(source)
        write_counts(requests_per_minute(stream, "user", "ts"), output, log, available_now=True).awaitTermination()
    latest = latest_counts(spark.read.parquet(output), "user")
    counts = {r.minute.strftime("%H:%M"): r.requests for r in latest.collect()}
    assert counts == {"00:00": 3, "00:05": 2, "00:30": 1}


def test_each_batch_has_one_dictionary(spark, sf, tmp_path):
    """What is current is asked for once a batch, while the stream runs."""
    source, output, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    dims, asked = fx.dimensions(spark), []

    def current(session):
        asked.append(len(asked))
        strict = replace(dims.config, supported_goals=("fr",), default_goal="fr")
        return (dims if len(asked) == 1 else replace(dims, config=strict)), None

    fx.requests(spark, sf).limit(60).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schemas.REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
    respond_stream_with(stream, current, output, log, available_now=True).awaitTermination()
    rows = spark.read.parquet(output).collect()
    assert len(asked) == 3 and len(rows) == 60
    assert {r.goal_used for r in rows if r.batch > 0} == {"fr"} and len({r.goal_used for r in rows if r.batch == 0}) > 1


def test_tables_as_folders_of_files(spark, tmp_path):
    """A table may be a folder with many files."""
    text = F.when(F.col("id") % 2 == 0, "a thing").otherwise("nothing")
    docs = spark.range(0, 20, 1, 4).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    second = F.timestamp_seconds(F.col("id") * 30).cast("timestamp_ntz").alias("ts")
    spark.range(0, 20, 1, 4).select(F.lit(7).alias("user_id"), second).write.parquet(f"{tmp_path}/events.parquet")
    scored = QUERIES["stream_score"](spark, str(tmp_path)).collect()
    assert {r.student_id for r in scored} == {f"stu_{i}" for i in range(20)}
    assert all((r.score > 0) == (int(r.student_id[4:]) % 2 == 0) for r in scored)
    counted = QUERIES["stream_rate_limit"](spark, str(tmp_path)).collect()
    assert len(counted) == 10 and {r.requests for r in counted} == {2}
