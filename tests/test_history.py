"""The request history: batches count once, whatever fails or is repeated."""

import datetime
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gapscore import files
from gapscore.sources.history import History, history_rows, keep_history
from gapscore.streaming import history_stream
from workload import fixtures as fx
from workload.queries import _dated_requests


@pytest.fixture
def history(spark, tmp_path):
    return History(spark, str(tmp_path / "history"))


@pytest.fixture(scope="module")
def dims(spark):
    dims = fx.dimensions(spark)
    return replace(dims, config=replace(dims.config, store_request_history=True))


@pytest.fixture(scope="module")
def dated(spark, sf):
    return _dated_requests(fx.documents(spark, sf, "doc_id", "lang", "text")).filter("doc_id < 30").drop("doc_id")


def students(history):
    return sorted(r.student_id for r in history.read().collect())


def test_a_repeated_batch_adds_nothing(history, dims, dated):
    assert history.read().collect() == []
    assert keep_history(history, "a", dated, dims)
    before = students(history)
    assert len(before) == dated.count()
    assert not keep_history(history, "a", dated.limit(3), dims)
    assert students(history) == before
    assert keep_history(history, "b", dated, dims)
    assert students(history) == sorted(before * 2)
    assert {r.batch for r in history.read().select("batch").distinct().collect()} == {"a", "b"}


def test_rows_of_a_failed_attempt_are_not_read(history, dims, dated, monkeypatch):
    rows = history_rows(dated, dims)
    with monkeypatch.context() as broken:
        broken.setattr(History, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            history.append(rows, "a")
    assert students(history) == []
    assert history.append(rows, "a")
    assert len(students(history)) == dated.count()


def test_of_two_writers_one_counts(history, spark, dims, dated, monkeypatch):
    rows, other = history_rows(dated, dims), History(spark, history.folder)
    assert other.append(rows.limit(5), "a")
    exists = files.exists
    looked_before = lambda spark, path: not path.endswith("a.json") and exists(spark, path)
    monkeypatch.setattr(files, "exists", looked_before)
    assert not history.append(rows, "a")
    monkeypatch.undo()
    assert len(students(history)) == 5
    days = [path for name, path in files.children(spark, history.rows) if name.startswith("day")]
    attempts = {name for day in days for name, _ in files.children(spark, day)}
    assert len(attempts) == 1


def test_days_expire_and_stay_gone(history, dims, dated):
    keep_history(history, "a", dated, dims)
    assert history.expire(datetime.date(2026, 1, 3)) == ["2026-01-01", "2026-01-02"]
    days = {r.day for r in history.read().select("day").distinct().collect()}
    assert min(days) == datetime.date(2026, 1, 3) and len(days) == 5
    keep_history(history, "a", dated, dims)
    assert {r.day for r in history.read().select("day").distinct().collect()} == days


def test_a_day_is_read_without_the_others(history, dims, dated):
    keep_history(history, "a", dated, dims)
    one = history.read().filter(F.col("day") == datetime.date(2026, 1, 4))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and one.count() == dated.filter("date(requested_at) = '2026-01-04'").count()


def test_rejected_requests_and_names(history, dims, dated):
    bare = replace(dims, config=replace(dims.config, anonymize_student_data=True))
    keep_history(history, "a", dated, bare, salt="s")
    rows = history.read().collect()
    refused = [r for r in rows if not r.accepted]
    assert refused and all(r.score is None and r.details == ["body.goal: Field required"] for r in refused)
    assert all(len(r.student_id) == 64 for r in rows)
    assert all(0 <= r.score <= 1 and r.details == [] for r in rows if r.accepted)


def test_only_if_configured(history, spark, dated):
    assert not keep_history(history, "a", dated, fx.dimensions(spark))
    assert students(history) == []


def test_names_of_batches(history, dims, dated):
    for name in ("", "a/b"):
        with pytest.raises(ValueError, match="name of a batch"):
            history.append(history_rows(dated, dims), name)


def test_a_stream_goes_on_and_is_replayed(history, spark, dims, dated, tmp_path):
    source = str(tmp_path / "in")

    def run(log):
        arriving = spark.readStream.schema(dated.schema).parquet(source)
        history_stream(arriving, dims, history, "s", str(tmp_path / log), available_now=True).awaitTermination()

    for part in (0, 1):
        dated.filter(F.pmod(F.hash("student_id"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
        run("log")
    whole = sorted(r.student_id for r in dated.collect())
    assert students(history) == whole
    run("lost")
    assert students(history) == whole
