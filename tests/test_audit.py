"""Checks and their roll-up, the three goal lists, and the declared switches."""

import hashlib

import pytest

from gapscore import schemas
from gapscore.config import Config
from gapscore.operators import audit, extensions, goals
from gapscore.plans.audit import audit as run_audit
from gapscore.sources.dictionaries import goal_sizes

RAW = {
    "version": "1",
    "minimum_score_to_pass": 0.65,
    "log_score_details": True,
    "model_goals_supported": ["Data Engineer", "Analyst"],
    "default_goal_model": "Analyst",
}


def tables(spark, stored=("data_engineer", "analyst"), registered=("data_engineer", "analyst")):
    sizes = goal_sizes(spark.createDataFrame([("A", ["x"]), ("B", None)], "goal STRING, skills ARRAY<STRING>"))
    vocabulary = spark.createDataFrame([("a", 0, 1, 1, 1.0)], schemas.VOCABULARY)
    models = spark.createDataFrame([(g, 0.0, [0.0]) for g in stored], schemas.GOAL_MODELS)
    registry = spark.createDataFrame([(g, f"{g}_model.pkl", 0.9, 30, 10, 20, 1) for g in registered], schemas.REGISTRY)
    expected = goals.supported_goals(spark, Config.from_dict(RAW))
    return dict(expected_goals=expected, goal_sizes=sizes, vocabulary=vocabulary, models=models, registry=registry)


def statuses(spark, raw=RAW, **changes):
    checks = run_audit(spark, raw, **{**tables(spark), **changes})
    return {r.check: r.status for r in checks.collect()}, audit.roll_up(checks).first().status


def test_all_well(spark):
    by_check, overall = statuses(spark)
    assert set(by_check.values()) == {"ok"} and overall == "ok"
    assert set(by_check) == {"config", "vectorizer", "models", "goals", "registry"}


def test_some_models_missing(spark):
    some = tables(spark, stored=("analyst",))
    by_check, overall = statuses(spark, models=some["models"])
    assert (by_check["models"], by_check["registry"], overall) == ("degraded", "warning", "degraded")
    row = audit.check_registry(spark, some["registry"], some["models"]).first()
    assert row.details["missing_files"] == "data_engineer_model.pkl"
    assert row.details["has_metrics"] == "true"


def test_everything_absent(spark):
    by_check, overall = statuses(spark, raw={}, goal_sizes=None, vocabulary=None, models=None, registry=None)
    assert by_check == {"config": "error", "vectorizer": "error", "models": "error", "goals": "error", "registry": "warning"}
    assert overall == "degraded"


def test_malformed_goals_are_counted_only(spark):
    row = audit.check_goals(spark, tables(spark)["goal_sizes"]).first()
    assert (row.status, row.details["invalid_format"], row.details["total_goals"]) == ("ok", "1", "2")


def test_performance_never_blocks(spark):
    rows = [("config", "ok", "", {}), ("performance", "warning", "", {})]
    assert audit.roll_up(spark.createDataFrame(rows, schemas.CHECK)).first().status == "ok"


def test_goal_lists(spark):
    def named(*names):
        return spark.createDataFrame([(n,) for n in names], "goal STRING")

    out = goals.goal_consistency(named("Data Engineer", "X"), named("Data Engineer", "Y"), named("data_engineer"))
    assert {tuple(r) for r in out.collect()} == {
        ("data_engineer", True, True, True),
        ("x", True, False, False),
        ("y", False, True, False),
    }


def test_anonymise(spark):
    df = spark.createDataFrame([("stu_1",)], "student_id STRING")
    assert extensions.anonymise(df, "salt").first().student_id == hashlib.sha256(b"saltstu_1").hexdigest()


def test_rate_limit(spark):
    times = ["2024-01-01 00:00:01", "2024-01-01 00:00:59", "2024-01-01 00:01:00"]
    df = spark.createDataFrame([("u", t) for t in times], "u STRING, t STRING").selectExpr("u", "CAST(t AS TIMESTAMP) AS t")
    out = extensions.over_rate_limit(df, "u", "t", 1).collect()
    assert [(r.u, r.requests) for r in out] == [("u", 2)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_partial_matches_of_several_words(spark):
    universe = spark.createDataFrame([("boat hook",), ("keel",)], "skill STRING")
    df = spark.createDataFrame([("A boat hok, boat hooks and keels",), ("boathook",)], "text STRING")
    near = {(r.skill, r.word) for r in extensions.partial_matches(df, "text", universe, 0.8).collect()}
    assert near == {("boat hook", "boat hok"), ("boat hook", "boat hooks"), ("keel", "keels")}


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_partial_matches_against_all_pairs(spark, sf, threshold):
    import re

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    skills = ["ersch", "thing", "éeau", "enheit", "ment", "q"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    universe = spark.createDataFrame([(s,) for s in skills], "skill STRING")
    near = extensions.partial_matches(df, "text", universe, threshold).collect()
    words = {}
    for t in texts:
        for w in set(re.findall(r"\w+", t.lower())):
            words[w] = words.get(w, 0) + 1
    expected = {
        (s, w, n)
        for w, n in words.items()
        for s in skills
        if 1 - _distance(w, s) / max(len(w), len(s)) >= threshold - 1e-9
    }
    assert {(r.skill, r.word, r.documents) for r in near} == expected and expected


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_partial_matches_in_parts_are_the_same(spark, sf, threshold, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "of thaat, of that"), (-4, "THOR thor")], "doc_id long, text string"), allowMissingColumns=True
    )
    universe = spark.createDataFrame([("thor",), ("of that",), ("Étion",), ("a b c",)], "skill string")
    rows = lambda: sorted(map(tuple, extensions.partial_matches(df, "text", universe, threshold).collect()))
    short = rows()
    monkeypatch.setattr(extensions, "MAX_SKILLS", 2)
    assert rows() == short and short


def test_partial_matches_shuffle_hits_only(spark, sf):
    df, universe = spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([("thor",)], "skill string")
    hits = extensions._hits(df, "text", extensions._Pieces(["thor"], 0.8))
    assert 0 < hits.count() < 100
    assert extensions.partial_matches(df, "text", universe.limit(0), 0.8).collect() == []


def test_files_that_cannot_be_read(spark, tmp_path):
    """Broken files are rows; what is left of a set of models decides the status."""
    from gapscore import files
    from gapscore.plans.audit import audit_files
    from gapscore.sources import models
    from gapscore.sources.probe import probe_files

    assert probe_files(spark, str(tmp_path / "none")).collect() == []
    folder, config = str(tmp_path / "m"), {"version": "1"}
    goals = spark.createDataFrame([("A b",), ("c",)], "goal STRING")
    vocabulary = spark.createDataFrame([("w", 0, 1, 1, 1.0)], "term STRING, term_id INT, corpus_tf BIGINT, df BIGINT, idf DOUBLE")
    table = spark.createDataFrame([("a_b", 0.0, [1.0]), ("c", 0.0, [1.0])], "goal STRING, intercept DOUBLE, coefficients ARRAY<DOUBLE>")
    version = models.save_models(folder, vocabulary, [], table.coalesce(1), goals)

    def status():
        return {r.check: (r.status, r.details) for r in audit_files(spark, config, folder, goals).collect()}

    fine = status()
    assert [fine[c][0] for c in ("vectorizer", "models", "registry")] == ["ok"] * 3 and fine["models"][1]["loaded"] == "2"
    at = tmp_path / "m" / "versions" / version
    files.put_text(spark, str(at / "models" / "x.parquet"), "nothing")
    assert status()["models"] == ("degraded", {"loaded": "2", "failed": "1", "absent": "0", "failed_files": "x.parquet"})
    whole = next((at / "models").glob("part*"))
    cut = whole.read_bytes()[:-20]
    for name in list((at / "models").glob(".*crc")):
        name.unlink()  # checksums of the local file system would hide what is tested
    whole.write_bytes(cut)
    next((at / "registry").glob("part*.parquet")).unlink()
    for part in (at / "vocabulary").glob("part*.parquet"):
        part.unlink()
    broken = probe_files(spark, str(at / "models"), "goal").filter("error IS NOT NULL").count()
    assert broken == 2
    seen = status()
    assert seen["models"][0] == "error" and seen["vectorizer"][0] == "error" and seen["registry"][0] == "warning"
