"""Readers: requests, dictionaries, training files, stored models."""

import json

import pytest
from pyspark.sql import functions as F

from gapscore import files, schemas
from gapscore.operators.linear import pack_models, unpack_models
from gapscore.operators.split import training_counts, usable_items
from gapscore.sources import dictionaries, models, requests, training


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_request_bodies(spark, tmp_path):
    bodies = [
        '{"student_id": "a", "goal": "g", "resume_text": "t", "extra": 1}',
        '{"student_id": "b", "goal": "g"}',
        '{"student_id": 3, "goal": null, "resume_text": ["x"]}',
        '{"student_id": "d", ',
    ]
    path = tmp_path / "bodies.json"
    path.write_text("\n".join(bodies))
    checked = requests.read_request_bodies(spark, str(path))
    assert rows(requests.accepted(checked)) == [("a", "g", "t")]
    details = {tuple(row.details) for row in requests.rejected(checked).collect()}
    assert details == {
        ("body.resume_text: Field required",),
        (
            "body.student_id: Input should be a valid string",
            "body.goal: Input should be a valid string",
            "body.resume_text: Input should be a valid string",
        ),
        ("body: JSON decode error",),
    }


def test_typed_requests(spark, tmp_path):
    table = spark.createDataFrame([("a", "g", "t"), ("b", None, None)], schemas.REQUEST)
    table.write.parquet(str(tmp_path / "requests"))
    checked = requests.check_fields(requests.read_requests(spark, str(tmp_path / "requests")))
    assert rows(requests.accepted(checked)) == [("a", "g", "t")]
    assert requests.rejected(checked).first().details == ["body.goal: Field required", "body.resume_text: Field required"]


def test_goals_file(spark, tmp_path):
    path = tmp_path / "wanted.json"
    path.write_text(json.dumps({"A": ["x", "y"], "B": "broken", "C": []}, indent=2))
    parsed = dictionaries.read_goals(spark, str(path))
    assert set(rows(dictionaries.goal_skills(parsed))) == {("A", 0, "x"), ("A", 1, "y"), ("C", None, None)}
    sizes = {row.goal: (row.skills, row.malformed) for row in dictionaries.goal_sizes(parsed).collect()}
    assert sizes == {"A": (2, False), "B": (None, True), "C": (0, False)}


def test_repeated_keys_keep_their_last_value(spark, tmp_path):
    path = tmp_path / "twice.json"
    path.write_text('{"A": ["x"], "B": ["y"], "A": ["z", "w"]}')
    assert rows(dictionaries.goal_skills(dictionaries.read_goals(spark, str(path)))) == [("A", 0, "z"), ("A", 1, "w"), ("B", 0, "y")]
    rules = dictionaries.read_synonyms(spark, str(path)).orderBy("rule_no").collect()
    assert [(r.canonical, r.synonym) for r in rules] == [("A", "z"), ("A", "w"), ("B", "y")]


def test_mistyped_json_requests_are_rejected(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('{"student_id": "a", "goal": "g", "resume_text": "t"}\n{"student_id": 12345, "goal": "g", "resume_text": "t"}')
    read = requests.read_requests(spark, str(path), fmt="json")
    assert rows(requests.usable(read).select("student_id")) == [("a",)]
    assert [r.details for r in requests.rejected(read).collect()] == [["body.student_id: Input should be a valid string"]]


@pytest.mark.parametrize("label, number", [("1", 1), ("1.0", 1), ("true", 1), ("false", 0), ("0.0", 0), ("x", None), ("", None)])
def test_labels(spark, label, number):
    df = spark.createDataFrame([("g", "t", label)], "goal STRING, resume_text STRING, label STRING")
    assert usable_items(df).first().label == number


def test_synonyms_keep_file_order(spark, tmp_path):
    path = tmp_path / "synonyms.json"
    path.write_text('{\n "Zed": ["z2", "z1"],\n "Abc": ["a"]}')
    read = dictionaries.read_synonyms(spark, str(path)).orderBy("rule_no")
    assert [(r.canonical, r.synonym) for r in read.collect()] == [("Zed", "z2"), ("Zed", "z1"), ("Abc", "a")]


def test_repeated_recommendation_keys(spark, tmp_path):
    path = tmp_path / "recommendations.json"
    path.write_text('{"S": {"path": "1", "course": "a"}, "T": {"path": "t"}, "S": {"path": "2", "course": "b"}}')
    read = dictionaries.read_recommendations(spark, str(path))
    assert read.count() == 3
    latest = dictionaries.last_wins(read, "skill", "seq").select("skill", "path", "course")
    assert rows(latest) == [("S", "2", "b"), ("T", "t", None)]


def test_large_dictionaries_stay_tables(spark, monkeypatch):
    monkeypatch.setattr(dictionaries, "MAX_DICTIONARY_ROWS", 2)
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "skill STRING")
    loaded = dictionaries.load_rules(spark.createDataFrame([], schemas.SYNONYMS), universe)
    assert isinstance(loaded, dictionaries.RuleTables) and loaded.skills.count() == 3
    assert isinstance(dictionaries.load_rules(spark.createDataFrame([], schemas.SYNONYMS), universe.limit(2)), dictionaries.SkillRules)


def test_training_arrays_and_a_broken_file(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)

    items = [{"resume_text": "a", "label": 1}, {"resume_text": "b"}, {"label": "0"}, {"resume_text": "c", "label": "0"}]
    write("training_data engineer.json", json.dumps(items, indent=1))
    write("training_empty.json", "[]")
    write("training_bad.json", '[{"resume_text": "x", ')
    write("other.json", "[]")
    read = training.read_training(spark, f"{tmp_path}/training_*.json")
    usable = usable_items(training.readable(read))
    assert rows(usable.select("goal", "resume_text", "label")) == [("data engineer", "a", 1), ("data engineer", "c", 0)]
    assert rows(training_counts(usable)) == [("data engineer", 2, 1, 1)]
    assert [(r.goal, r.records) for r in training.quarantined(read).collect()] == [("bad", 1)]
    assert {r.goal for r in read.select("goal").distinct().collect()} == {"data engineer", "empty", "bad"}


def test_training_lines(spark, tmp_path):
    folder = tmp_path / "training_x.json"
    folder.mkdir()
    (folder / "part-0").write_text('{"resume_text": "a", "label": 1}\n{"resume_text": \n\n')
    (folder / "part-1").write_text('{"resume_text": "b", "label": 0}\n')
    read = training.read_training(spark, str(folder), one_array_per_file=False)
    assert rows(training.readable(read)) == [("x", "a", "1"), ("x", "b", "0")]
    assert [r.records for r in training.quarantined(read).collect()] == [1]


def test_stored_models(spark, tmp_path):
    folder = str(tmp_path / "models")
    assert models.load_models(spark, folder) is None
    vocabulary = spark.createDataFrame([("b", 1, 3, 2, 1.5), ("a", 0, 4, 2, 1.25)], schemas.VOCABULARY)
    table = spark.createDataFrame([("g", 0.5, [1.0, -2.0])], schemas.GOAL_MODELS)
    registry = spark.createDataFrame([("g", "g_model.pkl", 0.9, 30, 10, 20, 2)], schemas.REGISTRY)
    models.save_models(folder, vocabulary, ["the"], table, registry)
    loaded = models.load_models(spark, folder)
    assert loaded.vocabulary.terms == ("a", "b") and loaded.vocabulary.idf == (1.25, 1.5)
    assert loaded.vocabulary.stop_words == ("the",)
    assert loaded.table.collect() == table.collect()
    assert models.read_table(spark, folder, "registry").collect() == registry.collect()


def _set(spark, coefficient, samples):
    vocabulary = spark.createDataFrame([("a", 0, 4, 2, 1.0)], schemas.VOCABULARY)
    table = spark.createDataFrame([("g", 0.0, [coefficient])], schemas.GOAL_MODELS)
    return vocabulary, [], table, spark.createDataFrame([("g", samples)], "goal STRING, samples INT")


def test_versions_of_models(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "models")
    first = models.save_models(folder, *_set(spark, 1.0, 10))
    held = models.load_models(spark, folder)  # a reader that started before the next save
    second = models.save_models(folder, *_set(spark, 2.0, 20))
    assert held.table.first().coefficients == [1.0]
    assert models.load_models(spark, folder).table.first().coefficients == [2.0]
    assert models.load_models(spark, folder, first).table.first().coefficients == [1.0]
    assert models.stored_versions(spark, folder) == [first, second] and models.current_version(spark, folder) == second

    broken = spark.range(1).select(F.lit("g").alias("goal"), F.raise_error(F.lit("lost")).cast("int").alias("samples"))
    with pytest.raises(Exception, match="lost"):
        models.save_models(folder, *_set(spark, 3.0, 30)[:3], broken)
    assert models.current_version(spark, folder) == second
    assert models.load_models(spark, folder).table.first().coefficients == [2.0]

    models.use_version(spark, folder, first)
    assert models.read_table(spark, folder, "registry").first().samples == 10
    with pytest.raises(ValueError, match="no version"):
        models.use_version(spark, folder, "none")
    left = models.stored_versions(spark, folder)[-1]
    assert models.drop_versions(spark, folder, keep=1) == [second]
    assert models.stored_versions(spark, folder) == [first, left] and models.load_models(spark, folder) is not None


def test_small_files_are_put_whole(spark, tmp_path):
    path = str(tmp_path / "x" / "pointer")
    assert files.read_text(spark, path) is None
    assert files.put_text(spark, path, "Önë") and files.read_text(spark, path) == "Önë"
    assert not files.put_text(spark, path, "two") and files.read_text(spark, path) == "Önë"
    assert files.put_text(spark, path, "two", replace=True) and files.read_text(spark, path) == "two"
    assert [name for name, _ in files.children(spark, str(tmp_path / "x")) if not name.startswith(".")] == ["pointer"]
    assert list(files.children(spark, str(tmp_path / "nothing"))) == []


def test_registry_file(spark, tmp_path):
    metrics = {"accuracy": 0.5, "samples": 30, "positive_samples": 10, "negative_samples": 20, "feature_count": 7}
    content = {"vectorizer": "v.pkl", "models": {"a": "a_model.pkl", "b": "b_model.pkl"}, "metrics": {"a": metrics}}
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(content))
    read = models.read_registry(spark, str(path))
    assert {tuple(r) for r in read.collect()} == {
        ("a", "a_model.pkl", 0.5, 30, 10, 20, 7),
        ("b", "b_model.pkl", None, None, None, None, None),
    }


def test_packing_models(spark):
    coefficients = spark.createDataFrame([("g", 2, 0.5), ("h", 0, 1.0)], schemas.COEFFICIENTS)
    intercepts = spark.createDataFrame([("g", 1.0), ("h", 2.0), ("k", 3.0)], schemas.INTERCEPTS)
    packed = pack_models(coefficients, intercepts, 3)
    assert {r.goal: r.coefficients for r in packed.collect()} == {
        "g": [0.0, 0.0, 0.5],
        "h": [1.0, 0.0, 0.0],
        "k": [0.0, 0.0, 0.0],
    }
    back, heads = unpack_models(packed)
    assert back.filter("coef <> 0").count() == 2 and heads.count() == 3
