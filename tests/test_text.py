"""Text expressions against their Python counterparts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapscore.functions import text as fn

SAMPLES = [
    None,
    "",
    "  \t plain \n",
    "  wide　 ",
    "\x1c\x1fcontrol\x85",
    "!@#$%^&*()",
    "été à 3 h",
    "éèà",
    "日本語",
    "C++ and C# and .NET",
    "a_b 1st x2 café naïve foo-bar",
    "don't STOP",
]


def _column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING")


def _apply(spark, values, expression):
    rows = _column(spark, values).select("i", expression(F.col("t")).alias("o")).collect()
    return [row.o for row in sorted(rows, key=lambda row: row.i)]


def test_clean_strips_like_python(spark):
    assert _apply(spark, SAMPLES, fn.clean) == [(s or "").strip() for s in SAMPLES]


def test_blank_means_no_ascii_letter_or_digit(spark):
    def blank(s):
        return not re.sub(r"[^a-zA-Z0-9\s]", "", (s or "").strip()).strip()

    assert _apply(spark, SAMPLES, lambda t: fn.is_blank(fn.clean(t))) == [blank(s) for s in SAMPLES]


def _python_tokens(text):
    return re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*\b", text.lower())


def test_tokens_like_python(spark):
    texts = [s for s in SAMPLES if s is not None]
    assert _apply(spark, texts, fn.tokens) == [_python_tokens(s) for s in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aZ9_é² -.'\n", max_size=20), min_size=1, max_size=30))
def test_tokens_on_random_texts(spark, texts):
    assert _apply(spark, texts, fn.tokens) == [_python_tokens(s) for s in texts]


def test_tokens_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", fn.tokens(F.col("text")).alias("t"))
    for row in docs.collect():
        assert row.t == _python_tokens(row.text)


def test_path_steps(spark):
    paths = ["1. A → 2. B", " → one →  → two ", "", "single"]
    assert _apply(spark, paths, fn.path_steps) == [["1. A", "2. B"], ["one", "two"], [], ["single"]]


def test_goal_names(spark):
    assert _apply(spark, ["Data Engineer", "X"], fn.goal_key) == ["data_engineer", "x"]
    stems = ["data_engineer", "AIML_x", "src3/en", "3d-art_2x", "don't__stop", "é_à", ""]
    files = [f"{stem}_model.pkl" for stem in stems]
    assert _apply(spark, files, fn.display_name) == [stem.replace("_", " ").title() for stem in stems]


def test_preview(spark):
    assert _apply(spark, ["x" * 100, "short"], fn.preview) == ["x" * 60, "short"]
