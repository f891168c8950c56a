"""Rewriting and extraction against a plain regular-expression cascade."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapscore.operators import extract, extract_joined
from gapscore.operators.audit import dictionary_survivors
from gapscore.operators.extract import canonicalise, extract_skills
from gapscore.sources.dictionaries import RuleTables, SkillRules, load_rules
from workload import fixtures as fx


def rewrite(text, rules):
    text = text.lower()
    for synonym, canonical in rules:
        text = re.sub(r"\b" + re.escape(synonym.lower()) + r"\b", lambda _: canonical.lower(), text)
    return text


def find(text, rules, skills):
    text = rewrite(text, rules)
    return {s for s in skills if re.search(r"\b" + re.escape(s.lower()) + r"\b", text)}


def tables(spark, rules, skills):
    numbered = [(i, canonical, synonym) for i, (synonym, canonical) in enumerate(rules)]
    return RuleTables(
        spark.createDataFrame(numbered, "rule_no INT, canonical STRING, synonym STRING"),
        spark.createDataFrame([(s,) for s in dict.fromkeys(skills)], "skill STRING"),
    )


def check(spark, texts, rules, skills, joined=False):
    dictionary = tables(spark, rules, skills) if joined else SkillRules(tuple(rules), tuple(skills))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    df = canonicalise(df, "t", dictionary).transform(extract_skills, "t", dictionary)
    for row in df.collect():
        assert row.canonical_text == rewrite(texts[row.i], rules), repr(texts[row.i])
        assert set(row.found_skills) == find(texts[row.i], rules, skills), repr(texts[row.i])
        assert len(row.found_skills) == len(set(row.found_skills))


@pytest.fixture(params=["native", "python"])
def path(request, monkeypatch):
    """Both ways of running the rules."""
    monkeypatch.setattr(extract, "NATIVE_TERMS", 10_000 if request.param == "native" else -1)
    return request.param


RULES = [
    ("Boat Building", "Keel Laying"),
    ("BB", "Boat Building"),
    ("OAR", "OAR Locks"),
    ("KN", "Knotwork"),
    ("Keel Laying", "Ribs"),
    ("Kn", "Never"),
]
SKILLS = ["Boat Building", "Ribs", "OAR Locks", "Knotwork", "Knot", "R", "Go", "Keel Laying"]


def test_cascade_order_and_boundaries(spark, path):
    texts = [
        "BB and boat building",
        "oar, OARsome, oar locks; OAR",
        "kn KN.kn node_kn kn2 (kn)",
        "knot knotwork go going R&D",
        "boat  building boat\nbuilding boat building",
        "BB bb BB",
        "",
        "été bb été",
    ]
    check(spark, texts, RULES, SKILLS)


def test_order_of_rules_matters(spark, path):
    check(spark, ["bb boat building keel laying"], RULES[::-1], SKILLS)


def test_edges_that_are_not_words(spark, path):
    rules = [("C++", "CPP"), (".NET", "dotnet"), ("c#", "csharp"), ("++", "plus"), ("asp", ".net"), ("x", "c++")]
    skills = ["C++", ".NET", "C#", "cpp", "dotnet", "aspdotnet", "csharp", "plus", "++", "asp"]
    texts = [
        "c++ c++x c++c++x",
        ".net asp.net x.net.net",
        "c# c#m",
        "a++b a ++ b",
        "c++x c++asp x.net",
        "asp.net asp .net",
    ]
    check(spark, texts, rules, skills)


@pytest.mark.parametrize("joined", [True, False])
def test_texts_that_contain_the_marks(spark, path, joined):
    texts = ["a\u0001bb\u0001b", "\u0001.net", "\u0001bb\u0001", "x\u0001 \u0001bb", "boat\u0001 \u0001building", "x\u0002bb", "\u0002\u0003bb\u0002\u0001\u0004"]
    check(spark, texts, RULES, (*SKILLS, ".NET"), joined)


def test_joined_cascade_with_punctuation(spark):
    """Rules that wake each other, join words, and stand outside of words."""
    rules = [("C++", "CPP"), (".com", "dotcom"), ("exampledotcom", "boat"), ("-", " dash "), ("boat", "ship $1 \\\\x"), ("ship", "yacht"), ("dash", "C++")]
    skills = ["yacht", "dotcom", "CPP", "C++", "$", "b++", "dash", "x", "exampledotcom"]
    texts = ["example.com", "C++b and c++", "a-b - c", "boat", "ship", "xC++y.com", "", "nothing here", "the-boat.com", ".com", "C++ C++d"]
    check(spark, texts, rules, skills, joined=True)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.text(alphabet="abé+. _", max_size=24), min_size=1, max_size=12),
    st.lists(
        st.tuples(
            st.text(alphabet="abé+.", min_size=1, max_size=3), st.text(alphabet="abé+. ", min_size=1, max_size=4)
        ),
        min_size=1,
        max_size=6,
    ),
    st.lists(st.text(alphabet="abé+.", min_size=1, max_size=3), min_size=1, max_size=6, unique=True),
)
def test_random_dictionaries_joined(spark, texts, rules, skills):
    check(spark, texts, rules, skills, joined=True)


def test_joined_forms_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, ["knot", "kn"], "x"), (1, ["knot", "kn"], "x"), (2, None, "y")], "i INT, t ARRAY<STRING>, key STRING")
    dictionary = tables(spark, [("kn", "knotwork")], ["knotwork", "knot"])
    found = extract_skills(df, "t", dictionary)
    assert found.columns == ["i", "t", "key", "found_skills"]
    assert sorted((r.i, r.found_skills) for r in found.collect()) == [(1, ["knot", "knotwork"])] * 2 + [(2, [])]
    texts = spark.createDataFrame([(1, "KN"), (2, None)], "i INT, t STRING")
    assert sorted((r.i, r.canonical_text) for r in canonicalise(texts, "t", dictionary).collect()) == [(1, "knotwork"), (2, None)]
    found = extract_skills(texts, "t", dictionary, case_sensitive=True)
    assert sorted((r.i, r.found_skills) for r in found.collect()) == [(1, []), (2, [])]
    with pytest.raises(Exception, match="not usable as a dictionary term"):
        extract_skills(texts, "t", tables(spark, [("\u0003", "x")], ["x"])).collect()


@settings(max_examples=25, deadline=None)
@given(
    st.lists(st.text(alphabet="abé+. _", max_size=24), min_size=1, max_size=12),
    st.lists(
        st.tuples(
            st.text(alphabet="abé+.", min_size=1, max_size=3), st.text(alphabet="abé+. ", min_size=1, max_size=4)
        ),
        max_size=6,
    ),
    st.lists(st.text(alphabet="abé+.", min_size=1, max_size=3), min_size=1, max_size=6, unique=True),
)
def test_random_dictionaries(spark, texts, rules, skills):
    check(spark, texts, rules, skills)


def test_all_documents_both_ways(spark, sf, path):
    rules = [(synonym, canonical) for canonical, synonym in fx.SYNONYMS]
    skills = sorted({s for listed in fx.GOALS.values() for s in listed})
    texts = [row.text for row in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    check(spark, texts, rules, skills)


def test_large_dictionary(spark, sf):
    """Two thousand rules and skills that come from the documents."""
    texts = [row.text for row in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    words = sorted({w for t in texts for w in re.findall(r"\w+", t.lower())})[:2000]
    skills = words[::8]
    rules = [(w, skills[(i * 7) % len(skills)] + (" x" if i % 5 == 0 else "")) for i, w in enumerate(words) if i % 8]
    check(spark, texts, rules, skills)


def test_case_sensitive(spark, path):
    dictionary = SkillRules((("BB", "Boat Building"),), ("Boat Building", "Go"))
    df = spark.createDataFrame([("BB go",), ("bb Go",)], "t STRING")
    found = [row.found_skills for row in extract_skills(df, "t", dictionary, case_sensitive=True).collect()]
    assert found == [["Boat Building"], ["Go"]]


def test_list_valued_text(spark, path):
    dictionary = SkillRules((("kn", "knotwork"),), ("knotwork", "knot"))
    df = spark.createDataFrame([(["knot", "kn"],)], "t ARRAY<STRING>")
    assert set(extract_skills(df, "t", dictionary).first().found_skills) == {"knot", "knotwork"}


def test_no_text_has_no_skills(spark, path):
    df = spark.createDataFrame([(None,)], "t STRING")
    assert extract_skills(df, "t", SkillRules((("a", "b"),), ("b",))).first().found_skills == []


def test_survivors(spark):
    universe = spark.createDataFrame([(s,) for s in ("Ropes", "Cordage", "Sail", "C++")], "skill STRING")
    synonyms = spark.createDataFrame([(1, "Cordage", "Ropes")], "rule_no INT, canonical STRING, synonym STRING")
    rows = dictionary_survivors(universe, load_rules(synonyms, universe)).collect()
    assert {row.skill: row.survives for row in rows} == {
        "Ropes": False,
        "Cordage": True,
        "Sail": True,
        "C++": False,
    }


def test_terms_must_not_contain_marks(spark):
    universe = spark.createDataFrame([("a\u0001b",)], "skill STRING")
    synonyms = spark.createDataFrame([], "rule_no INT, canonical STRING, synonym STRING")
    with pytest.raises(ValueError):
        load_rules(synonyms, universe)


def test_filter_behind_extraction_does_not_repeat_it(spark, path):
    dictionary = SkillRules((("kn", "knotwork"),), ("knotwork", "knot"))
    df = spark.range(3).select(F.concat(F.lit("kn "), F.col("id").cast("string")).alias("t"))
    found = extract_skills(df, "t", dictionary)
    plan = found.filter(F.size("found_skills") > 0)._jdf.queryExecution().executedPlan().toString()
    marks = plan.count("regexp_replace") if path == "native" else plan.count("ArrowEvalPython [")
    assert marks <= 2


def test_chains_of_words_joined(spark):
    """Ways from word to word: claimed twice, back to an earlier rule, through a word that a phrase begins with."""
    rules = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "f"), ("f", "f"), ("f", "g"), ("b", "never")]
    skills = ["g", "G", "a", "never", "é", "z"]
    texts = ["a", "b c", "c x a", "d", "e-f", "f", "é a É", "", "never z", "x\u0001a", "a_ b_ a"]
    check(spark, texts, rules, skills, joined=True)
    check(spark, texts, [*rules, ("z e", "a"), ("g z", "b")], [*skills, "x g", "e-f", "-"], joined=True)
    check(spark, ["z d", "z a", "d z", "x a", "z"], [*rules[:5], ("z e", "q"), *rules[5:]], [*skills, "q", "x g"], joined=True)


def test_rules_between_words_are_not_run_one_by_one(spark, monkeypatch):
    """Texts whose dictionary maps words to words look words up; the cascade costs its rules times the text."""

    def never(*_):
        raise AssertionError("rewritten rule by rule")

    monkeypatch.setattr(extract_joined, "_rewritten", never)
    words = [f"w{i}" for i in range(200)]
    check(spark, [" ".join(words), "w7", ""], [(w, f"s{i // 8}") for i, w in enumerate(words)], ["s0", "s3", "w1"], joined=True)


def test_joined_texts_are_written_once_and_met_in_portions(spark, monkeypatch):
    rows = [(i, f"erat thes {i % 7} word{i % 5} of the thing") for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(6)
    dictionary = tables(spark, [("thes", "thing"), ("erat", "erin"), ("of the", "of that")], ["thing", "erin", "word3", "of that"])
    run = lambda: sorted(map(tuple, extract_skills(docs, "text", dictionary).drop("text").collect()), key=str)
    want = run()
    assert {s for _, found in want for s in found} == {"thing", "erin", "word3", "of that"}
    monkeypatch.setattr(extract_joined, "PORTION_BYTES", 200)
    assert run() == want
    stored, texts = extract_joined._numbered(docs, F.col("text"), False)
    assert spark.read.parquet(*stored.inputFiles()).columns == ["id", "text", extract_joined._ROW]  # no second copy
    portions = extract_joined._portions(texts)
    assert len(portions) > 2 and sum(p.count() for p in portions) == texts.count() == 61
    assert len(extract_joined._portions(texts.limit(0))) == 1


def test_shuffle_files_end_with_the_table(spark):
    from gapscore.storage import materialise

    def shuffle_files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).endswith(".data")}

    counts = spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffle_files()
    stored = materialise(counts, "counts")
    assert not shuffle_files() - before
    assert stored.count() == 10
