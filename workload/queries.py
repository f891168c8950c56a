"""The queries by name; each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapscore import files
from gapscore.functions import text as fn
from gapscore.operators import audit, evaluate, extensions, gap, goals, linear, linear_joined, score, split, tfidf, train
from gapscore.operators.extract import canonicalise, extract_skills
from gapscore.plans.audit import audit as audit_plan
from gapscore.plans.audit import audit_files
from gapscore.plans.scoring import rejects, respond, write_responses_with_usage
from gapscore.sources import dictionaries, models, requests, training
from gapscore.sources.dictionaries import RuleTables
from gapscore.sources.history import History, keep_history
from gapscore.sources.vocabulary_state import VocabularyState
from gapscore.config import Config
from gapscore.storage import local_table, materialise, new_path
from gapscore.streaming import history_stream, latest_counts, requests_per_minute, respond_stream, respond_stream_with, write_counts
from workload import fixtures as fx


def _rounded(value: Column | str) -> Column:
    return F.round(value, 6)


def _joined(column: str) -> Column:
    return F.array_join(column, "|")


def _path(column: str) -> Column:
    items = F.transform(column, lambda item: F.concat(F.array_join(item.path, ">"), F.lit("@"), item.course))
    return F.array_join(items, "|")


# Requests


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies made from documents, some without a goal, mistyped or cut off."""
    docs = fx.documents(spark, sf, "doc_id", "lang", "source", "text")
    goal = F.when(F.col("lang") != "es", F.col("lang")).alias("goal")
    text = F.col("text").alias("resume_text")
    named = F.to_json(F.struct(F.concat(F.lit("stu_"), F.col("doc_id")).alias("student_id"), goal, text))
    numbered = F.to_json(F.struct(F.col("doc_id").alias("student_id"), goal, text))
    body = (
        F.when(F.col("source") == "src0", numbered)
        .when((F.col("source") == "src1") & (F.col("lang") == "de"), F.concat(F.lit("{"), named))
        .otherwise(named)
    )
    return requests.parse_bodies(docs.select(body.alias("value")))


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Every rejected request with what is wrong with it."""
    return rejects(_bodies(spark, sf)).select("student_id", "goal", _joined("details").alias("details"))


def request_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The other requests: what the same bodies are scored to."""
    responses = respond(_bodies(spark, sf), fx.dimensions(spark))
    return responses.select("student_id", "goal", _rounded("score").alias("score"))


def _thinned(spark: SparkSession, sf: str) -> DataFrame:
    """Spanish requests lose all ASCII letters and digits, German ones keep only white space."""
    text, goal = F.col("resume_text"), F.col("goal")
    thinned = (
        F.when(goal == "es", F.regexp_replace(text, "[a-zA-Z0-9]", ""))
        .when(goal == "de", F.regexp_replace(text, r"[^ \n]", ""))
        .otherwise(text)
    )
    return fx.requests(spark, sf).withColumn("resume_text", thinned)


def blank_gate(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = fn.clean(F.col("resume_text"))
    return _thinned(spark, sf).select(
        "student_id", F.length(cleaned).alias("length"), fn.is_blank(cleaned).alias("blank")
    )


def goal_resolution(spark: SparkSession, sf: str) -> DataFrame:
    dims = fx.dimensions(spark)
    resolved = goals.resolve_goal(fx.requests(spark, sf).select("student_id", "goal"), dims.config)
    looked_up = goals.attach_requirements(resolved, dims.requirements)
    return looked_up.groupBy("goal", "goal_used", "goal_was_defaulted", "skills_of").agg(
        F.count("*").alias("requests"), F.max(F.size("required")).alias("skills")
    )


def goal_file(spark: SparkSession, sf: str) -> DataFrame:
    """A goals file with an empty list, a repeated key and no list for the default goal."""
    parsed = dictionaries.parse_goals(local_table(spark, [(fx.GOALS_FILE,)], "value STRING"))
    dims = score.load_dimensions(
        Config.from_dict(fx.GOALS_FILE_CONFIG),
        dictionaries.goal_skills(parsed),
        fx.synonyms(spark).limit(0),
        fx.recommendations(spark),
    )
    scored = score.score(fx.requests(spark, sf), dims)
    return scored.select(
        "student_id",
        "goal_used",
        _rounded("score").alias("score"),
        _joined("matched_skills").alias("matched_skills"),
        _joined("missing_skills").alias("missing_skills"),
    )


# Dictionaries


def goal_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON goal per source listing its languages; one source has a string instead."""
    docs = fx.documents(spark, sf, "source", "lang")
    listed = F.array_sort(F.collect_set("lang"))  # as many as there are languages
    per_source = docs.groupBy("source").agg(listed.alias("langs"))
    good = F.to_json(F.create_map("source", "langs"))
    bad = F.to_json(F.create_map(F.col("source"), F.array_join("langs", ",")))
    documents = per_source.select(F.when(F.col("source") == "src3", bad).otherwise(good).alias("value"))
    return dictionaries.goal_sizes(dictionaries.parse_goals(documents))


def synonym_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON dictionary per source, whose languages are its synonyms in order."""
    docs = fx.documents(spark, sf, "source", "lang")
    listed = F.array_sort(F.collect_set("lang"))  # as many as there are languages
    per_source = docs.groupBy("source").agg(listed.alias("langs"))
    return dictionaries.parse_synonyms(per_source.select(F.to_json(F.create_map("source", "langs")).alias("value")))


def skill_universe(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the documents as skills of their language."""
    docs = fx.documents(spark, sf, "lang", "text")
    words = F.explode(F.array_distinct(fn.tokens(F.col("text"))))
    return goals.skill_universe(docs.select(F.col("lang").alias("goal"), words.alias("skill")))


def recommendations_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Every document recommends itself for its source and language; lines are the steps."""
    docs = fx.documents(spark, sf, "doc_id", "source", "lang", "text")
    table = docs.select(
        F.col("doc_id").alias("seq"),
        F.concat_ws("/", "source", "lang").alias("skill"),
        F.regexp_replace("text", "\n", fn.PATH_SEPARATOR).alias("path"),
        F.concat(F.lit("course "), F.col("doc_id")).alias("course"),
    )
    items = goals.path_items(table)
    return items.select("skill", F.size("path").alias("steps"), _joined("path").alias("path"), "course")


def dictionary_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The rewrite rules against all words of the sample texts as skills."""
    samples = fx.table(spark, sf, "benchmark", "text")
    universe = samples.select(F.explode(fn.tokens(F.col("text"))).alias("skill")).distinct()
    rules = dictionaries.load_rules(fx.synonyms(spark), universe)
    return audit.dictionary_survivors(universe, rules)


# Extraction and gap


def canonicalise_cascade(spark: SparkSession, sf: str) -> DataFrame:
    texts = fx.requests(spark, sf).select("student_id", "resume_text")
    done = canonicalise(texts, "resume_text", fx.dimensions(spark).rules)
    return done.select(
        "student_id",
        (F.col("canonical_text") != F.lower("resume_text")).alias("changed"),
        F.md5("canonical_text").alias("canonical_md5"),
    )


def extract_skills_rows(spark: SparkSession, sf: str) -> DataFrame:
    texts = fx.requests(spark, sf).select("student_id", "resume_text")
    found = extract_skills(texts, "resume_text", fx.dimensions(spark).rules)
    return gap.skill_rows(found, "found_skills", ["student_id"]).drop("pos")


def extract_from_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Texts given as lists of lines."""
    lines = fx.requests(spark, sf).select("student_id", F.split("resume_text", "\n").alias("resume_text"))
    found = extract_skills(lines, "resume_text", fx.dimensions(spark).rules)
    return found.select("student_id", _joined(F.array_sort("found_skills")).alias("skills"))


def extract_few_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary small enough for built-in expressions."""
    texts = fx.requests(spark, sf).select("student_id", "resume_text")
    found = extract_skills(texts, "resume_text", fx.few_rules())
    return gap.skill_rows(found, "found_skills", ["student_id"]).drop("pos")


def extract_edge_terms(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages", "page_id", "url", "html")
    texts = pages.select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    found = extract_skills(texts, "text", fx.edge_rules())
    return gap.skill_rows(found, "found_skills", ["page_id"]).drop("pos")


def _words_as_dictionary(samples: DataFrame) -> RuleTables:
    """All words of some texts as a dictionary: by alphabet, each eighth is a skill and the next seven its synonyms."""
    words = samples.select(F.explode(fn.tokens(F.col("text"))).alias("w")).distinct()
    # Numbered by ranges: within each, and from the number of words in those before. One row a range for the offsets.
    ranged = materialise(words.repartitionByRange("w").select("w", F.spark_partition_id().alias("part")), "words")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("w")) - 1
    numbered = ranged.withColumn("place", place).join(offsets, "part").select("w", (F.col("offset") + F.col("place")).alias("n"))
    eighth = numbered.withColumn("entry", F.floor(F.col("n") / 8)).withColumn("place", F.col("n") % 8)
    skills = eighth.filter("place = 0").select("entry", F.col("w").alias("canonical"))
    synonyms = eighth.filter("place > 0").join(skills, "entry")
    return RuleTables(
        synonyms.select(F.col("n").alias("rule_no"), F.col("w").alias("synonym"), "canonical"),
        skills.select(F.col("canonical").alias("skill")),
    )


def extract_large_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary of thousands of terms, held by the workers."""
    texts = fx.requests(spark, sf).select("student_id", "resume_text")
    tables = _words_as_dictionary(fx.table(spark, sf, "benchmark", "text"))
    found = extract_skills(texts, "resume_text", dictionaries.load_rules(tables.rules, tables.skills))
    return gap.skill_rows(found, "found_skills", []).groupBy("skill").agg(F.count("*").alias("documents"))


def extract_joined_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary that grows with the documents, all of whose words are its terms; it stays a table."""
    texts = fx.requests(spark, sf).select("student_id", "resume_text")
    found = extract_skills(texts, "resume_text", _words_as_dictionary(fx.documents(spark, sf, "text")))
    return gap.skill_rows(found, "found_skills", []).groupBy("skill").agg(F.count("*").alias("documents"))


def matched_skills(spark: SparkSession, sf: str) -> DataFrame:
    prepared = score.prepare(fx.requests(spark, sf), fx.dimensions(spark))
    return gap.skill_rows(prepared, "matched_skills", ["student_id"])


def missing_skills(spark: SparkSession, sf: str) -> DataFrame:
    prepared = score.prepare(fx.requests(spark, sf), fx.dimensions(spark))
    return gap.skill_rows(prepared, "missing_skills", ["student_id"])


# Scores


def _scored(spark: SparkSession, sf: str, **options) -> DataFrame:
    return score.score(fx.requests(spark, sf), fx.dimensions(spark), **options)


def flagship_goal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    per_goal = score.usage(_scored(spark, sf, zero_without_match=True))
    return per_goal.select(
        "goal_used", "scored", *[_rounded(c).alias(c) for c in ("avg_score", "avg_matched", "avg_missing")]
    )


def coverage_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("student_id", "goal_used", _rounded("score").alias("score"))


def pass_flag(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    flag = score.passed(F.col("score"), fx.config()).alias("passed")
    return scored.groupBy("goal_used", flag).agg(F.count("*").alias("requests"))


def learning_path(spark: SparkSession, sf: str) -> DataFrame:
    # The outer form keeps the optimiser from filtering on the array's size first.
    rows = _scored(spark, sf).select("student_id", F.posexplode_outer("suggested_learning_path").alias("pos", "item"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "student_id", "pos", _joined("item.path").alias("path"), F.col("item.course").alias("course")
    )


def _response_row(responses: DataFrame) -> DataFrame:
    return responses.select(
        "student_id",
        "goal",
        "goal_used",
        "goal_was_defaulted",
        _rounded("score").alias("score"),
        _joined("matched_skills").alias("matched_skills"),
        _joined("missing_skills").alias("missing_skills"),
        _path("suggested_learning_path").alias("suggested_learning_path"),
    )


def score_response(spark: SparkSession, sf: str) -> DataFrame:
    return _response_row(respond(_thinned(spark, sf), fx.dimensions(spark)))


def score_with_models(spark: SparkSession, sf: str) -> DataFrame:
    """Goals with a model use it, the others fall back to coverage."""
    trained = fx.models(spark, sf)
    named = F.when(F.col("goal") == "quality", "en").otherwise(F.col("goal")).alias("goal")
    table = trained.table.select(named, "intercept", "coefficients")
    dims = fx.dimensions(spark)
    responses = respond(fx.requests(spark, sf), dims, linear.GoalModels(trained.vocabulary, table))
    return responses.select("student_id", "goal_used", _rounded("score").alias("score"))


# Terms and TF-IDF


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.documents(spark, sf, "doc_id", "text")
    words = docs.select("doc_id", tfidf.kept_tokens(F.col("text"), fx.STOP_WORDS).alias("words"))
    return tfidf.count_within(words, "words", ["doc_id"])


def terms_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    counts = tfidf.term_counts(fx.documents(spark, sf, "lang", "text"), "text", fx.STOP_WORDS, ["lang"])
    return counts.groupBy("lang", "term").agg(F.sum("tf").alias("tf"))


def vocabulary_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fx.vocabulary_table(spark, sf).select("term", "term_id", "corpus_tf", "df")


def vocabulary_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same vocabulary from three batches of documents, counted one after the other, one of them twice."""
    state = VocabularyState(spark, new_path(spark, "vocabulary-state"), fx.STOP_WORDS)
    docs = fx.documents(spark, sf, "doc_id", "text")
    for batch in (0, 1, 0, 2):
        state.add(docs.filter(F.col("doc_id") % 3 == batch), "text", f"batch-{batch}")
        if batch == 1:
            state.compact()
    return state.vocabulary(max_df=fx.MAX_DF).select("term", "term_id", "corpus_tf", "df")


def idf(spark: SparkSession, sf: str) -> DataFrame:
    return fx.vocabulary_table(spark, sf).select("term", _rounded("idf").alias("idf"))


def tfidf_l2(spark: SparkSession, sf: str) -> DataFrame:
    vocab = fx.vocabulary(spark, sf)
    rows = tfidf.tfidf_rows(fx.documents(spark, sf, "doc_id", "text"), "text", vocab, ["doc_id"])
    return rows.select("doc_id", "term_id", _rounded("weight").alias("weight"))


# Training


def training_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split.training_counts(fx.training_ids(spark, sf))


def training_gate(spark: SparkSession, sf: str) -> DataFrame:
    return fx.source_gate(spark, sf)


def _training_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(g, source, doc_id, line): items as JSON, with labels as whole numbers, decimals and booleans by language."""
    items = fx.labelled(spark, sf).select(
        "doc_id",
        "source",
        "lang",
        F.to_json(F.struct(F.col("text").alias("resume_text"))).alias("body"),
        F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (g, label)"),
    )
    label = (
        F.when(F.col("lang") == "de", F.col("label").cast("double").cast("string"))
        .when(F.col("lang") == "fr", (F.col("label") == 1).cast("string"))
        .otherwise(F.col("label").cast("string"))
    )
    line = F.concat(F.regexp_replace("body", r"\}$", ', "label": '), label, F.lit("}"))
    return items.select("g", "source", "doc_id", line.alias("line"))


#: Items of a JSON array, on average.
ARRAY_ITEMS = 1000


def training_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Items as JSON arrays of about ARRAY_ITEMS per source and goal; the arrays of one source are cut off."""
    folder = new_path(spark, "arrays")
    items = _training_lines(spark, sf)
    files = items.groupBy(F.col("g").alias("of_g"), F.col("source").alias("of_source")).agg(F.ceil(F.count("*") / ARRAY_ITEMS).alias("files"))
    same = (F.col("g") == F.col("of_g")) & F.col("source").eqNullSafe(F.col("of_source"))
    dealt = items.join(files, same).select(
        "g", "source", "line", F.pmod(F.xxhash64("doc_id"), F.col("files")).alias("file")
    )
    arrays = dealt.groupBy("g", "source", "file").agg(F.array_sort(F.collect_list("line")).alias("items"))
    body = F.concat(F.lit("["), F.array_join("items", ",\n"), F.when(F.col("source") == "src2", "").otherwise("]"))
    lines = materialise(arrays.select("g", body.alias("value")), "arrays", ["g"])
    paths = [f"{folder}/training_{goal}.json" for goal in ("quality", "toxic")]
    for goal, path in zip(("quality", "toxic"), paths):
        # One array a file.
        lines.filter(F.col("g") == goal).select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = training.read_training(spark, paths)
    return split.training_counts(split.usable_items(training.readable(read)))


def training_files(spark: SparkSession, sf: str) -> DataFrame:
    """Items written as one folder of JSON lines per goal, lines of one source broken, read back."""
    items = _training_lines(spark, sf)
    folder = new_path(spark, "training")
    line = F.col("line")
    broken = F.substring(line, 1, 12)
    lines = materialise(
        items.select("g", F.when(F.col("source") == "src2", broken).otherwise(line).alias("value")), "lines", ["g"]
    )
    paths = [f"{folder}/training_{goal}.json" for goal in ("quality", "toxic")]
    for goal, path in zip(("quality", "toxic"), paths):
        lines.filter(F.col("g") == goal).select("value").write.text(path)
    read = training.read_training(spark, paths, one_array_per_file=False)
    counts = split.training_counts(split.usable_items(training.readable(read)))
    bad = training.quarantined(read).groupBy("goal").agg(F.sum("records").alias("broken"))
    return counts.join(bad, "goal", "left").fillna(0, ["broken"])


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = split.class_weights(fx.training_ids(spark, sf))
    return weights.select("goal", "label", _rounded("weight").alias("weight"))


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(fx.training_ids(spark, sf), "doc_id").select("goal", "label", "doc_id", "is_test")


def train_lr_metrics(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.training(spark, sf).withColumnRenamed("doc_id", "item_id")
    trained = train.train(items, fx.vocabulary(spark, sf))
    return trained.registry.drop("accuracy").join(trained.metrics, "goal")


def trained_models_used(spark: SparkSession, sf: str) -> DataFrame:
    """Items in files named by goal keys, models fitted and stored under these; asked for by display names."""
    names = {"quality": "text_quality", "toxic": "toxic_text"}
    folder = new_path(spark, "keyed")
    lines = materialise(_training_lines(spark, sf), "keyed-lines", ["g"])
    for label, key in names.items():
        lines.filter(F.col("g") == label).select("line").write.text(f"{folder}/training_{key}.json")
    read = training.read_training(spark, [f"{folder}/training_{key}.json" for key in names.values()], False)
    items = materialise(split.usable_items(training.readable(read)), "keyed-items")
    vocab = materialise(fx.vocabulary_table(spark, sf), "vocabulary")
    loaded = tfidf.load_vocabulary(vocab, fx.STOP_WORDS)
    numbered = items.withColumn("n", F.monotonically_increasing_id())
    odds = F.round(F.log((F.sum("label") + 1) / (F.count("*") - F.sum("label") + 1)), 6)
    present = tfidf.tfidf_rows(numbered, "resume_text", loaded, ["n", "goal", "label"])
    coefficients = present.groupBy("goal", "term_id").agg(odds.alias("coef"))
    packed = linear.pack_models(coefficients, items.groupBy("goal").agg(odds.alias("intercept")), len(loaded.terms))
    stored = new_path(spark, "keyed-models")
    models.save_models(stored, vocab, fx.STOP_WORDS, packed, items.groupBy("goal").agg(F.count("*").alias("samples")))
    docs = fx.documents(spark, sf, "doc_id", "lang", "text")
    goal = F.when(F.col("lang") == "en", "Text Quality").when(F.col("lang") == "fr", "Toxic Text").otherwise(F.col("lang"))
    scored = linear.model_probability(docs.withColumn("goal", goal), models.load_models(spark, stored), "text", "goal")
    return scored.select("doc_id", "goal", _rounded("probability").alias("probability"))


def train_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The exact columns of a training run: what was counted, split off and measured."""
    items = fx.training(spark, sf).withColumnRenamed("doc_id", "item_id")
    trained = train.train(items, fx.vocabulary(spark, sf))
    tested = trained.metrics.select("goal", "tested")
    return trained.registry.drop("accuracy").join(tested, "goal")


def train_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each goal."""
    return train_summary(spark, sf).select("goal", "outcome")


def train_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A goal per language: trained, cross-validated or skipped, with the accuracy."""
    items = fx.labelled(spark, sf).select(
        F.col("lang").alias("goal"),
        F.col("doc_id").alias("item_id"),
        F.col("text").alias("resume_text"),
        F.col("quality").alias("label"),
    )
    trained = train.train(items, fx.vocabulary(spark, sf))
    fitted = trained.registry.select("goal", F.lit("trained").alias("outcome"), "accuracy")
    checked = trained.cross_validated.select(
        "goal", F.lit("cross-validated").alias("outcome"), F.col("mean_accuracy").alias("accuracy")
    )
    skipped = trained.skipped.select("goal", F.col("reason").alias("outcome"), F.lit(None).cast("double").alias("accuracy"))
    return fitted.unionByName(checked).unionByName(skipped)


# Linear scores and evaluation


def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    """English documents against one model, French ones against the other, the rest have none."""
    return _linear_scores(spark, sf, fx.models(spark, sf))


def stored_models(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores from models fitted now, stored and loaded again."""
    folder = new_path(spark, "stored")
    fx.save_fit(spark, sf, folder)
    return _linear_scores(spark, sf, models.load_models(spark, folder))


def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of models in a folder: what a reader of the first, of the current and of the set in use again sees."""
    folder = new_path(spark, "versions")
    vocab = local_table(spark, [("word", 0, 1, 1, 1.0)], "term STRING, term_id INT, corpus_tf BIGINT, df BIGINT, idf DOUBLE")
    items = fx.training_ids(spark, sf)
    stored = []
    for chosen in (F.col("goal") == "toxic", F.lit(True)):
        counted = items.filter(chosen).groupBy("goal").agg(F.count("*").alias("samples"), F.sum("label").alias("positive"))
        rate = (F.col("positive") / F.col("samples")).alias("intercept")
        table = counted.select("goal", rate, F.array(F.lit(0.0)).alias("coefficients"))
        stored.append(models.save_models(folder, vocab, [], table, counted.select("goal", "samples")))
    seen = {"first": stored[0], "current": models.current_version(spark, folder)}
    models.use_version(spark, folder, stored[0])
    seen["back"] = models.current_version(spark, folder)

    def of(name: str) -> DataFrame:
        registry = models.read_table(spark, folder, "registry", seen[name])
        return registry.join(models.load_models(spark, folder, seen[name]).table, "goal").select(
            F.lit(name).alias("reader"), "goal", "samples", _rounded("intercept").alias("rate")
        )

    return of("first").unionByName(of("current")).unionByName(of("back"))


def _linear_scores(spark: SparkSession, sf: str, trained: linear.GoalModels | linear_joined.JoinedModels) -> DataFrame:
    docs = fx.documents(spark, sf, "doc_id", "lang", "text")
    goal = F.when(F.col("lang") == "en", "quality").when(F.col("lang") == "fr", "toxic").otherwise(F.col("lang"))
    scored = linear_joined.model_probability(docs.withColumn("goal", goal), trained, "text", "goal")
    return scored.select("doc_id", "goal", _rounded("probability").alias("probability"))


def linear_score_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores from tables of terms and coefficients, as of a vocabulary too large for the workers."""
    folder = fx.fitted(spark, sf)
    vocab, table = (models.read_table(spark, folder, name) for name in ("vocabulary", "models"))
    joined = linear_joined.JoinedModels(vocab, *linear.unpack_models(table), tuple(fx.STOP_WORDS))
    return _linear_scores(spark, sf, joined)


def score_all_goals(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.table(spark, sf, "benchmark", "item_id", "text")
    scored = linear.score_all_goals(samples, "text", fx.models(spark, sf), ["item_id"])
    return scored.withColumn("probability", _rounded("probability"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.training(spark, sf)
    scored = linear.model_probability(items, fx.models(spark, sf), "resume_text", "goal")
    return scored.select("goal", "label", "probability")


def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy(_predictions(spark, sf)).withColumn("accuracy", _rounded("accuracy"))


def eval_prf(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.precision_recall(_predictions(spark, sf))
    return metrics.select("goal", *[_rounded(c).alias(c) for c in ("precision", "recall", "f1")])


def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(_predictions(spark, sf))


# Audits


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All goals of the gate are registered; those with enough samples have a model."""
    gate = materialise(fx.source_gate(spark, sf), "gate")
    registry = gate.select("goal", audit.model_file(F.col("goal")).alias("model_path"), F.lit(None).cast("double").alias("accuracy"))
    return registry, gate.filter(F.col("action") == "train").select("goal")


def registry_audit(spark: SparkSession, sf: str) -> DataFrame:
    registry, stored = _registry(spark, sf)
    missing = audit.registered_without_model(registry, stored)
    return missing.select("goal", "model_path", fn.display_name(F.col("model_path")).alias("display_name"))


def goal_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Supported: sources and languages. With skills: sources by language. Registered: trained ones."""
    docs = fx.documents(spark, sf, "source", "lang")
    supported = docs.select(F.explode(F.array(F.upper("source"), F.col("lang"))).alias("goal"))
    having = docs.filter(F.col("lang") == "de").select(
        F.explode(F.array("source", F.concat_ws(" ", "source", "lang"))).alias("goal")
    )
    return goals.goal_consistency(supported, having, _registry(spark, sf)[1])


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    registry, stored = _registry(spark, sf)
    sizes = dictionaries.goal_sizes(
        fx.documents(spark, sf, "source", "lang")
        .groupBy(F.col("source").alias("goal"))
        .agg(F.collect_set("lang").alias("skills"))  # as many as there are languages
    )
    expected = registry.filter(~F.contains("goal", F.lit("/"))).select("goal")
    return audit_plan(spark, fx.CONFIG, expected, sizes, fx.vocabulary_table(spark, sf), stored, registry)


def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _check_rows(_checks(spark, sf))


def _check_rows(checks: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return checks.select("check", "status", "message", F.array_join(pairs, ";").alias("details"))


def health_files(spark: SparkSession, sf: str) -> DataFrame:
    """A model for each source but one, in a file each, and two files that cannot be read; the files are opened."""
    folder = new_path(spark, "audited")
    counted = fx.documents(spark, sf, "source").groupBy(F.col("source").alias("goal")).agg(F.count("*").alias("samples"))
    table = counted.select("goal", F.lit(0.0).alias("intercept"), F.array(F.lit(0.0)).alias("coefficients"))
    vocab = local_table(spark, [("word", 0, 1, 1, 1.0)], "term STRING, term_id INT, corpus_tf BIGINT, df BIGINT, idf DOUBLE")
    version = models.save_models(folder, vocab, [], table.filter("goal <> 'src0'").repartitionByRange("goal"), counted)
    for name in ("broken", "cut"):
        files.put_text(spark, f"{folder}/versions/{version}/models/{name}.parquet", "PAR1 no footer")
    checks = audit_files(spark, fx.CONFIG, folder, counted.select("goal"))
    return _check_rows(checks.filter(F.col("check").isin("vectorizer", "models", "registry")))


def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.roll_up(_checks(spark, sf))


# Streaming


def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a pattern may name either, a path only a folder."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table_stream(spark, sf, "documents")
    arriving = docs.select(
        F.concat(F.lit("stu_"), F.col("doc_id").cast("string")).alias("student_id"),
        F.col("lang").alias("goal"),
        F.col("text").alias("resume_text"),
    )
    output = new_path(spark, "responses")
    respond_stream(
        arriving, fx.dimensions(spark), output, new_path(spark, "responses-log"), available_now=True
    ).awaitTermination()
    scored = spark.read.parquet(output)
    return scored.select("student_id", "goal_used", _rounded("score").alias("score"))


def stream_new_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrivals in one stream; between them the configuration leaves French goals only."""
    source, output, log = (new_path(spark, name) for name in ("arrivals", "scored", "scored-log"))
    before = fx.dimensions(spark)
    after = score.load_dimensions(
        replace(before.config, supported_goals=("fr",), default_goal="fr"), fx.goal_skills(spark), fx.synonyms(spark), fx.recommendations(spark)
    )
    requests_ = fx.requests(spark, sf).withColumn("n", F.substring("student_id", 5, 20).cast("long"))
    for arrival, dims in ((0, before), (1, after)):
        requests_.filter(F.col("n") % 2 == arrival).drop("n").write.mode("append").parquet(source)
        arriving = spark.readStream.schema("student_id STRING, goal STRING, resume_text STRING").parquet(source)
        respond_stream_with(arriving, lambda _, dims=dims: (dims, None), output, log, available_now=True).awaitTermination()
    scored = spark.read.parquet(output)
    return scored.select("student_id", "goal_used", _rounded("score").alias("score"))


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    output = new_path(spark, "counts")
    counts = requests_per_minute(_table_stream(spark, sf, "events"), "user_id", "ts")
    write_counts(counts, output, new_path(spark, "counts-log"), available_now=True).awaitTermination()
    latest = latest_counts(spark.read.parquet(output), "user_id")
    return latest.filter(F.col("requests") > 1).select(
        "user_id", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests"
    )


# Declared switches


def _dated_requests(docs: DataFrame) -> DataFrame:
    """Requests of seven days; the Spanish ones name no goal and are rejected."""
    return docs.select(
        F.col("doc_id"),
        F.concat(F.lit("stu_"), F.col("doc_id").cast("string")).alias("student_id"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("goal"),
        F.col("text").alias("resume_text"),
        F.timestamp_add("hour", F.lit(6) + 24 * (F.col("doc_id") % 7), F.lit("2026-01-01").cast("timestamp_ntz")).alias("requested_at"),
    )


def _with_history(spark: SparkSession, **switches) -> score.Dimensions:
    dims = fx.dimensions(spark)
    return replace(dims, config=replace(dims.config, store_request_history=True, **switches))


def request_history(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of requests, one of them replayed, kept with hashed students; the first two days expire."""
    history, dims = History(spark, new_path(spark, "history")), _with_history(spark, anonymize_student_data=True)
    dated = _dated_requests(fx.documents(spark, sf, "doc_id", "lang", "text"))
    for batch in (0, 1, 2, 1):
        part = dated.filter(F.col("doc_id") % 3 == batch).drop("doc_id")
        keep_history(history, f"batch-{batch}", part, dims, salt=fx.SALT)
    history.expire(datetime.date(2026, 1, 3))
    return history.read().select(
        "student_id", "batch", F.date_format("day", "yyyy-MM-dd").alias("day"), "goal_used", "accepted",
        _rounded("score").alias("score"), F.size("matched_skills").alias("matched"), _joined("details").alias("details"),
    )


def stream_request_history(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of requests kept, then replayed from its start without its checkpoint."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    history, dims = History(spark, new_path(spark, "history")), _with_history(spark)
    for log in ("history-log", "lost-log"):
        docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 2)
        arriving = _dated_requests(docs.parquet(_whole_table(spark, sf, "documents"))).drop("doc_id")
        history_stream(arriving, dims, history, "requests", new_path(spark, log), available_now=True).awaitTermination()
    days = history.read().groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "goal_used", "accepted")
    return days.agg(F.count("*").alias("requests"), _rounded(F.sum("score")).alias("score"))


def _whole_table(spark: SparkSession, sf: str, name: str) -> str:
    """A folder with the files of a table, which may be one file; a stream reads folders only."""
    folder = new_path(spark, name)
    spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(folder)
    return folder


def ext_anonymise(spark: SparkSession, sf: str) -> DataFrame:
    return extensions.anonymise(fx.requests(spark, sf).select("student_id", "goal"), fx.SALT)


def ext_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events", "user_id", "ts")
    over = extensions.over_rate_limit(events, "user_id", "ts", 1)
    return over.select("user_id", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests")


def ext_low_score_alert(spark: SparkSession, sf: str) -> DataFrame:
    low = extensions.low_scores(_scored(spark, sf), fx.config())
    return low.select("student_id", "goal_used", _rounded("score").alias("score"))


def ext_partial_match(spark: SparkSession, sf: str) -> DataFrame:
    universe = goals.skill_universe(fx.goal_skills(spark))
    near = extensions.partial_matches(
        fx.documents(spark, sf, "text"), "text", universe, fx.config().partial_match_threshold
    )
    return near.withColumn("similarity", _rounded("similarity"))


def ext_usage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = score.usage(_scored(spark, sf))
    return metrics.select(
        "goal_used", "scored", *[_rounded(c).alias(c) for c in ("avg_score", "avg_matched", "avg_missing")]
    )


def ext_usage_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The same figures, collected in the pass that writes the scores."""
    config = replace(fx.config(), collect_usage_metrics=True)
    metrics = write_responses_with_usage(_scored(spark, sf), new_path(spark, "observed"), config)
    return metrics.select(
        "goal_used", "scored", *[_rounded(c).alias(c) for c in ("avg_score", "avg_matched", "avg_missing")]
    )


def ext_case_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    texts = fx.requests(spark, sf).select("resume_text")
    found = extract_skills(texts, "resume_text", fx.dimensions(spark).rules, case_sensitive=True)
    return gap.skill_rows(found, "found_skills", []).groupBy("skill").agg(F.count("*").alias("documents"))


QUERIES = {
    "flagship_goal_coverage": flagship_goal_coverage,
    "request_validation": request_validation,
    "request_accepted": request_accepted,
    "goal_file": goal_file,
    "blank_gate": blank_gate,
    "goal_resolution": goal_resolution,
    "goal_dimension": goal_dimension,
    "synonym_rules": synonym_rules,
    "skill_universe": skill_universe,
    "recommendations_last_wins": recommendations_last_wins,
    "dictionary_survivors": dictionary_survivors,
    "canonicalise_cascade": canonicalise_cascade,
    "extract_skills": extract_skills_rows,
    "extract_from_lists": extract_from_lists,
    "extract_few_terms": extract_few_terms,
    "extract_edge_terms": extract_edge_terms,
    "extract_large_dictionary": extract_large_dictionary,
    "extract_joined_dictionary": extract_joined_dictionary,
    "matched_skills": matched_skills,
    "missing_skills": missing_skills,
    "coverage_score": coverage_score,
    "pass_flag": pass_flag,
    "learning_path": learning_path,
    "score_response": score_response,
    "score_with_models": score_with_models,
    "tokens": tokens,
    "terms_bigrams": terms_bigrams,
    "vocabulary_topk": vocabulary_topk,
    "vocabulary_incremental": vocabulary_incremental,
    "idf": idf,
    "tfidf_l2": tfidf_l2,
    "training_counts": training_counts,
    "training_gate": training_gate,
    "training_files": training_files,
    "training_arrays": training_arrays,
    "trained_models_used": trained_models_used,
    "train_registry": train_registry,
    "train_outcomes": train_outcomes,
    "class_weights": class_weights,
    "stratified_split": stratified_split,
    "train_lr_metrics": train_lr_metrics,
    "train_summary": train_summary,
    "linear_score": linear_score,
    "linear_score_joined": linear_score_joined,
    "stored_models": stored_models,
    "model_versions": model_versions,
    "score_all_goals": score_all_goals,
    "eval_accuracy": eval_accuracy,
    "eval_prf": eval_prf,
    "eval_confusion": eval_confusion,
    "registry_audit": registry_audit,
    "goal_consistency": goal_consistency,
    "health_checks": health_checks,
    "health_rollup": health_rollup,
    "health_files": health_files,
    "stream_score": stream_score,
    "stream_new_dictionary": stream_new_dictionary,
    "stream_rate_limit": stream_rate_limit,
    "request_history": request_history,
    "stream_request_history": stream_request_history,
    "ext_anonymise": ext_anonymise,
    "ext_rate_limit": ext_rate_limit,
    "ext_low_score_alert": ext_low_score_alert,
    "ext_partial_match": ext_partial_match,
    "ext_usage_metrics": ext_usage_metrics,
    "ext_usage_observed": ext_usage_observed,
    "ext_case_sensitive": ext_case_sensitive,
}
