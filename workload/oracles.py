"""SQL equivalents of the queries for DuckDB, over views named like the tables."""

from __future__ import annotations

from gapscore.functions.text import MODEL_SUFFIX, WHITESPACE
from gapscore.operators import audit, gap, goals
from gapscore.operators.tfidf import MAX_FEATURES
from workload import fixtures as fx

WORD = r"[\p{L}\p{N}_]+"


def _lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(_lit(t) for t in texts) + "]"


def _values(rows, columns: str) -> str:
    def value(v):
        return str(v) if isinstance(v, (int, float)) else _lit(v)

    body = ", ".join("(" + ", ".join(value(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({columns})"


# Words are put between chr(1) and chr(2), as no text contains these.


def _mark(expression: str) -> str:
    return f"regexp_replace({expression}, '({WORD})', chr(1) || '\\1' || chr(2), 'g')"


def _marked(term: str) -> str:
    """A marked term as an SQL expression."""
    import re

    return f"regexp_replace({_lit(term)}, '({WORD})', chr(1) || '\\1' || chr(2), 'g')" if re.search(r"\w", term) else _lit(term)


def _find(term: str) -> str:
    before = "" if term[0].isalnum() else "chr(2) || "
    after = "" if term[-1].isalnum() else " || chr(1)"
    return f"{before}{_marked(term)}{after}"


def _cascade(expression: str, pairs) -> str:
    for canonical, synonym in pairs:
        expression = f"replace({expression}, {_find(synonym)}, {_marked(canonical)})"
    return expression


def _unmark(expression: str) -> str:
    return f"replace(replace({expression}, chr(1), ''), chr(2), '')"


def _canonical(text: str, lower: bool = True) -> str:
    return _cascade(_mark(f"lower({text})" if lower else text), fx.SYNONYMS)


SKILLS = sorted({skill for skills in fx.GOALS.values() for skill in skills})
SKILL_TABLE = "(SELECT unnest(" + _list(SKILLS) + ") AS skill)"


def _found(source: str, key: str, text: str, lower: bool = True) -> str:
    """CTE body: one row per text and skill found in it."""
    tests = ", ".join(
        f"CASE WHEN contains(m, {_find(skill)}) THEN {_lit(skill)} END" for skill in SKILLS
    )
    return f"""
      SELECT {key}, skill FROM (
        SELECT {key}, unnest([{tests}]) AS skill
        FROM (SELECT {key}, {_canonical(text, lower)} AS m FROM {source})
      ) WHERE skill IS NOT NULL"""


SUPPORTED = ", ".join(_lit(g) for g in dict.fromkeys(fx.CONFIG["model_goals_supported"]))
DEFAULT = _lit(fx.CONFIG["default_goal_model"])
GOAL_SKILLS = _values(
    [(g, p, s) for g, skills in fx.GOALS.items() for p, s in enumerate(skills)], "goal, pos, skill"
)
RECOMMENDATIONS = _values([(n, *r) for n, r in enumerate(fx.RECOMMENDATIONS)], "seq, skill, path, course")

REQUESTS = f"""
  SELECT 'stu_' || doc_id AS student_id, lang AS goal, text AS resume_text,
         CASE WHEN lang IN ({SUPPORTED}) THEN lang ELSE {DEFAULT} END AS goal_used,
         lang NOT IN ({SUPPORTED}) AS goal_was_defaulted
  FROM documents"""

THINNED = """
  SELECT * REPLACE (CASE goal WHEN 'es' THEN regexp_replace(resume_text, '[a-zA-Z0-9]', '', 'g')
                              WHEN 'de' THEN regexp_replace(resume_text, '[^ \n]', '', 'g')
                              ELSE resume_text END AS resume_text) FROM (""" + REQUESTS + ")"

STRIP = f"trim(resume_text, {_lit(WHITESPACE)})"

# Skills of the goal used, with the path item of each.
GOAL_ITEMS = f"""
  SELECT u.goal_used, g.pos, g.skill,
         CASE WHEN r.skill IS NULL
              THEN [{_lit(goals.GENERIC_STEP[0])} || g.skill || {_lit(goals.GENERIC_STEP[1])}]
              ELSE list_filter(list_transform(string_split(r.path, '→'), lambda x: trim(x)), lambda x: x <> '') END AS path,
         CASE WHEN r.skill IS NULL THEN {_lit(goals.GENERIC_COURSE)} ELSE r.course END AS course
  FROM (SELECT unnest([{SUPPORTED}]) AS goal_used) u
  JOIN {GOAL_SKILLS.replace('AS v(', 'AS g(')}
    ON g.goal = CASE WHEN u.goal_used IN (SELECT goal FROM {GOAL_SKILLS}) THEN u.goal_used ELSE {DEFAULT} END
  LEFT JOIN (SELECT * FROM {RECOMMENDATIONS} QUALIFY row_number() OVER (PARTITION BY skill ORDER BY seq DESC) = 1) r
    ON r.skill = g.skill"""


def _gap(requests: str = REQUESTS) -> str:
    """CTEs up to ``needs``: one row per request and required skill with a found flag."""
    return f"""
    WITH requests AS ({requests}),
    clean AS (SELECT * REPLACE ({STRIP} AS resume_text) FROM requests),
    found AS ({_found("clean", "student_id", "resume_text")}),
    items AS ({GOAL_ITEMS}),
    needs AS (
      SELECT c.student_id, c.goal, c.goal_used, c.goal_was_defaulted, i.pos, i.skill, i.path, i.course,
             regexp_matches(c.resume_text, '[a-zA-Z0-9]') AS has_text, f.skill IS NOT NULL AS found
      FROM clean c JOIN items i USING (goal_used)
      LEFT JOIN found f ON f.student_id = c.student_id AND f.skill = i.skill
    )"""


SCORES = """,
    scores AS (
      SELECT student_id, goal_used,
             CASE WHEN bool_and(has_text) THEN count(*) FILTER (found) / count(*) ELSE 0.0 END AS score,
             count(*) FILTER (found AND has_text) AS matched,
             count(*) FILTER (NOT found AND has_text) AS missing
      FROM needs GROUP BY ALL
    )"""


def _scores(select: str, requests: str = REQUESTS) -> str:
    return _gap(requests) + SCORES + "\n    " + select


USAGE = """SELECT goal_used, count(*) AS scored, round(avg(score), 6) AS avg_score,
    round(avg(matched), 6) AS avg_matched, round(avg(missing), 6) AS avg_missing FROM scores GROUP BY goal_used"""


# Terms and TF-IDF

STOPS = _list(fx.STOP_WORDS)


def _tokens(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD}')"
    return f"list_filter({words}, lambda w: regexp_full_match(w, '[a-z][a-z0-9]*'))"


def _kept(text: str) -> str:
    return f"list_filter({_tokens(text)}, lambda w: NOT list_contains({STOPS}, w))"


def _terms(source: str, keys: str, text: str) -> str:
    return f"""
      SELECT {keys}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
      FROM (SELECT {keys}, {_kept(text)} AS t FROM {source})"""


VOCABULARY = f"""
    tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms("documents", "doc_id", "text")}) GROUP BY ALL),
    ranked AS (
      SELECT term, sum(tf)::BIGINT AS corpus_tf, count(*) AS df FROM tf GROUP BY term
      HAVING count(*) <= {fx.MAX_DF} * (SELECT count(*) FROM documents)
      ORDER BY corpus_tf DESC, term LIMIT {MAX_FEATURES}
    ),
    vocabulary AS (
      SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS term_id, corpus_tf, df,
             ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
      FROM ranked
    )"""

# TF-IDF of all documents and of the sample texts.
WEIGHTS = """,
    raw AS (SELECT doc_id, term_id, (1 + ln(tf)) * idf AS w FROM tf JOIN vocabulary USING (term)),
    weights AS (SELECT doc_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""

TRAINING_IDS = """
      SELECT doc_id, 'quality' AS goal, quality AS label FROM labels
      UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"""

MODELS = f""",
    training AS ({TRAINING_IDS}),
    coefficients AS (
      SELECT goal, term_id, round(ln((sum(label) + 1) / (count(*) - sum(label) + 1)), 6) AS coef
      FROM weights JOIN training USING (doc_id) GROUP BY ALL
    ),
    intercepts AS (
      SELECT goal, round(ln((sum(label) + 1) / (count(*) - sum(label) + 1)), 6) AS intercept
      FROM training GROUP BY goal
    )"""


def _probability(pairs: str, weights: str = "weights", key: str = "doc_id") -> str:
    """CTE body: probability of each (key, goal) pair; NULL without a model."""
    return f"""
      SELECT p.{key}, p.goal, 1 / (1 + exp(-(coalesce(s.total, 0) + i.intercept))) AS probability
      FROM ({pairs}) p
      LEFT JOIN intercepts i USING (goal)
      LEFT JOIN (
        SELECT {key}, goal, sum(weight * coef) AS total
        FROM {weights} JOIN coefficients USING (term_id) GROUP BY ALL
      ) s ON s.{key} = p.{key} AND s.goal = p.goal"""


PREDICTIONS = f"""
    WITH {VOCABULARY} {WEIGHTS} {MODELS},
    predictions AS (
      SELECT t.goal, t.label, p.probability,
             (p.probability > 0.5)::INT AS predicted
      FROM ({_probability("SELECT doc_id, goal FROM training")}) p JOIN training t USING (doc_id, goal)
    )"""

# Training

GATE = """
    WITH known AS (
      SELECT unnest([source, source || '/' || lang]) AS goal, quality AS label
      FROM documents LEFT JOIN labels USING (doc_id)
    ),
    counted AS (
      SELECT goal, count(label) AS samples, coalesce(sum(label), 0)::BIGINT AS positive_samples,
             (count(label) - coalesce(sum(label), 0))::BIGINT AS negative_samples,
             least(nullif(count(*) FILTER (label = 0), 0), nullif(count(*) FILTER (label = 1), 0)) AS rarest
      FROM known GROUP BY goal
    ),
    gate AS (
      SELECT goal, samples, positive_samples, negative_samples,
             CASE WHEN samples = 0 THEN 'no data' WHEN samples < 10 THEN 'not enough samples'
                  WHEN samples <= 20 THEN 'cross-validate' WHEN rarest < 2 THEN 'a label has one sample'
                  ELSE 'train' END AS action
      FROM counted
    )"""

SPLIT = f"""
    WITH items AS ({TRAINING_IDS}),
    strata AS (
      SELECT goal, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY goal) AS total
      FROM items GROUP BY goal, label
    ),
    sized AS (
      SELECT *, (total - ceil(total * 40 / 100))::BIGINT AS train_total FROM strata
    ),
    based AS (
      SELECT *, n * train_total // total AS base, n * train_total % total AS remainder FROM sized
    ),
    turned AS (
      SELECT *, row_number() OVER (PARTITION BY goal ORDER BY remainder DESC, label) AS turn,
             train_total - sum(base) OVER (PARTITION BY goal) AS short
      FROM based
    ),
    cut AS (SELECT goal, label, n - base - (turn <= short)::INT AS n_test FROM turned)
    SELECT goal, label, doc_id,
           row_number() OVER (PARTITION BY goal, label ORDER BY md5(doc_id || ':42'), doc_id) <= n_test AS is_test
    FROM items JOIN cut USING (goal, label)"""


def _key(goal: str) -> str:
    return f"lower(replace({goal}, ' ', '_'))"


DISPLAY = f"""
    array_to_string(list_transform(regexp_extract_all(replace({_key("goal")}, '_', ' '), '\\p{{L}}+|[^\\p{{L}}]+'),
      lambda w: upper(w[1]) || lower(w[2:])), '')"""

CHECKS = (
    GATE
    + f""",
    expected AS (SELECT goal, action FROM gate WHERE NOT contains(goal, '/')),
    goal_counts AS (SELECT source, count(DISTINCT lang) AS skills FROM documents GROUP BY source),
    {VOCABULARY},
    models AS (SELECT count(*) FILTER (action = 'train') AS loaded, count(*) FILTER (action <> 'train') AS failed FROM expected),
    unstored AS (
      SELECT count(*) AS missing, coalesce(string_agg({_key("goal")} || '{MODEL_SUFFIX}', ', ' ORDER BY {_key("goal")} || '{MODEL_SUFFIX}'), '') AS files
      FROM gate WHERE action <> 'train'
    ),
    checks AS (
      SELECT 'config' AS "check", 'ok' AS status, 'Config loaded successfully' AS message,
             'min_score_threshold={fx.CONFIG["minimum_score_to_pass"]};supported_goals={len(fx.CONFIG["model_goals_supported"])};version={fx.CONFIG["version"]}' AS details
      UNION ALL
      SELECT 'vectorizer', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END,
             CASE WHEN count(*) > 0 THEN 'Vectorizer loaded successfully' ELSE 'Vectorizer load failed' END,
             'vocabulary_size=' || count(*) FROM vocabulary
      UNION ALL
      SELECT 'models', CASE WHEN loaded = 0 THEN 'error' WHEN failed > 0 THEN 'degraded' ELSE 'ok' END,
             CASE WHEN loaded = 0 THEN 'No trained models found'
                  ELSE 'Models check completed: ' || loaded || ' loaded, ' || failed || ' failed' END,
             'failed=' || failed || ';loaded=' || loaded || ';total_models=' || (loaded + failed) FROM models
      UNION ALL
      SELECT 'goals', 'ok', 'Goals loaded successfully',
             'invalid_format=0;total_goals=' || count(*) || ';total_skills=' || sum(skills) FROM goal_counts
      UNION ALL
      SELECT 'registry', CASE WHEN missing = 0 THEN 'ok' ELSE 'warning' END, 'Registry check completed',
             'has_metrics=false;missing_files=' || files || ';registered_models=' || (SELECT count(*) FROM gate) FROM unstored
    )"""
)

# A text where ".com" follows twice in a row needs the replacement twice: the first one uses up
# the mark that the second one needs. Rules next to a word may join words, so words are marked anew.


def _edge_canonical(text: str) -> str:
    expression = _mark(f"lower({text})")
    for canonical, synonym in fx.EDGE_SYNONYMS:
        if synonym[0].isalnum() and synonym[-1].isalnum():
            expression = f"replace({expression}, {_find(synonym)}, {_marked(canonical)})"
            continue
        before = "" if synonym[0].isalnum() else "chr(2) || "
        after = "" if synonym[-1].isalnum() else " || chr(1)"
        put = f"{before}{_lit(canonical)}{after}"
        twice = f"replace(replace({expression}, {_find(synonym)}, {put}), {_find(synonym)}, {put})"
        expression = _mark(_unmark(twice))
    return expression


EDGE_TESTS = ", ".join(f"CASE WHEN contains(m, {_find(s)}) THEN {_lit(s)} END" for s in fx.EDGE_SKILLS)

FEW_TESTS = ", ".join(f"CASE WHEN contains(m, {_find(s)}) THEN {_lit(s)} END" for s in fx.FEW_SKILLS)

PATH_TEXT = "array_to_string(path, '>') || '@' || course"
TAIL_TEXT = _lit(f"{gap.TAIL_STEP}@{gap.TAIL_COURSE}")

COVERAGE = _scores("SELECT student_id, goal_used, round(score, 6) AS score FROM scores")

RATE_LIMIT = """
    SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests
    FROM events GROUP BY ALL HAVING count(*) > 1"""

BODIES = """
    bodies AS (
      SELECT CASE WHEN source = 'src0' OR (source = 'src1' AND lang = 'de') THEN NULL ELSE 'stu_' || doc_id END AS student_id,
             CASE WHEN lang = 'es' OR (source = 'src1' AND lang = 'de') THEN NULL ELSE lang END AS goal,
             CASE WHEN source = 'src1' AND lang = 'de' THEN 'body: JSON decode error'
               ELSE concat_ws('|',
                 CASE WHEN source = 'src0' THEN 'body.student_id: Input should be a valid string' END,
                 CASE WHEN lang = 'es' THEN 'body.goal: Field required' END) END AS details
      FROM documents
    )"""

# DuckDB's edit distance counts bytes, so letters of two bytes become capitals, which lower-case texts lack.
ONE_BYTE = "translate({}, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&*+')"

def _words_as_dictionary(samples: str) -> str:
    return f"""
      WITH words AS (SELECT DISTINCT unnest({_tokens('text')}) AS w FROM {samples}),
      numbered AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS n FROM words),
      meaning AS (
        SELECT a.w, b.w AS skill FROM numbered a JOIN numbered b ON b.n = a.n - a.n % 8
      ),
      found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents)
      SELECT skill, count(DISTINCT doc_id) AS documents FROM found JOIN meaning USING (w) GROUP BY skill"""


# Requests of seven days; those that name no goal are rejected.
HISTORY = f"""
    dated AS (
      SELECT doc_id, 'stu_' || doc_id AS student_id, strftime(DATE '2026-01-01' + (doc_id % 7)::INT, '%Y-%m-%d') AS day,
             lang <> 'es' AS accepted FROM documents
    ),
    history AS (
      SELECT d.doc_id, d.student_id, day, accepted, CASE WHEN accepted THEN goal_used END AS goal_used,
             CASE WHEN accepted THEN CASE WHEN matched = 0 THEN 0.0 ELSE score END END AS score,
             CASE WHEN accepted THEN matched END AS matched,
             CASE WHEN accepted THEN '' ELSE 'body.goal: Field required' END AS details
      FROM dated d JOIN scores USING (student_id)
    )"""

ORACLES = {
    "flagship_goal_coverage": _scores(USAGE),
    "request_validation": f"WITH {BODIES} SELECT student_id, goal, details FROM bodies WHERE details <> ''",
    "request_accepted": _scores(
        f"""SELECT b.student_id, b.goal, round(CASE WHEN s.matched = 0 THEN 0.0 ELSE s.score END, 6) AS score
        FROM scores s JOIN (WITH {BODIES} SELECT * FROM bodies WHERE details = '') b USING (student_id)"""
    ),
    "goal_file": f"""
      WITH r AS (
        SELECT 'stu_' || doc_id AS student_id, CASE WHEN lang IN ({SUPPORTED}) THEN lang ELSE 'it' END AS goal_used,
               CASE WHEN lang = 'en' AND regexp_matches({STRIP.replace("resume_text", "text")}, '[a-zA-Z0-9]') THEN {_list(fx.GOALS_FILE_LAST)} ELSE [] END AS skills,
               regexp_extract_all(lower(text), '{WORD}') AS words
        FROM documents
      ), g AS (
        SELECT *, list_filter(skills, lambda s: list_contains(words, s)) AS matched,
               list_filter(skills, lambda s: NOT list_contains(words, s)) AS missing FROM r
      )
      SELECT student_id, goal_used, round(CASE WHEN len(skills) = 0 THEN 0.0 ELSE len(matched) / len(skills) END, 6) AS score,
             array_to_string(matched, '|') AS matched_skills, array_to_string(missing, '|') AS missing_skills
      FROM g""",
    "extract_large_dictionary": _words_as_dictionary("benchmark"),
    "extract_joined_dictionary": _words_as_dictionary("documents"),
    "trained_models_used": f"""
      WITH {VOCABULARY} {WEIGHTS} {MODELS}
      SELECT doc_id, CASE goal WHEN 'quality' THEN 'Text Quality' WHEN 'toxic' THEN 'Toxic Text' ELSE goal END AS goal,
             round(probability, 6) AS probability
      FROM ({_probability(
        "SELECT doc_id, CASE lang WHEN 'en' THEN 'quality' WHEN 'fr' THEN 'toxic' ELSE lang END AS goal FROM documents"
      )})""",
    "train_registry": f"""
      WITH {VOCABULARY},
      items AS ({TRAINING_IDS}),
      counted AS (
        SELECT goal, count(*) AS samples, sum(label)::BIGINT AS positive_samples,
               (count(*) - sum(label))::BIGINT AS negative_samples FROM items GROUP BY goal
      )
      SELECT goal, goal || '{MODEL_SUFFIX}' AS model_path, samples, positive_samples, negative_samples,
             (SELECT count(*) FROM vocabulary)::INT AS feature_count, ceil(samples * 40 / 100)::BIGINT AS tested
      FROM counted""",
    "train_outcomes": """
      WITH counted AS (
        SELECT lang AS goal, count(*) AS n,
               least(nullif(count(*) FILTER (quality = 0), 0), nullif(count(*) FILTER (quality = 1), 0)) AS rarest,
               count(DISTINCT quality) AS classes
        FROM documents JOIN labels USING (doc_id) GROUP BY lang
      )
      SELECT goal, CASE WHEN n < 10 THEN 'not enough samples' WHEN n <= 20 THEN 'cross-validated'
                        WHEN rarest < 2 THEN 'a label has one sample'
                        WHEN classes < 2 THEN 'failed: all training samples have the same label'
                        ELSE 'trained' END AS outcome FROM counted""",
    "training_arrays": f"""
      SELECT goal, count(*) AS samples, sum(label)::BIGINT AS positive_samples,
             (count(*) - sum(label))::BIGINT AS negative_samples
      FROM ({TRAINING_IDS}) JOIN documents USING (doc_id) WHERE source <> 'src2' GROUP BY goal""",
    "blank_gate": f"""
      SELECT student_id, length({STRIP}) AS length, NOT regexp_matches({STRIP}, '[a-zA-Z0-9]') AS blank
      FROM ({THINNED})""",
    "goal_resolution": f"""
      WITH dictionary AS (SELECT goal, count(*) AS skills FROM {GOAL_SKILLS} GROUP BY goal),
      resolved AS (
        SELECT goal, goal_used, goal_was_defaulted,
               CASE WHEN goal_used IN (SELECT goal FROM dictionary) THEN goal_used ELSE {DEFAULT} END AS skills_of
        FROM ({REQUESTS})
      )
      SELECT r.goal, goal_used, goal_was_defaulted, skills_of, count(*) AS requests, max(d.skills) AS skills
      FROM resolved r JOIN dictionary d ON d.goal = skills_of GROUP BY ALL""",
    "goal_dimension": """
      SELECT source AS goal, CASE WHEN source <> 'src3' THEN count(DISTINCT lang) END AS skills,
             source = 'src3' AS malformed
      FROM documents GROUP BY source""",
    "synonym_rules": """
      SELECT row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS rule_no, source AS canonical, lang AS synonym
      FROM (SELECT DISTINCT source, lang FROM documents)""",
    "skill_universe": f"SELECT DISTINCT unnest({_tokens('text')}) AS skill FROM documents",
    "recommendations_last_wins": """
      WITH last AS (
        SELECT * FROM documents
        QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1
      ),
      steps AS (
        SELECT source || '/' || lang AS skill, doc_id,
               list_filter(list_transform(string_split(replace(text, chr(10), '→'), '→'),
                           lambda x: trim(x, """ + _lit(WHITESPACE) + """)), lambda x: x <> '') AS path
        FROM last
      )
      SELECT skill, len(path) AS steps, array_to_string(path, '|') AS path, 'course ' || doc_id AS course
      FROM steps""",
    "dictionary_survivors": f"""
      WITH universe AS (SELECT DISTINCT unnest({_tokens('text')}) AS skill FROM benchmark)
      SELECT skill, contains({_canonical('skill')}, chr(1) || skill || chr(2)) AS survives FROM universe""",
    "canonicalise_cascade": f"""
      WITH done AS (SELECT doc_id, lower(text) AS low, {_unmark(_canonical('text'))} AS canonical FROM documents)
      SELECT 'stu_' || doc_id AS student_id, canonical <> low AS changed, md5(canonical) AS canonical_md5 FROM done""",
    "extract_skills": _found(f"({REQUESTS})", "student_id", "resume_text"),
    "extract_few_terms": f"""
      SELECT student_id, skill FROM (
        SELECT 'stu_' || doc_id AS student_id, unnest([{FEW_TESTS}]) AS skill
        FROM (SELECT doc_id, {_cascade(_mark("lower(text)"), fx.SYNONYMS[:4])} AS m FROM documents)
      ) WHERE skill IS NOT NULL""",
    "extract_from_lists": f"""
      WITH lists AS (
        SELECT 'stu_' || doc_id AS student_id, array_to_string(string_split(text, chr(10)), ', ') AS joined
        FROM documents
      ),
      found AS ({_found("lists", "student_id", "joined")})
      SELECT student_id, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS skills
      FROM lists LEFT JOIN found USING (student_id) GROUP BY student_id""",
    "extract_edge_terms": f"""
      SELECT page_id, skill FROM (
        SELECT page_id, unnest([{EDGE_TESTS}]) AS skill
        FROM (SELECT page_id, {_edge_canonical("url || ' ' || html")} AS m FROM pages)
      ) WHERE skill IS NOT NULL""",
    "matched_skills": _gap()
    + """
      SELECT student_id, (row_number() OVER (PARTITION BY student_id ORDER BY pos) - 1)::INT AS pos, skill
      FROM needs WHERE found""",
    "missing_skills": _gap()
    + """
      SELECT student_id, (row_number() OVER (PARTITION BY student_id ORDER BY pos) - 1)::INT AS pos, skill
      FROM needs WHERE NOT found""",
    "coverage_score": COVERAGE,
    "pass_flag": _scores(
        f"""SELECT goal_used, score >= {fx.CONFIG["minimum_score_to_pass"]} AS passed, count(*) AS requests
        FROM scores GROUP BY ALL"""
    ),
    "learning_path": _gap()
    + f""",
    rows AS (
      SELECT student_id, pos, path, course FROM needs WHERE NOT found AND path IS NOT NULL AND course IS NOT NULL
      UNION ALL
      SELECT DISTINCT student_id, 1000, [{_lit(gap.TAIL_STEP)}], {_lit(gap.TAIL_COURSE)} FROM needs WHERE NOT found
    )
    SELECT student_id, (row_number() OVER (PARTITION BY student_id ORDER BY pos) - 1)::INT AS pos,
           array_to_string(path, '|') AS path, course FROM rows""",
    "score_response": _gap(THINNED)
    + f"""
    SELECT student_id, goal, goal_used, goal_was_defaulted,
           CASE WHEN bool_and(has_text) THEN round(count(*) FILTER (found) / count(*), 6) ELSE 0.0 END AS score,
           coalesce(string_agg(skill, '|' ORDER BY pos) FILTER (found AND has_text), '') AS matched_skills,
           coalesce(string_agg(skill, '|' ORDER BY pos) FILTER (NOT found AND has_text), '') AS missing_skills,
           concat_ws('|',
             string_agg({PATH_TEXT}, '|' ORDER BY pos) FILTER (NOT found AND has_text AND path IS NOT NULL AND course IS NOT NULL),
             CASE WHEN count(*) FILTER (NOT found AND has_text) > 0 THEN {TAIL_TEXT} END) AS suggested_learning_path
    FROM needs GROUP BY ALL""",
    "score_with_models": _gap()
    + SCORES
    + f""", {VOCABULARY} {WEIGHTS} {MODELS},
    modelled AS ({_probability("SELECT doc_id, 'quality' AS goal FROM documents")})
    SELECT s.student_id, s.goal_used,
           round(CASE WHEN s.matched = 0 THEN 0.0 WHEN s.goal_used = 'en' THEN m.probability ELSE s.score END, 6) AS score
    FROM scores s JOIN modelled m ON s.student_id = 'stu_' || m.doc_id""",
    "tokens": f"""
      SELECT doc_id, term, count(*) AS tf
      FROM (SELECT doc_id, unnest({_kept('text')}) AS term FROM documents) GROUP BY ALL""",
    "terms_bigrams": f"""
      SELECT lang, term, count(*) AS tf FROM ({_terms("documents", "lang", "text")}) GROUP BY ALL""",
    "vocabulary_topk": f"WITH {VOCABULARY} SELECT term, term_id, corpus_tf, df FROM vocabulary",
    "idf": f"WITH {VOCABULARY} SELECT term, round(idf, 6) AS idf FROM vocabulary",
    "tfidf_l2": f"""
      WITH {VOCABULARY} {WEIGHTS} SELECT doc_id, term_id, round(weight, 6) AS weight FROM weights""",
    "training_counts": f"""
      SELECT goal, count(*) AS samples, sum(label)::BIGINT AS positive_samples,
             (count(*) - sum(label))::BIGINT AS negative_samples
      FROM ({TRAINING_IDS}) GROUP BY goal""",
    "training_gate": GATE + "SELECT * FROM gate",
    "training_files": f"""
      SELECT goal, count(*) FILTER (source <> 'src2') AS samples,
             (sum(label) FILTER (source <> 'src2'))::BIGINT AS positive_samples,
             (count(*) FILTER (source <> 'src2') - sum(label) FILTER (source <> 'src2'))::BIGINT AS negative_samples,
             count(*) FILTER (source = 'src2') AS broken
      FROM ({TRAINING_IDS}) JOIN documents USING (doc_id) GROUP BY goal""",
    "class_weights": f"""
      SELECT goal, label, round(sum(count(*)) OVER (PARTITION BY goal)
             / (count(*) OVER (PARTITION BY goal) * count(*)), 6) AS weight
      FROM ({TRAINING_IDS}) GROUP BY goal, label""",
    "stratified_split": SPLIT,
    "linear_score": f"""
      WITH {VOCABULARY} {WEIGHTS} {MODELS}
      SELECT doc_id, goal, round(probability, 6) AS probability FROM ({_probability(
        "SELECT doc_id, CASE lang WHEN 'en' THEN 'quality' WHEN 'fr' THEN 'toxic' ELSE lang END AS goal FROM documents"
      )})""",
    "score_all_goals": f"""
      WITH {VOCABULARY} {WEIGHTS} {MODELS},
      sample_tf AS (SELECT item_id, term, count(*) AS tf FROM ({_terms("benchmark", "item_id", "text")}) GROUP BY ALL),
      sample_raw AS (SELECT item_id, term_id, (1 + ln(tf)) * idf AS w FROM sample_tf JOIN vocabulary USING (term)),
      sample_weights AS (SELECT item_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM sample_raw),
      scored AS ({_probability(
        "SELECT item_id, goal FROM benchmark CROSS JOIN intercepts", "sample_weights", "item_id"
      )})
      SELECT item_id, goal, round(probability, 6) AS probability,
             CASE WHEN probability > 0.5 THEN 'MATCH' ELSE 'NO MATCH' END AS label, substr(text, 1, 60) AS preview
      FROM scored JOIN benchmark USING (item_id)""",
    "eval_accuracy": PREDICTIONS
    + """
      SELECT goal, count(*) AS tested, round(avg((predicted = label)::INT), 6) AS accuracy
      FROM predictions GROUP BY goal""",
    "eval_prf": PREDICTIONS
    + """,
      counts AS (
        SELECT goal, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
               count(*) FILTER (label = 1 AND predicted = 0) AS fn
        FROM predictions GROUP BY goal HAVING count(DISTINCT label) > 1
      )
      SELECT goal, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
             round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
             round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM counts""",
    "eval_confusion": PREDICTIONS
    + """
      SELECT goal, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
             count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp
      FROM predictions GROUP BY goal""",
    "registry_audit": GATE
    + f"""
      SELECT goal, {_key("goal")} || '{MODEL_SUFFIX}' AS model_path, {DISPLAY} AS display_name
      FROM gate WHERE action <> 'train'""",
    "goal_consistency": GATE
    + f""",
      supported AS (SELECT DISTINCT {_key("unnest([upper(source), lang])")} AS k FROM documents),
      having_skills AS (
        SELECT DISTINCT {_key("unnest([source, source || ' ' || lang])")} AS k FROM documents WHERE lang = 'de'
      ),
      registered AS (SELECT DISTINCT {_key("goal")} AS k FROM gate WHERE action = 'train'),
      keys AS (SELECT k FROM supported UNION SELECT k FROM having_skills UNION SELECT k FROM registered)
      SELECT k AS goal_key, k IN (SELECT k FROM supported) AS is_supported,
             k IN (SELECT k FROM having_skills) AS has_skills, k IN (SELECT k FROM registered) AS is_registered
      FROM keys""",
    "health_checks": CHECKS + "SELECT * FROM checks",
    "health_rollup": CHECKS
    + """
      SELECT CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'degraded' ELSE 'ok' END AS status,
             count(*) AS checks, count(*) FILTER (status <> 'ok') AS not_ok FROM checks""",
    "stream_score": _scores(
        "SELECT student_id, goal_used, round(CASE WHEN matched = 0 THEN 0.0 ELSE score END, 6) AS score FROM scores"
    ),
    "stream_new_dictionary": " UNION ALL ".join(
        "SELECT student_id, goal_used, round(CASE WHEN matched = 0 THEN 0.0 ELSE score END, 6) AS score FROM ("
        + _scores("SELECT * FROM scores", f"SELECT * FROM ({requests}) WHERE substr(student_id, 5)::BIGINT % 2 = {arrival}")
        + ")"
        for arrival, requests in ((0, REQUESTS), (1, f"SELECT * REPLACE ('fr' AS goal_used, true AS goal_was_defaulted) FROM ({REQUESTS})"))
    ),
    "stream_rate_limit": RATE_LIMIT,
    "health_files": f"""
      WITH goals AS (SELECT count(DISTINCT source) AS n FROM documents)
      SELECT 'vectorizer' AS check, 'ok' AS status, {_lit(audit.VECTORIZER_OK)} AS message, 'vocabulary_size=1' AS details
      UNION ALL SELECT 'models', 'degraded', printf({_lit(audit.MODELS_DONE)}, n - 1, 2),
             'absent=1;failed=2;failed_files=broken.parquet, cut.parquet;loaded=' || (n - 1) FROM goals
      UNION ALL SELECT 'registry', 'warning', {_lit(audit.REGISTRY_DONE)},
             'has_metrics=false;missing_files=src0{MODEL_SUFFIX};registered_models=' || n FROM goals""",
    "model_versions": f"""
      WITH counted AS (SELECT goal, count(*) AS samples, round(sum(label) / count(*), 6) AS rate FROM ({TRAINING_IDS}) GROUP BY goal)
      SELECT 'first' AS reader, * FROM counted WHERE goal = 'toxic'
      UNION ALL SELECT 'back', * FROM counted WHERE goal = 'toxic'
      UNION ALL SELECT 'current', * FROM counted""",
    "request_history": _scores(
        f""", {HISTORY} SELECT sha256('{fx.SALT}' || student_id) AS student_id, 'batch-' || (doc_id % 3) AS batch, day, goal_used,
        accepted, round(score, 6) AS score, matched::INT AS matched, details FROM history WHERE day >= '2026-01-03'"""
    ),
    "stream_request_history": _scores(
        f""", {HISTORY} SELECT day, goal_used, accepted, count(*) AS requests, round(sum(score), 6) AS score
        FROM history GROUP BY ALL"""
    ),
    "ext_anonymise": f"""
      SELECT sha256('{fx.SALT}' || 'stu_' || doc_id) AS student_id, lang AS goal FROM documents""",
    "ext_rate_limit": RATE_LIMIT,
    "ext_low_score_alert": _scores(
        "SELECT student_id, goal_used, round(score, 6) AS score FROM scores WHERE score < 0.3"
    ),
    "ext_usage_metrics": _scores(USAGE),
    "ext_partial_match": f"""
      WITH texts AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
      runs AS (
        SELECT doc_id, 1 AS n, unnest(w) AS run FROM texts
        UNION SELECT doc_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
      ),
      counted AS (SELECT n, run, count(*) AS documents FROM runs GROUP BY ALL),
      compared AS (
        SELECT skill, run AS word, documents,
               1 - levenshtein({ONE_BYTE.format("run")}, {ONE_BYTE.format("lower(skill)")}) / greatest(length(run), length(skill)) AS similarity
        FROM counted JOIN {SKILL_TABLE} ON n = len(string_split(skill, ' '))
          AND length(run) BETWEEN 0.5 * length(skill) AND 2 * length(skill)
      )
      SELECT skill, word, documents, round(similarity, 6) AS similarity
      FROM compared WHERE similarity >= {fx.config().partial_match_threshold} - 1e-9""",
    "ext_case_sensitive": f"""
      SELECT skill, count(*) AS documents FROM ({_found(f"({REQUESTS})", "student_id", "resume_text", lower=False)})
      GROUP BY skill""",
}
ORACLES["stored_models"] = ORACLES["linear_score"]
ORACLES["vocabulary_incremental"] = ORACLES["vocabulary_topk"]
ORACLES["ext_usage_observed"] = ORACLES["ext_usage_metrics"]
ORACLES["linear_score_joined"] = ORACLES["linear_score"]
