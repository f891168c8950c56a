"""Table schemas of the engine."""

REQUEST = "student_id STRING, goal STRING, resume_text STRING"

PATH_ITEM = "STRUCT<path: ARRAY<STRING>, course: STRING>"

RESPONSE = (
    "student_id STRING, goal STRING, goal_used STRING, goal_was_defaulted BOOLEAN, "
    "score DOUBLE, matched_skills ARRAY<STRING>, missing_skills ARRAY<STRING>, "
    f"suggested_learning_path ARRAY<{PATH_ITEM}>"
)

GOAL_SKILLS = "goal STRING, pos INT, skill STRING"

SYNONYMS = "rule_no INT, canonical STRING, synonym STRING"

RECOMMENDATIONS = "seq INT, skill STRING, path STRING, course STRING"

TRAINING_ITEM = "resume_text STRING, label STRING"

VOCABULARY = "term STRING, term_id INT, corpus_tf BIGINT, df BIGINT, idf DOUBLE"

COEFFICIENTS = "goal STRING, term_id INT, coef DOUBLE"

INTERCEPTS = "goal STRING, intercept DOUBLE"

GOAL_MODELS = "goal STRING, intercept DOUBLE, coefficients ARRAY<DOUBLE>"

REGISTRY = (
    "goal STRING, model_path STRING, accuracy DOUBLE, samples BIGINT, "
    "positive_samples BIGINT, negative_samples BIGINT, feature_count INT"
)

CHECK = "check STRING, status STRING, message STRING, details MAP<STRING, STRING>"
