"""Awkward rows: nulls, empty and long texts, repeated rows and ids, clashing column names."""

from pyspark.sql import functions as F

# Names that the operators use for their own columns.
CLASHING = (
    "id hash sha body length best keep_id group_size kept row whole lines starts k at gone cut n_lines n_removed size "
    "source_rank start block parts copy times fp u v root least key context crc place first last runs is_target "
    "log_weight target bucket held_out score host path rank vec_id query_id shard"
).split()


def with_clashes(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


LONG = "\n".join(f"sentence {i} of a very long text." for i in range(9000))
ROWS = [
    (1, "alpha beta gamma delta epsilon", "en", "a", 30),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, "alpha  beta\tgamma delta epsilon", "en", None, 31),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, " \n\t ", "en", "b", 4),
    (None, "a text without an id", "en", "c", 20),
    (8, "x" * 3000, "en", "a", 3000),
    (8, "another text under the same id", "en", "a", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
