"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters, numbers and underscores in any script.
WORD_CHAR = r"[\p{L}\p{N}_]"

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Step separator of a learning path and the suffix of a stored model.
PATH_SEPARATOR = "→"
MODEL_SUFFIX = "_model.pkl"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean(text: Column) -> Column:
    """NULL becomes empty, then strip."""
    return strip(F.coalesce(text, F.lit("")))


def is_blank(text: Column) -> Column:
    """True when nothing is left after dropping everything but ASCII letters, digits and space."""
    return ~text.rlike("[a-zA-Z0-9]")


def join_list(texts: Column) -> Column:
    return F.concat_ws(", ", texts)


def tokens(text: Column) -> Column:
    """Lower-cased words that consist of ASCII letters and digits and start with a letter."""
    whole_word = f"(?<!{WORD_CHAR})[a-z][a-z0-9]*+(?!{WORD_CHAR})"
    return F.regexp_extract_all(F.lower(text), F.lit(whole_word), F.lit(0))


def ascii_words(text: Column) -> Column:
    """The lower-cased text with an underscore for every run of letters and numbers beyond ASCII.

    Its runs of a-z, 0-9 and underscores are the words of the text, so that ``tokens`` can be found byte by byte.
    """
    lower = F.lower(text)
    others = r"[[\p{L}\p{N}]&&[^\x00-\x7F]]++"
    return F.when(F.length(lower) == F.octet_length(lower), lower).otherwise(F.regexp_replace(lower, others, "_"))


def preview(text: Column, length: int = 60) -> Column:
    return F.substring(text, 1, length)


def path_steps(path: Column) -> Column:
    """Split a learning path into its steps; blank steps vanish."""
    steps = F.transform(F.split(path, PATH_SEPARATOR), strip)
    return F.filter(steps, lambda step: step != "")


def goal_key(goal: Column) -> Column:
    """Display name to model key: ``Data Engineer`` -> ``data_engineer``."""
    return F.lower(F.replace(goal, F.lit(" "), F.lit("_")))


def display_name(model_file: Column) -> Column:
    """Model file back to a title-cased name; the original capitals are lost."""
    stem = F.regexp_replace(model_file, MODEL_SUFFIX.replace(".", r"\.") + "$", "")
    # Every run of letters starts with a capital, also after digits and punctuation.
    runs = F.regexp_extract_all(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")
