"""Synonym rewriting and skill extraction.

The rules form a cascade: each rewrites what the rules before it left. A handful of rules runs as
built-in ``replace`` and ``contains`` expressions. For larger dictionaries one pass of those per
rule costs more than moving the text to Python, where an index from words to rules leaves only
the rules that can apply, whatever the size of the dictionary. A dictionary too large for the
driver and the workers stays a table, see ``extract_joined``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscore.functions.text import join_list
from gapscore.functions.words import (
    MARK,
    escape,
    has_word_edges,
    mark_words,
    to_find,
    unescape,
    unmark_words,
    with_marks,
    words_of,
)
from gapscore.operators import extract_joined
from gapscore.sources.dictionaries import RuleTables, SkillRules

# Measured break-even: the cost of built-in expressions grows with every term, that of the
# indexed Python pass does not.
NATIVE_TERMS = 8


def as_text(df: DataFrame, column: str) -> Column:
    """List-valued texts are joined; strings pass."""
    is_list = isinstance(df.schema[column].dataType, T.ArrayType)
    return join_list(F.col(column)) if is_list else F.col(column)


def fits_native(rules: SkillRules, terms: int) -> bool:
    """Few terms, and no rule that rewrites next to a word (its result may join that word)."""
    return terms <= NATIVE_TERMS and all(has_word_edges(synonym) for synonym, _ in rules.rules)


def _folded(term: str, case_sensitive: bool) -> str:
    return term if case_sensitive else term.lower()


def canonical_marked(text: Column, rules: SkillRules, case_sensitive: bool = False) -> Column:
    """The rewritten text with its words marked, by built-in expressions."""
    folded = text if case_sensitive else F.lower(text)
    pairs = [(_folded(s, case_sensitive), _folded(c, case_sensitive)) for s, c in rules.rules]
    steps = _constant([{"find": to_find(s), "put": with_marks(c)} for s, c in pairs], "find string, put string")
    return F.aggregate(steps, mark_words(folded), lambda marked, step: F.replace(marked, step.find, step.put))


def _contained(marked: Column, skills: tuple[str, ...], case_sensitive: bool) -> Column:
    wanted = [{"skill": s, "find": to_find(_folded(s, case_sensitive))} for s in skills]
    terms = _constant(wanted, "skill string, find string")
    # The text enters through an array of one, so that it is rewritten once and not per skill
    # even where the optimiser merges projections.
    found = F.transform(F.array(marked), lambda m: F.filter(terms, lambda term: F.contains(m, term.find)))
    return F.transform(F.get(found, 0), lambda term: term.skill)


def _constant(rows: list[dict], fields: str) -> Column:
    """An array of structs that the optimiser folds into one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def _python_pass(rules: SkillRules, case_sensitive: bool, want: str):
    """An Arrow UDF over lower-cased texts: the rewritten text or the skills found in it."""
    fold = (lambda term: term) if case_sensitive else str.lower
    rewrites = [(fold(synonym), fold(canonical)) for synonym, canonical in rules.rules]
    lookups = [(skill, fold(skill)) for skill in rules.skills]

    # (to find, to put, words it may introduce, pattern if it must be matched next to a word)
    plan = [
        (
            to_find(synonym),
            with_marks(canonical),
            words_of(canonical),
            canonical,
            None if has_word_edges(synonym) else r"\b" + re.escape(synonym) + r"\b",
        )
        for synonym, canonical in rewrites
    ]
    rules_by_word, rules_always = _index([synonym for synonym, _ in rewrites])
    skills_by_word, skills_always = _index([term for _, term in lookups])
    wanted = [(skill, to_find(term)) for skill, term in lookups]
    edge = MARK
    returns = T.StringType() if want == "text" else T.ArrayType(T.StringType())

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import heapq
        import re

        word = re.compile(r"\w+")
        split = re.compile(r"(\w+)").split
        patterns = [p and re.compile(p) for *_, p in plan]

        def mark(text):
            parts = split(text)  # between words, word, between words, ..., between words
            return edge.join(parts), set(parts[1::2])

        def candidates(words, by_word, always):
            return set(always).union(*(by_word[w] for w in words if w in by_word))

        def rewrite(text):
            marked, words = mark(escape(text))
            queued = candidates(words, rules_by_word, rules_always)
            queue = sorted(queued)
            while queue:
                number = heapq.heappop(queue)
                find, put, introduced, canonical, _ = plan[number]
                if find not in marked:
                    continue
                if patterns[number] is None:
                    marked = marked.replace(find, put)
                else:
                    plain = marked.replace(edge, "")
                    marked, introduced = mark(patterns[number].sub(lambda _: canonical, plain))
                words.update(introduced)
                # New words can only wake later rules: the cascade never goes back.
                for later in candidates(introduced, rules_by_word, ()) - queued:
                    if later > number:
                        queued.add(later)
                        heapq.heappush(queue, later)
            return marked, words

        def find_skills(text):
            marked, words = rewrite(text)
            hits = candidates(words, skills_by_word, skills_always)
            return [wanted[i][0] for i in sorted(hits) if wanted[i][1] in marked]

        def canonical_text(text):
            return unescape(rewrite(text)[0].replace(edge, ""))

        work = canonical_text if want == "text" else find_skills
        for batch in batches:
            yield batch.map(work, na_action="ignore")

    return run


def _index(terms: list[str]) -> tuple[dict[str, list[int]], list[int]]:
    """Term numbers by one word each term must contain, and those that contain no word."""
    by_word: dict[str, list[int]] = {}
    always: list[int] = []
    for number, term in enumerate(terms):
        words = words_of(term)
        if words:
            by_word.setdefault(max(words, key=len), []).append(number)
        else:
            always.append(number)
    return by_word, always


def canonicalise(
    df: DataFrame, column: str, rules: SkillRules | RuleTables, output: str = "canonical_text", case_sensitive: bool = False
) -> DataFrame:
    """Add the text after all rewrite rules."""
    text = as_text(df, column)
    if isinstance(rules, RuleTables):
        return extract_joined.canonicalise(df, text, rules, output, case_sensitive)
    if fits_native(rules, len(rules.rules)):
        return df.withColumn(output, unmark_words(canonical_marked(text, rules, case_sensitive)))
    folded = text if case_sensitive else F.lower(text)
    return df.withColumn(output, _python_pass(rules, case_sensitive, "text")(folded))


def extract_skills(
    df: DataFrame, column: str, rules: SkillRules | RuleTables, output: str = "found_skills", case_sensitive: bool = False
) -> DataFrame:
    """Add the skills, of all goals, whose names stand as whole words in the rewritten text."""
    text = F.coalesce(as_text(df, column), F.lit(""))
    if isinstance(rules, RuleTables):
        return extract_joined.extract_skills(df, text, rules, output, case_sensitive)
    if fits_native(rules, len(rules.rules) + len(rules.skills)):
        marked = canonical_marked(text, rules, case_sensitive)
        return df.withColumn(output, _contained(marked, rules.skills, case_sensitive))
    folded = text if case_sensitive else F.lower(text)
    return df.withColumn(output, _python_pass(rules, case_sensitive, "skills")(folded))
