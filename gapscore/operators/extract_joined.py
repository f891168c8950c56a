"""Rewriting and extraction with dictionaries of any size, by joins.

Nothing of the dictionary is held by the driver or broadcast. Each term is filed under its rarest word, and a
text meets only the terms filed under a word that it contains, or that a rule may bring into it. Any set of rules that
holds all that can apply gives the same text, because a rule that finds nothing changes nothing; so words that only
may come up are enough, and the rules of a text run in order in its own row.

Rules from one word to one word never look beyond a word, so what becomes of a word is found once, in the dictionary, and
texts look up their words. Only a text that meets any other rule, or a skill that is not one word, is rewritten rule by rule.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gapscore.functions.text import WORD_CHAR
from gapscore.functions.words import MARK, drop_marks, escape_marks, put_marks, unmark_words
from gapscore.sources.dictionaries import RuleTables
from gapscore.storage import materialise

_ROW = "_extract_row"

#: Bytes of text whose words are shuffled at a time.
PORTION_BYTES = 1 << 30


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_CHAR + "+"), F.lit(0))


def _keys(text: Column) -> Column:
    """All that a term of the text can be filed under: its words, and single characters outside of words."""
    return F.array_distinct(F.concat(_words(text), F.regexp_extract_all(text, F.lit("(?s)[^\\p{L}\\p{N}_]"), F.lit(0))))


def _checked(term: Column) -> Column:
    bad = term.isNull() | (term == "") | term.rlike("[\u0001\u0002\u0003\u0004]")
    return F.when(bad, F.raise_error(F.concat(F.lit("not usable as a dictionary term: "), F.coalesce(term, F.lit("NULL"))))).otherwise(term)


def _is_word(term: Column) -> Column:
    return term.rlike(r"\A" + WORD_CHAR + r"+\z")


def _starts_in_word(term: Column) -> Column:
    return term.rlike("^" + WORD_CHAR)


def _ends_in_word(term: Column) -> Column:
    return term.rlike(WORD_CHAR + r"\z")


def _find(term: Column) -> Column:
    """The substring to look for in a marked text, as ``functions.words.to_find``."""
    before = F.when(_starts_in_word(term), "").otherwise(MARK)
    after = F.when(_ends_in_word(term), "").otherwise(MARK)
    return F.concat(before, put_marks(term), after)


def _pattern(term: Column) -> Column:
    """A term with punctuation at an edge as a pattern: there a word must be next to it."""
    before = F.when(_starts_in_word(term), f"(?<!{WORD_CHAR})").otherwise(f"(?<={WORD_CHAR})")
    after = F.when(_ends_in_word(term), f"(?!{WORD_CHAR})").otherwise(f"(?={WORD_CHAR})")
    return F.concat(before, F.regexp_replace(term, r"([^\p{L}\p{N}_])", r"\\$1"), after)


def _filed(terms: DataFrame) -> DataFrame:
    """Add ``key``, the word of ``term`` that fewest terms contain, or its first character if it has no word."""
    words = terms.select("no", F.explode(F.array_distinct(_words(F.col("term")))).alias("word"))
    uses = words.groupBy("word").agg(F.count("*").alias("uses"))
    rarest = words.join(uses, "word").groupBy("no").agg(F.min(F.struct("uses", "word")).alias("rarest")).select("no", "rarest.word")
    filed = terms.join(rarest, "no", "left").withColumn("key", F.coalesce("word", F.substring("term", 1, 1)))
    return filed.drop("word")


def _rules(tables: RuleTables, case_sensitive: bool) -> DataFrame:
    """(no, key, find, put, introduced, pattern, plain, word, becomes): pattern and plain for terms with punctuation at an edge,
    word and becomes for rules from one word to one word."""
    fold = F.col if case_sensitive else F.lower
    terms = tables.rules.select(F.col("rule_no").alias("no"), _checked(fold("synonym")).alias("term"), fold("canonical").alias("canonical"))
    edge = ~(_starts_in_word(F.col("term")) & _ends_in_word(F.col("term")))
    return materialise(
        _filed(terms).select(
            "no",
            "key",
            _find(F.col("term")).alias("find"),
            put_marks(F.col("canonical")).alias("put"),
            _keys(F.col("canonical")).alias("introduced"),
            F.when(edge, _pattern(F.col("term"))).alias("pattern"),
            F.when(edge, F.regexp_replace("canonical", r"([\\$])", r"\\$1")).alias("plain"),
            F.when(_is_word(F.col("term")) & _is_word(F.col("canonical")), F.col("term")).alias("word"),
            F.col("canonical").alias("becomes"),
        ),
        "rules",
    )


def _step(marked: Column, rule: Column) -> Column:
    beside = put_marks(F.regexp_replace(drop_marks(marked), rule.pattern, rule.plain))
    apart = F.replace(marked, rule.find, rule.put)
    return F.when(~F.contains(marked, rule.find), marked).when(rule.pattern.isNull(), apart).otherwise(beside)


def _with_rules(texts: DataFrame, candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Add to each text its candidate rules in order; no more than it has words, times the terms of a word."""
    steps = candidates.join(rules.select("no", "find", "put", "pattern", "plain"), "no").groupBy(_ROW)
    listed = steps.agg(F.array_sort(F.collect_list(F.struct("no", "find", "put", "pattern", "plain"))).alias("steps"))
    return texts.join(listed, _ROW, "left")


def _rewritten(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, marked): the marked text after all rules."""
    seen = texts.select(_ROW, F.explode(_keys(F.col("text"))).alias("key"))
    candidates = materialise(seen.join(rules.select("key", "no"), "key").select(_ROW, "no").distinct(), "candidates")
    edges = rules.where("pattern IS NOT NULL").select("no")
    has_edges = not edges.isEmpty()
    new = candidates
    while True:
        words = new.join(rules.select("no", F.explode("introduced").alias("key")), "no").select(_ROW, "key")
        if has_edges:
            # what such a rule puts in may join the words beside it, so these texts are looked at after each of them
            some = new.join(edges, "no", "left_semi").select(_ROW).distinct()
            shown = _with_rules(texts.join(some, _ROW, "left_semi"), candidates, rules)
            start = F.struct(put_marks(F.col("text")).alias("marked"), F.expr("array()").cast("array<string>").alias("keys"))

            def look(state: Column, rule: Column) -> Column:
                after = _step(state.marked, rule)
                more = F.when(rule.pattern.isNotNull() & (after != state.marked), F.array_union(state["keys"], _keys(drop_marks(after))))
                return F.struct(after.alias("marked"), more.otherwise(state["keys"]).alias("keys"))

            last = shown.select(_ROW, F.aggregate("steps", start, look).alias("last"))
            words = words.unionByName(last.select(_ROW, F.explode("last.keys").alias("key")))
        woken = words.distinct().join(rules.select("key", "no"), "key").select(_ROW, "no").distinct()
        new = materialise(woken.join(candidates, [_ROW, "no"], "left_anti"), "candidates")
        if new.isEmpty():
            break
        candidates = candidates.unionByName(new)
    steps = _with_rules(texts, candidates, rules)
    marked = F.aggregate("steps", put_marks(F.col("text")), _step)
    return steps.select(_ROW, F.coalesce(F.when(F.col("steps").isNotNull(), marked), put_marks(F.col("text"))).alias("marked"))


def _ways(rules: DataFrame, special: DataFrame) -> DataFrame:
    """(key, becomes, special): what rules from word to word make of a key, if anything, and whether it is, or on its way
    becomes, one of the ``special`` keys."""
    simple = rules.where("word IS NOT NULL").select("no", "word", "becomes")
    marked = special.select(F.col("key").alias("becomes"), F.lit(True).alias("special"))
    # The next rule for what a rule puts in is the first later one for that word.
    ends = simple.select(F.col("becomes").alias("at"), "no", F.lit(False).alias("starts"))
    both = ends.unionByName(simple.select(F.col("word").alias("at"), "no", F.lit(True).alias("starts")))
    later = W.partitionBy("at").orderBy(F.desc("no")).rangeBetween(W.unboundedPreceding, -1)
    following = both.withColumn("next", F.min(F.when(F.col("starts"), F.col("no"))).over(later)).where("NOT starts").select("no", "next")
    ways = simple.join(following, "no").join(marked, "becomes", "left").fillna(False, ["special"])
    ways = materialise(ways.select("no", "word", "becomes", "next", "special"), "ways")
    while not ways.where("next IS NOT NULL").isEmpty():
        # each way goes on where the way of its next rule ends, so the steps double
        then = ways.select(F.col("no").alias("next"), F.struct("becomes", "next", "special").alias("then"))
        on = ways.join(then, "next", "left")
        ways = materialise(
            on.select(
                "no",
                "word",
                F.coalesce("then.becomes", "becomes").alias("becomes"),
                F.col("then.next").alias("next"),
                (F.col("special") | F.coalesce("then.special", F.lit(False))).alias("special"),
            ),
            "ways",
        )
    first = ways.groupBy("word").agg(F.min_by(F.struct("becomes", "special"), "no").alias("way"))
    named = first.select(F.col("word").alias("key"), "way.becomes", "way.special")
    itself = special.select("key", F.lit(True).alias("itself"))
    all_keys = named.join(itself, "key", "full_outer").withColumn("special", F.coalesce("itself", "special"))
    return all_keys.select("key", F.coalesce("becomes", "key").alias("becomes"), "special")


def _portions(texts: DataFrame) -> list[DataFrame]:
    """The texts in runs of about PORTION_BYTES. The number of a row begins with that of its partition, 33 bits before the end."""
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")
    parts = texts.groupBy(F.shiftright(_ROW, 33).alias("part")).agg(size).orderBy("part").collect()
    starts, held = [], 0
    for row in parts:
        if not starts or held + row["size"] > PORTION_BYTES:
            starts.append(row["part"])
            held = 0
        held += row["size"]
    if len(starts) < 2:
        return [texts]
    ends = [*starts[1:], parts[-1]["part"] + 1]
    return [texts.where((F.col(_ROW) >= start << 33) & (F.col(_ROW) < end << 33)) for start, end in zip(starts, ends)]


def _met(texts: DataFrame, special: DataFrame, meanings: DataFrame, entry: Column) -> DataFrame:
    """(row, special, entries): whether a text meets a special key, and the distinct entries that its keys lead to.

    A text and a word are a row of the first shuffle, a text's entries of the second. The shuffles of a portion are deleted
    before the next one begins, so what they take does not grow with the texts.
    """
    # characters outside of words are looked up only if there is a term without a word
    keys = _words if special.where(~_is_word(F.col("key"))).isEmpty() else _keys
    entries = F.collect_set(F.when(entry.isNotNull(), entry)).alias("entries")

    def met(portion: DataFrame) -> DataFrame:
        seen = portion.select(_ROW, F.explode(F.array_distinct(keys(F.col("text")))).alias("key"))
        return materialise(seen.join(meanings, "key").groupBy(_ROW).agg(F.max("special").alias("special"), entries), "met")

    return reduce(DataFrame.unionByName, [met(portion) for portion in _portions(texts)])


def _of(texts: DataFrame, met: DataFrame) -> DataFrame | None:
    """The texts that meet a special key."""
    rows = met.where("special").select(_ROW)
    return None if rows.isEmpty() else texts.join(rows, _ROW, "left_semi")


@F.pandas_udf(StringType())
def _put(marked: pd.Series, entries: pd.Series) -> pd.Series:
    """The escaped text with its words replaced, from the text with its words marked."""

    def rewrite(text: str, pairs) -> str:
        becomes = {pair["key"]: pair["becomes"] for pair in pairs}
        parts = text.split(MARK)  # between words, word, between words, ..., between words
        parts[1::2] = [becomes.get(word, word) for word in parts[1::2]]
        return "".join(parts)

    return pd.Series([rewrite(text, pairs) for text, pairs in zip(marked, entries)], dtype=object)


def _numbered(df: DataFrame, text: Column, case_sensitive: bool) -> tuple[DataFrame, DataFrame]:
    rows = materialise(df.select("*", F.monotonically_increasing_id().alias(_ROW)), "texts")
    folded = text if case_sensitive else F.lower(text)  # of the same columns as before, so texts are written once
    return rows, rows.select(_ROW, escape_marks(folded).alias("text")).where("text IS NOT NULL")


def canonicalise(df: DataFrame, text: Column, tables: RuleTables, output: str, case_sensitive: bool = False) -> DataFrame:
    rows, texts = _numbered(df, text, case_sensitive)
    rules = _rules(tables, case_sensitive)
    special = rules.where("word IS NULL").select("key").distinct()
    changed = materialise(_ways(rules, special).where("special OR becomes <> key"), "changed")
    met = _met(texts, special, changed, F.when(F.col("becomes") != F.col("key"), F.struct("key", "becomes")))
    plain = texts.join(met, _ROW, "left").where("special IS NULL OR NOT special")
    put = F.when(F.size("entries") > 0, _put(put_marks(F.col("text")), F.coalesce("entries", F.array()))).otherwise(F.col("text"))
    done = plain.select(_ROW, put.alias("marked"))
    if (others := _of(texts, met)) is not None:
        done = done.unionByName(_rewritten(others, rules))
    return rows.join(done.select(_ROW, unmark_words(F.col("marked")).alias(output)), _ROW, "left").drop(_ROW)


def _found_in_texts(texts: DataFrame, rules: DataFrame, skills: DataFrame, output: str) -> DataFrame:
    """(row, skills) of texts that are rewritten rule by rule."""
    marked = materialise(_rewritten(texts, rules), "marked")
    keys = marked.select(_ROW, F.explode(_keys(drop_marks(F.col("marked")))).alias("key"))
    possible = keys.join(skills.select("key", "skill", _find(F.col("term")).alias("find")), "key").groupBy(_ROW)
    listed = marked.join(possible.agg(F.collect_list(F.struct("skill", "find")).alias("terms")), _ROW)
    found = F.filter("terms", lambda t: F.contains(F.col("marked"), t.find))
    return listed.select(_ROW, F.array_sort(F.transform(found, lambda t: t.skill)).alias(output))


def extract_skills(df: DataFrame, text: Column, tables: RuleTables, output: str, case_sensitive: bool = False) -> DataFrame:
    rows, texts = _numbered(df, text, case_sensitive)
    rules = _rules(tables, case_sensitive)
    term = _checked(F.col("skill") if case_sensitive else F.lower("skill"))
    skills = materialise(_filed(tables.skills.select("skill", term.alias("term")).withColumn("no", F.col("skill"))), "skills")
    one_word = _is_word(F.col("term"))
    special = rules.where("word IS NULL").select("key").union(skills.where(~one_word).select("key")).distinct()
    # Skills that are the same word but for upper and lower case.
    of_word = skills.where(one_word).groupBy(F.col("term").alias("becomes")).agg(F.collect_list("skill").alias("skills"))
    ways = materialise(_ways(rules, special), "all-ways")
    unchanged = of_word.join(ways, of_word["becomes"] == ways["key"], "left_anti")
    stays = unchanged.select(F.col("becomes").alias("key"), "becomes", F.lit(False).alias("special"))
    meanings = ways.unionByName(stays).join(of_word, "becomes", "left").where("special OR skills IS NOT NULL")
    named_keys = meanings.select("key", "special", F.explode_outer("skills").alias("skill"))  # a skill belongs to one word
    met = _met(texts, special, materialise(named_keys, "meanings"), F.col("skill"))
    named = met.where("NOT special").select(_ROW, F.array_sort("entries").alias(output))
    if (others := _of(texts, met)) is not None:
        named = named.unionByName(_found_in_texts(others, rules, skills, output))
    return rows.join(named, _ROW, "left").withColumn(output, F.coalesce(output, F.expr("array()").cast("array<string>"))).drop(_ROW)
