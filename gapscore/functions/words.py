"""Whole-word matching without a regular expression per dictionary term.

Every word of a text is put between two marks once. A dictionary term, marked the same way,
then occurs as a plain substring exactly where the term stands on word boundaries: a search is
``contains`` and a rewrite is ``replace``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapscore.functions.text import WORD_CHAR

MARK, ESCAPE = "\u0001", "\u0002"
# A mark or an escape in a text stands as two characters, neither of them in a word.
_ESCAPED = ((ESCAPE, ESCAPE + "\u0004"), (MARK, ESCAPE + "\u0003"))
_RESERVED = frozenset("\u0001\u0002\u0003\u0004")

_WORD = re.compile(r"\w+")


def check_term(term: str) -> str:
    """Terms must be non-empty and free of the marks and of what stands for them."""
    if not term or _RESERVED & set(term):
        raise ValueError(f"not usable as a dictionary term: {term!r}")
    return term


def words_of(term: str) -> list[str]:
    return _WORD.findall(term)


def has_word_edges(term: str) -> bool:
    """True when the term starts and ends with a word character."""
    return bool(_WORD.match(term[0]) and _WORD.match(term[-1]))


def with_marks(term: str) -> str:
    return _WORD.sub(lambda word: f"{MARK}{word.group()}{MARK}", term)


def to_find(term: str) -> str:
    """The substring to look for in a marked text.

    A boundary next to a punctuation edge needs a word on its other side, so ``c++`` is found
    only when a word follows at once and ``.net`` only when a word precedes at once.
    """
    before = "" if _WORD.match(term[0]) else MARK
    after = "" if _WORD.match(term[-1]) else MARK
    return before + with_marks(term) + after


def escape(text: str) -> str:
    for char, stands in _ESCAPED:
        text = text.replace(char, stands)
    return text


def unescape(text: str) -> str:
    for char, stands in reversed(_ESCAPED):
        text = text.replace(stands, char)
    return text


def _replaced(text: Column, pairs) -> Column:
    out = text
    for find, put in pairs:
        out = F.replace(out, F.lit(find), F.lit(put))
    return out


def _has(text: Column, *chars: str) -> Column:
    return text.rlike("[" + "".join(chars) + "]")


def put_marks(escaped: Column) -> Column:
    """Mark every word of an escaped text."""
    return F.regexp_replace(escaped, WORD_CHAR + "++", f"{MARK}$0{MARK}")


def drop_marks(marked: Column) -> Column:
    """The escaped text again."""
    return F.replace(marked, F.lit(MARK), F.lit(""))


def escape_marks(text: Column) -> Column:
    return F.when(_has(text, MARK, ESCAPE), _replaced(text, _ESCAPED)).otherwise(text)


def mark_words(text: Column) -> Column:
    """Mark every word. Marks already present in the text are kept apart from these."""
    return put_marks(escape_marks(text))


def unmark_words(text: Column) -> Column:
    plain = drop_marks(text)
    return F.when(_has(plain, ESCAPE), _replaced(plain, [(stands, char) for char, stands in reversed(_ESCAPED)])).otherwise(plain)
