"""Spelling variants: words one edit apart, found by pivotal bigrams, and the frequent word that each stands for."""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.llm.work import Scratch

LETTERS = "[a-zÀ-ÿ]+"
#: One run in so many loses a code point before it is counted.
DAMAGED = 199
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is so many times as frequent as the word.
RATIO = 5

_GRAM = 2
_EDITS = 1
# With so many grams in a prefix, _EDITS + 1 of them are disjoint, and one edit leaves one of these whole.
_PREFIX = _GRAM * _EDITS + 1
#: (difference in length, shift of a gram) between a word and another one edit away.
_SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the letter runs of the texts, A-Z lower-cased, one in ``DAMAGED`` damaged.

    The run decides by the CRC-32 of its document's id and itself, so equal runs of a document fare alike.
    """
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.where(F.length("run") >= min_length).select("run", h.alias("h"))
    words = words.select(F.when(F.col("h") % DAMAGED == 0, without).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> list[tuple[str, int]]:
    """The bigrams of the words, rarest first, with their counts: at most 90 x 90, as the letters are 90."""
    places = F.expr(f"transform(sequence(1, length(word) - {_GRAM - 1}), i -> substring(word, i, {_GRAM}))")
    counts = words.select(F.explode(places).alias("gram")).groupBy("gram").count()
    return sorted((tuple(r) for r in counts.collect()), key=lambda r: (r[1], r[0]))


def disjoint(grams: list[tuple[int, int]], wanted: int) -> list[int]:
    """The ``wanted`` disjoint grams of least total weight among (place, weight), as indices.

    Dynamic programming over the grams by place: the best choice of k grams that ends before a place takes the
    gram there, after the best choice of k - 1 that ends ``_GRAM`` before it, or leaves it.
    """
    order = sorted(range(len(grams)), key=lambda i: grams[i][0])
    ends = [grams[i][0] for i in order]
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())] * (len(order) + 1)]
    for k in range(wanted):
        row: list[tuple[float, tuple[int, ...]]] = [(math.inf, ())]
        for j, i in enumerate(order):
            before = sum(end + _GRAM <= ends[j] for end in ends[:j])
            weight, chosen = best[k][before]
            taken = (weight + grams[i][1], (*chosen, i))
            row.append(min(row[-1], taken))
        best.append(row)
    return list(best[wanted][-1][1])


def _signatures(order: list[tuple[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each word the rows of its prefix (probe false) and of its pivots, where another word may have them (true)."""
    rank = {gram: i for i, (gram, _) in enumerate(order)}
    weight = [n for _, n in order]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = sorted((rank[word[i : i + _GRAM]], i) for i in range(len(word) - _GRAM + 1))
                last = grams[_PREFIX - 1][0]
                prefix = [g for g in grams if g[0] <= last]  # with all places of the last gram
                for gram, place in prefix:
                    rows.append((False, gram, place, len(word), last, word, n))
                for i in disjoint([(place, weight[gram]) for gram, place in prefix], _EDITS + 1):
                    gram, place = prefix[i]
                    for longer, shift in _SHIFTS:
                        rows.append((True, gram, place + shift, len(word) + longer, last, word, n))
            if rows:
                columns = [pa.array(column, t) for column, t in zip(zip(*rows), _SIGNATURE.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=_SIGNATURE)

    return sign


_SIGNATURE = pa.schema(
    [("probe", pa.bool_()), ("gram", pa.int32()), ("place", pa.int32()), ("len", pa.int32()), ("last", pa.int32()), ("word", pa.string()), ("n", pa.int64())]
)


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, other_n): each two words that differ by exactly one edit, in both directions.

    All words put their bigrams into one order, rarest first. Of two near words the one whose prefix ends first
    has a pivot in the other's prefix, at the same place or one beside it, so pairs are candidates only there.
    """
    order = gram_order(words)
    types = "probe boolean, gram int, place int, len int, last int, word string, n long"
    signatures = scratch.keep(words.select("word", "n").mapInArrow(_signatures(order), types), "signatures")
    key = ["gram", "place", "len"]
    probes = signatures.where("probe").select(*key, F.col("last").alias("last1"), F.col("word").alias("word1"), F.col("n").alias("n1"))
    prefixes = signatures.where("NOT probe").select(*key, "last", "word", "n")
    first: Column = (F.col("last1") < F.col("last")) | ((F.col("last1") == F.col("last")) & (F.col("word1") < F.col("word")))
    candidates = probes.join(prefixes, key).where(first)
    near = candidates.where(F.levenshtein("word1", "word", _EDITS) == 1).select("word1", "n1", "word", "n").distinct()
    near = scratch.keep(near, "near")
    sides = lambda a, b: near.select(
        F.col(f"word{a}").alias("word"), F.col(f"n{a}").alias("n"), F.col(f"word{b}").alias("other"), F.col(f"n{b}").alias("other_n")
    )
    return sides("1", "").unionByName(sides("", "1"))


def spelling_variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """A row for each frequent word: word, form, root, n, n_near and form_n.

    ``form`` is the near word of largest n (ties: the first in code-point order) if that is at least ``ratio`` times
    the word's n, else null; ``root`` is the last form of the chain, or the word itself. Forms grow by ``ratio`` at
    each step, so the chain's length follows from the largest n, and doubling its steps needs few joins.

    Defined cases: null and empty texts have no words; a long text is cut like any other; repeated rows
    count again; a null id takes part as an empty one; other columns are ignored; an empty table gives no rows.
    """
    if min_length < _PREFIX + _GRAM - 1:
        raise ValueError(f"words of less than {_PREFIX + _GRAM - 1} letters have no {_PREFIX} bigrams")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs, text, doc_id, min_length, min_count), "words")
    pairs = near_pairs(words, scratch)
    best = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    best = best.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.other").alias("form"), "n")
    has_form = F.col("form_n") >= ratio * F.col("n")
    best = scratch.keep(
        best.select("word", "n_near", F.when(has_form, F.col("form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n")), "best"
    )
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(max(largest / min_count, 1)) / math.log(ratio)) + 1  # edges of the longest chain, at least
    roots = best.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return (
        words.join(best, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form_n",
        )
    )
