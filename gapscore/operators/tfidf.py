"""Vocabulary fit and TF-IDF weights."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from gapscore.functions.text import ascii_words, tokens
from gapscore.storage import materialise, small_side

# The vectorizer's settings.
MAX_FEATURES = 5000
MIN_DF = 1
MAX_DF = 0.8

# A vocabulary travels to every executor.
MAX_VOCABULARY = 1_000_000

# Frequent words that travel to every task which counts pairs; more are joined.
MAX_KNOWN = 200_000

# Words whose counts a task adds up at once, and bytes of text for each.
COUNTED = 1 << 21
TEXT_BYTES = 8

# Terms whose counts a task holds back, to send each of them once.
HELD_BYTES = 1 << 25


def kept_tokens(text: Column, stop_words: list[str]) -> Column:
    """Tokens without stop words. Removal comes first, so word pairs span removed words."""
    words = tokens(text)
    return F.filter(words, lambda word: ~word.isin(*stop_words)) if stop_words else words


def word_pairs(words: Column) -> Column:
    """Each word with its successor, joined by a space."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.concat(a, F.lit(" "), b))


def terms(df: DataFrame, column: str, stop_words: list[str], output: str = "terms") -> DataFrame:
    """Add the single words and word pairs of a text."""
    words = df.withColumn("_words", kept_tokens(F.col(column), stop_words))
    return words.withColumn(output, F.concat("_words", word_pairs(F.col("_words")))).drop("_words")


_INSIDE = bytes(chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789_" for i in range(256))
_OUTSIDE = bytes(i for i in range(256) if not _INSIDE[i])


def text_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, run): the runs of a-z, 0-9 and underscores in each text, in its order. The texts come from ``ascii_words``."""
    # A space after each text, so that no word goes on into the next one.
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), empty), empty, space)
    ends = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    body = spaced.buffers()[2]
    data = memoryview(body)[ends[0] : ends[-1]].tobytes() if body else b""
    inside = np.frombuffer(b"\0" + data.translate(_INSIDE), dtype=np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data.translate(None, _OUTSIDE)))
    return np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.searchsorted(starts, ends - ends[0]))), runs


def _are_tokens(runs: pa.Array) -> np.ndarray:
    """Which runs are what ``tokens`` finds: those that start with a letter and have no underscore."""
    first = pc.binary_slice(runs.cast(pa.binary()), 0, 1)
    letter = pc.greater_equal(first, pa.scalar(b"a"))  # digits and the underscore come before the letters
    return pc.and_not(letter, pc.match_substring(runs, "_")).to_numpy(zero_copy_only=False)


def _is_list(column: pa.Array) -> bool:
    return pa.types.is_list(column.type) or pa.types.is_large_list(column.type)


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about COUNTED elements, or as many bytes of text as fit them, each with the number of its first row."""
    sizes = pc.list_value_length(column) if _is_list(column) else pc.divide(pc.binary_length(column).cast(pa.int64()), TEXT_BYTES)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // COUNTED)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(column)]):
        yield start, column.slice(start, end - start)


def _numbered(column: pa.Array, stop_words: list[str] | tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): the elements of each array, or the kept tokens of each text, in their order, as numbers of words."""
    if _is_list(column):
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        row, found = np.repeat(np.arange(len(column), dtype=np.int64), lengths), column.flatten()
    else:
        row, found = text_runs(column)
    # Runs are told apart once they are numbered: each kind is looked at once.
    coded = found.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    kept = None
    if not _is_list(column):
        words = words.cast(pa.string())
        kept = _are_tokens(words)
    if stop_words:
        others = ~pc.is_in(words, value_set=pa.array(stop_words, words.type)).to_numpy(zero_copy_only=False)
        kept = others if kept is None else kept & others
    if kept is not None and not kept.all():
        chosen = kept[code]
        number = np.cumsum(kept) - 1
        row, code, words = row[chosen], number[code[chosen]], words.filter(pa.array(kept))
    return row, code, words


def _counted(
    column: pa.Array, pairs: bool, known: pa.Array | None, stop_words: list[str] | tuple[str, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """(row, term, tf) for the distinct elements of each array, or for its neighbours, and what names the terms.

    Elements are numbered, so equal ones are found by sorting numbers. Both words of a pair must be ``known``, whose places
    then number the pairs. A text stands for its kept tokens.
    """
    row, code, words = _numbered(column, stop_words)
    n = max(1, len(words))
    name = lambda term: words.take(pa.array(term))
    if pairs:
        beside = row[1:] == row[:-1]
        if known is not None:
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code, words, n = place[code], known, max(1, len(known))
            beside &= (code[1:] >= 0) & (code[:-1] >= 0)
        row, code = row[:-1][beside], code[:-1][beside] * n + code[1:][beside]
        name = lambda term: pc.binary_join_element_wise(words.take(pa.array(term // n)), words.take(pa.array(term % n)), " ")
    bits = len(column).bit_length()
    key = np.sort(code << bits | row)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(first, append=len(key))
    return key[first] & ((1 << bits) - 1), key[first] >> bits, tf, name


def _countable(df: DataFrame, column: str) -> Column:
    """A column of arrays as it is, one of texts as what tasks read."""
    return F.col(column) if isinstance(df.select(column).schema[0].dataType, ArrayType) else ascii_words(F.col(column))


def count_within(
    df: DataFrame, column: str, keys: list[str], with_pairs: bool = False, stop_words: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Rows ``(*keys, term, tf)``: how often each term occurs in the array or text of its own row, and each pair of neighbours if asked.

    Counting needs no shuffle, and what leaves the row is one entry per distinct term.
    """
    listed = df.select(_countable(df, column).alias("_list"), *keys)
    out = StructType([*listed.schema.fields[1:], StructField("term", StringType()), StructField("tf", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in _parts(batch.column(0)):
                for pairs in (False, True)[: 1 + with_pairs]:
                    row, term, tf, name = _counted(part, pairs, None, stop_words)
                    at = pa.array(row + start)
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), name(term), pa.array(tf)], out.names)

    return listed.mapInArrow(count, out)


def _sums(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Each term once, with its counts over all parts."""
    if len(parts) == 1:
        return parts[0]
    coded = pa.concat_arrays([term for term, *_ in parts]).dictionary_encode()
    place, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    # Counts below 2**53 are whole as floats.
    return coded.dictionary, *(np.bincount(place, np.concatenate([part[i] for part in parts]), n).astype(np.int64) for i in (1, 2))


def _added_up(parts: Iterable[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Parts ``(term, tf, rows)`` put together while their terms take no more than HELD_BYTES."""
    held, size = [], 0
    for part in parts:
        if part[0].nbytes >= HELD_BYTES:
            yield part
            continue
        held.append(part)
        size += part[0].nbytes
        if size >= HELD_BYTES:
            held = [_sums(held)]
            size = held[0][0].nbytes
            if size >= HELD_BYTES // 2:
                yield held.pop()
                size = 0
    if held:
        yield _sums(held)


def corpus_counts(
    df: DataFrame, column: str, pairs: bool | None = False, known: pa.Array | None = None, stop_words: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Rows ``(term, corpus_tf, df)`` over all arrays or texts of a column, of its elements, of its pairs of neighbours, or of both (None).

    A task adds up the counts of its rows before they are shuffled. Pairs of ``known`` words are shuffled as numbers.
    """
    by_number = bool(pairs) and known is not None

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                for kind in (False, True) if pairs is None else (pairs,):
                    _, term, tf, name = _counted(part, kind, known if kind else None, stop_words)
                    first = np.flatnonzero(np.diff(term, prepend=-1))
                    rows = np.diff(first, append=len(term))
                    total = np.add.reduceat(tf, first) if len(first) else tf
                    yield pa.array(term[first]) if by_number else name(term[first]), total, rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for term, tf, rows in _added_up(parts(batches)):
            yield pa.RecordBatch.from_arrays([term, pa.array(tf), pa.array(rows)], ["term", "tf", "rows"])

    counted = df.select(_countable(df, column).alias(column)).mapInArrow(count, f"term {'long' if by_number else 'string'}, tf long, rows long")
    counts = counted.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.sum("rows").alias("df"))
    if not by_number:
        return counts
    numbers = pa.table([pa.array(range(len(known)), pa.int64()), known.cast(pa.string())], ["_place", "_word"])
    words = F.broadcast(df.sparkSession.createDataFrame(numbers, "_place long, _word string"))
    for side, place in (("_a", F.expr(f"term div {len(known)}")), ("_b", F.col("term") % len(known))):
        word = words.select(F.col("_place").alias(f"{side}_place"), F.col("_word").alias(side))
        counts = counts.join(word, place == F.col(f"{side}_place"))
    return counts.select(F.concat_ws(" ", "_a", "_b").alias("term"), "corpus_tf", "df")


def term_counts(df: DataFrame, column: str, stop_words: list[str], keys: list[str]) -> DataFrame:
    """Rows ``(*keys, term, tf)``: the words and word pairs of each text with their counts."""
    return count_within(df.select(*keys, F.col(column).alias("_text")), "_text", keys, True, stop_words)


def by_term(counts: DataFrame) -> DataFrame:
    """Frequency in the corpus and number of texts per term, from counts within texts."""
    return counts.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.count("*").alias("df"))


def fit_vocabulary(
    texts: DataFrame,
    column: str,
    stop_words: list[str],
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """The ``max_features`` most frequent words and word pairs, with their idf.

    Words are counted first. A pair cannot be more frequent than either of its words, so only
    pairs of words that reach the frequency of the last single word inside the limit can enter.
    That keeps the second count, of pairs, to a few thousand words instead of every pair in the
    corpus, and the result is the same.
    """
    texts = texts.filter(F.col(column).isNotNull())
    n = texts.count()
    single = materialise(corpus_counts(texts, column, stop_words=stop_words), "word-counts")
    eligible = _eligible(n, min_df, max_df)
    floor = _floor(single.filter(eligible), max_features)

    known, frequent = None, single.filter(F.col("corpus_tf") >= floor).select("term")
    if floor > 1 and (side := small_side(frequent, MAX_KNOWN)) is not frequent:
        known = side.toArrow().column(0).combine_chunks()
    pairs = corpus_counts(texts, column, True, known, stop_words)
    if known is not None:
        pairs = pairs.filter(F.col("corpus_tf") >= floor)  # a rarer one comes after all words inside the limit
    if floor > 1 and known is None:
        for place in (1, -1):
            word = frequent.withColumnRenamed("term", "_word")
            pairs = pairs.join(word, F.substring_index("term", " ", place) == F.col("_word"), "left_semi")
    return ranked_vocabulary(single.unionByName(pairs), n, max_features, min_df, max_df)


def _floor(eligible_words: DataFrame, max_features: int) -> int:
    """The frequency of the last single word inside the limit; a rarer pair comes after all of them."""
    top = eligible_words.orderBy(F.desc("corpus_tf"), "term").limit(max_features)
    last = top.agg(F.count("*").alias("words"), F.min("corpus_tf").alias("floor")).first()
    return last.floor if last.words == max_features else 1


def ranked_parts(counts: DataFrame, n: int, max_features: int, min_df: int, max_df: float) -> DataFrame:
    """``ranked_vocabulary`` of counts whose terms occur once for each of several parts of the texts.

    Words are added up first, and pairs only of words that reach the frequency of the last one inside the limit.
    """
    added = lambda df: df.groupBy("term").agg(F.sum("corpus_tf").alias("corpus_tf"), F.sum("df").alias("df"))
    is_pair = F.contains("term", F.lit(" "))
    single = materialise(added(counts.filter(~is_pair)), "word-counts")
    floor = _floor(single.filter(_eligible(n, min_df, max_df)), max_features)
    pairs = counts.filter(is_pair)
    if floor > 1:
        frequent = small_side(single.filter(F.col("corpus_tf") >= floor).select(F.col("term").alias("_word")), MAX_KNOWN)
        for place in (1, -1):
            pairs = pairs.join(frequent, F.substring_index("term", " ", place) == F.col("_word"), "left_semi")
    return ranked_vocabulary(single.unionByName(added(pairs)), n, max_features, min_df, max_df)


def _eligible(n: int, min_df: int, max_df: float) -> Column:
    return (F.col("df") >= min_df) & (F.col("df") <= max_df * n)


def ranked_vocabulary(counts: DataFrame, n: int, max_features: int, min_df: int, max_df: float) -> DataFrame:
    """The most frequent terms of ``(term, corpus_tf, df)`` counts over ``n`` texts, numbered by alphabet, with their idf."""
    chosen = counts.filter(_eligible(n, min_df, max_df)).orderBy(F.desc("corpus_tf"), "term").limit(max_features)
    # At most max_features rows are numbered here.
    numbered = chosen.withColumn("term_id", F.row_number().over(W.orderBy("term")) - 1)
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    return numbered.select("term", "term_id", "corpus_tf", "df", idf.alias("idf"))


@dataclass(frozen=True)
class Vocabulary:
    """The fitted terms by position, their idf, and the stop words they were fitted with."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    stop_words: tuple[str, ...] = ()


def load_vocabulary(vocabulary: DataFrame, stop_words: list[str]) -> Vocabulary:
    rows = vocabulary.select("term_id", "term", "idf").take(MAX_VOCABULARY + 1)
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary exceeds {MAX_VOCABULARY} terms")
    rows.sort(key=lambda row: row.term_id)
    if [row.term_id for row in rows] != list(range(len(rows))):
        raise ValueError("term_id must number the terms from 0 without gaps")
    return Vocabulary(tuple(r.term for r in rows), tuple(r.idf for r in rows), tuple(stop_words))


def tfidf(df: DataFrame, column: str, vocabulary: Vocabulary) -> DataFrame:
    """Add ``indices`` and ``weights``: the document's terms and their L2-normalised weights.

    Everything happens within the row, so no shuffle is needed.
    """
    counter = CountVectorizerModel.from_vocabulary(list(vocabulary.terms), inputCol="_terms", outputCol="_tf")
    idf = F.from_json(F.lit(json.dumps(vocabulary.idf)), "array<double>")
    listed = terms(df, column, list(vocabulary.stop_words), "_terms")
    nothing = F.expr("array()").cast("array<string>")  # a null text has no terms
    counted = counter.transform(listed.withColumn("_terms", F.coalesce("_terms", nothing)))
    raw = counted.withColumn("_tf", F.unwrap_udt("_tf")).withColumns(
        {
            "indices": F.col("_tf.indices"),
            "_raw": F.zip_with(
                "_tf.indices", "_tf.values", lambda i, tf: (1 + F.log(tf)) * F.get(idf, i)
            ),
        }
    )
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, w: total + w * w))
    # The norm enters through an array of one; inside the inner function it would be computed
    # again for every term.
    weights = F.transform(F.array(norm), lambda length: F.transform("_raw", lambda w: w / length))
    return raw.withColumn("weights", F.get(weights, 0)).drop("_terms", "_tf", "_raw")


class _Places:
    """Where the terms of a list are, for words that are numbered anew in each part."""

    def __init__(self, terms: Iterable[str], stop_words: Iterable[str]):
        place = {term: i for i, term in enumerate(terms)}
        pairs = [(*term.split(" "), i) for term, i in place.items() if term.count(" ") == 1]
        self.terms, self.places = pa.array(place, pa.string()), np.array([*place.values(), -1], dtype=np.int64)
        self.first, self.second = (pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))
        self.pairs = np.array([p[2] for p in pairs], dtype=np.int64)
        self.size, self.stop_words = max(1, len(self.places)), list(stop_words)

    def _pairs(self, row: np.ndarray, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the neighbours that are a term."""
        a, b = (pc.fill_null(pc.index_in(side, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for side in (self.first, self.second))
        met = np.flatnonzero((a >= 0) & (b >= 0))
        n = max(1, len(words))
        key = a[met] * n + b[met]
        order = np.argsort(key)
        key, place = np.append(key[order], -1), self.pairs[met[order]]
        starts, follows = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        starts[a[met]], follows[b[met]] = True, True
        at = np.flatnonzero((row[1:] == row[:-1]) & starts[code[:-1]] & follows[code[1:]])
        pair = code[at] * n + code[at + 1]
        found = np.searchsorted(key[:-1], pair)
        hit = key[found] == pair
        return row[at[hit]], place[found[hit]]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, tf) of the terms in the texts, by row and place."""
        row, code, words = _numbered(texts, self.stop_words)
        single = self.places[pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False)][code]
        known = single >= 0
        pair_row, pair = self._pairs(row, code, words)
        key = np.sort(np.concatenate([row[known] * self.size + single[known], pair_row * self.size + pair]))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] // self.size, key[first] % self.size, np.diff(first, append=len(key))


def known_counts(df: DataFrame, column: str, stop_words: list[str], keys: list[str], known: list[str]) -> DataFrame:
    """Rows ``(*keys, place, tf)``: ``term_counts`` of the ``known`` terms only, by their place in that list."""
    texts = df.select(ascii_words(F.col(column)).alias("_text"), *keys)
    out = StructType([*texts.schema.fields[1:], StructField("place", LongType()), StructField("tf", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(known, stop_words)
        for batch in batches:
            for start, part in _parts(batch.column(0)):
                row, place, tf = places.counts(part)
                at = pa.array(row + start)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), pa.array(place), pa.array(tf)], out.names)

    return texts.mapInArrow(count, out)


def tfidf_batches(df: DataFrame, column: str, vocabulary: Vocabulary, listed: bool = True) -> DataFrame:
    """``indices`` and ``weights`` as of ``tfidf`` beside the other columns, for many rows at once; or rows ``(term_id, weight)``.

    For jobs that read a table as a whole. It costs less than built-in expressions, which scores keep to, and needs no shuffle either.
    """
    keys = [c for c in df.columns if c != column]
    texts = df.select(ascii_words(F.col(column)).alias("_text"), *keys)
    types = (ArrayType(IntegerType(), False), ArrayType(DoubleType(), False)) if listed else (IntegerType(), DoubleType())
    out = StructType([*texts.schema.fields[1:], *map(StructField, ("indices", "weights") if listed else ("term_id", "weight"), types)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf = _Places(vocabulary.terms, vocabulary.stop_words), np.array(vocabulary.idf, dtype=float)
        for batch in batches:
            for start, part in _parts(batch.column(0)):
                row, place, tf = places.counts(part)
                raw = (1 + np.log(tf)) * idf[place]
                weight = raw / np.sqrt(np.bincount(row, raw * raw, len(part)))[row]
                found = [pa.array(place.astype(np.int32)), pa.array(weight)]
                at = row
                if listed:
                    at = np.arange(len(part))
                    ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                    found = [pa.ListArray.from_arrays(ends, values) for values in found]
                rows = pa.array(at + start)
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), *found], out.names)

    return texts.mapInArrow(weigh, out)


def tfidf_rows(df: DataFrame, column: str, vocabulary: Vocabulary, keys: list[str]) -> DataFrame:
    """TF-IDF as rows ``(*keys, term_id, weight)``."""
    return tfidf_batches(df.select(*keys, F.col(column).alias("_weighed")), "_weighed", vocabulary, listed=False)
