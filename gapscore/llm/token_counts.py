"""Token counts of texts: each distinct pre-token is cut into pieces once, and its count joins the documents'."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.llm.work import Scratch

#: At most so many frequent pre-tokens of at most so many characters go to every worker; the rest are joined.
FREQUENT = 100_000
FREQUENT_CHARS = 64
#: Distinct pre-tokens that a task counts before it hands them on.
HELD = 200_000
#: Rows of one batch to Spark.
_ROWS = 50_000

_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
# Latin letters and general punctuation: characters that no neighbour changes under NFC or lower case.
_PLAIN = "\x00-˿‐-‧‰-⁞₠-₿"


def _class_of(kind: str) -> str:
    """A character class of the letters or numbers that plain text has after lower case."""
    lower = sorted({c for point in range(0x300) for c in chr(point).lower()})
    return "".join(re.escape(c) for c in lower if unicodedata.category(c).startswith(kind))


class PreTokens:
    """Cuts texts into pre-tokens as the tokenizer file does, and counts the pieces of one.

    For words of plain characters the file's pattern is put as one for ``re``, which is several times faster;
    a word with any other character goes through the file's own normalizer and pre-tokenizer. Pre-tokens never
    hold white space, and neither NFC nor lower case looks across it, so words can be taken one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters, numbers = _class_of("L"), _class_of("N")
        spaces = "\\t-\\r \x85\xa0 "
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        self.odd = re.compile(f"[^{_PLAIN}]").search
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.cut_odd = functools.lru_cache(maxsize=100_000)(self._cut_by_library)

    def _cut_by_library(self, word: str) -> list[str]:
        # the byte-level step maps bytes to letters and moves no border, so borders are taken before it
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [normal[start:end] for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The pre-tokens of a text with their counts, and the number of added tokens in it."""
        found, n_added = Counter(), 0
        parts = [text]
        if self.added and "<|" in text:
            parts = self.added.split(text)
            n_added = len(parts) - 1
        for part in parts:
            if not self.odd(part):
                found.update(self.plain(part.lower()))
                continue
            words = Counter(_SPACE.split(part))
            plain = [w for w in words if not self.odd(w)]
            for word in plain:
                for token in self.plain(word.lower()):
                    found[token] += words[word]
            for word in words.keys() - set(plain):
                for token in self.cut_odd(word):
                    found[token] += words[word]
        return found, n_added

    def pieces(self, token: str) -> int:
        """The number of pieces of one pre-token."""
        return sum(len(self.tokenizer.model.tokenize(t)) for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(token))


@functools.cache
def pre_tokens(path: str) -> PreTokens:
    """One for each worker process and file."""
    return PreTokens(path)


def _distinct(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, n): pre-tokens with the number of documents, pre-aggregated in the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = pre_tokens(path), Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(seen.items())
            for i in range(0, len(words), _ROWS):
                word, n = zip(*words[i : i + _ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update(of.frequencies(text.as_py())[0].keys())
                if len(seen) >= HELD:
                    yield from rows()
        yield from rows()

    return count


def _priced(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pre_tokens(path)
        for batch in batches:
            pieces = pa.array([of.pieces(word) for word in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["word", "n", "pieces"])

    return price


def _frequent(pieces: DataFrame, limit: int) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens, ``limit`` at most: all that occur in 2^k or more documents."""
    short = pieces.where(F.length("word") <= FREQUENT_CHARS)
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = dict(short.groupBy(power).count().collect())
    taken, least = 0, None
    for k in sorted(sizes, reverse=True):
        taken += sizes[k]
        if taken > limit:
            break
        least = k
    if least is None:
        return {}
    rows = short.where(F.col("n") >= F.lit(2**least).cast("long")).select("word", "pieces").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    text: str = "text",
    doc_id: str = "doc_id",
    frequent: int = FREQUENT,
) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``tokenizer_path`` is a file of ``tokenizers`` whose pre-tokens are letter runs, single numbers and other runs.
    The documents are cut into pre-tokens twice. First every distinct pre-token of the table is found and its
    pieces are counted, once. Then each document's frequencies are multiplied with these counts: the most frequent
    pre-tokens (``frequent`` at most) by a table in each worker, all others by a shuffled join on the pre-token,
    in which no key is hot, as the frequent ones are not in it. Ids are never listed for a document.
    An added token in a text counts as one.

    Defined cases: null and empty texts have 0 bytes and 0 tokens; a long text is one row like any other;
    rows that repeat an id are counted one by one; a null id stays null; other columns are ignored, also under the
    names used here; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "token_counts")
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    seen = own.select("text").mapInArrow(_distinct(tokenizer_path), "word string, n long")
    counted = seen.groupBy("word").agg(F.sum("n").alias("n"))
    pieces = scratch.keep(counted.mapInArrow(_priced(tokenizer_path), "word string, n long, pieces long"), "pieces")
    known = spark.sparkContext.broadcast(_frequent(pieces, frequent))
    names = ["no", "doc_id", "n_bytes", "n", "word"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the sum of the frequent pre-tokens for each document, and a row for each other pre-token."""
        of, table = pre_tokens(tokenizer_path), known.value
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            first, sums, rare = no, [], []
            for value in batch.column(2):
                found, total = of.frequencies(value.as_py())
                for word, n in found.items():
                    if (count := table.get(word)) is None:
                        rare.append((no, n, word))
                    else:
                        total += n * count
                sums.append(total)
                no += 1
            numbers, n = pa.array(range(first, no), pa.int64()), pa.array(sums, pa.int64())
            without = pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), batch.column(1), n, without], names)
            for i in range(0, len(rare), _ROWS):
                numbers, n, words = (list(column) for column in zip(*rare[i : i + _ROWS]))
                no_id, no_bytes = pa.nulls(len(words), batch.column(0).type), pa.nulls(len(words), pa.int64())
                columns = [pa.array(numbers, pa.int64()), no_id, no_bytes, pa.array(n, pa.int64()), pa.array(words, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = own.schema["doc_id"].dataType.simpleString()
    parts = scratch.keep(own.mapInArrow(split, f"no long, doc_id {id_type}, n_bytes long, n long, word string"), "parts")
    rare = parts.where("word IS NOT NULL").join(pieces.select("word", "pieces"), "word")
    rare = rare.select("no", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), F.expr("n * pieces AS n"))
    sums = parts.where("word IS NULL").drop("word").unionByName(rare).groupBy("no")
    counts = sums.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
