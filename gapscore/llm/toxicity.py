"""Toxicity: embeddings of words and their character n-grams, averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.llm.features import mixed

#: Hash buckets of the embedding table, and the length of a vector.
BUCKETS = 1 << 17
DIM = 8
#: Character n-grams of a word, with marks at its ends.
SHORTEST, LONGEST = 3, 6
#: A text is read in windows of so many words, each beginning half a window after the last.
WINDOW = 16
#: The sample to learn from: documents of each label at most, of at most so many characters.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 2_000, 4_000, 50_000
#: How strongly the most toxic windows outweigh the others, at the end of the training and in scoring.
SHARPNESS = 8.0
EPOCHS = 80
RATE = 0.05
#: Decay of the embeddings, as the weight of their squares in the loss.
DECAY = 1e-5
SEED = 11
#: Word scores that a worker remembers.
REMEMBERED = 200_000
#: A worker scores texts of so many bytes together.
_CHUNK_BYTES = 1 << 21
#: Words of the sample that are added up together.
_CHUNK_WORDS = 1 << 14

_STRIP = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: bytes) -> list[bytes]:
    """The words in lower case; a word that repeats the one before it counts once."""
    words = text.lower().split()
    return [w for w, before in zip(words, [None, *words]) if w != before]


def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) for the n-grams of each word without the signs around it, and for the word."""
    marked = ["<" + (w.strip(_STRIP) or w).decode("utf-8", "replace") + ">" for w in words]
    if not marked:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    row = np.repeat(np.arange(len(marked)), sizes)
    start = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - start[row]).astype(np.uint64)
    whole = np.add.reduceat(mixed(codes * np.uint64(0x9E3779B97F4A7C15) + place), start)
    hashes, rows = [mixed(whole)], [np.arange(len(marked))]
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        if n >= SHORTEST:
            inside = row[: len(gram)] == row[n - 1 :]
            hashes.append(mixed(gram[inside] + np.uint64(n)))
            rows.append(row[: len(gram)][inside])
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(rows)


def _sorted_buckets(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some words at a time: the buckets word by word, where each word begins, and how many it has."""
    out = []
    for at in range(0, max(1, len(words)), _CHUNK_WORDS):
        flat, row = word_buckets(words[at : at + _CHUNK_WORDS] or [b""])
        size = np.bincount(row)
        out.append((flat[np.argsort(row, kind="stable")].astype(np.int32), np.cumsum(size) - size, size))
    return out


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the windows of a text of n words."""
    first = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
    return first, np.minimum(first + WINDOW, n)


def fit(texts: list[bytes], toxic: np.ndarray) -> dict:
    """Embeddings and softmax, learnt together.

    A word is the mean of its vectors, a window the mean of its words, and the document's logit is a mean over
    windows in which the more toxic ones weigh more; this sharpens during the training. All steps are linear
    in the embeddings, so one pass needs a number for each bucket and each word, and the gradient goes
    back the same way. Adam over the whole sample.
    """
    rng = np.random.default_rng(SEED)
    vocabulary: dict[bytes, int] = {}
    tokens, lengths = [], []
    for text in texts:
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        tokens.append(np.array(words, dtype=np.int32))
        lengths.append(len(words))
    parts = _sorted_buckets(list(vocabulary))
    tokens = np.concatenate([*tokens, np.empty(0, np.int32)]) if tokens else np.empty(0, np.int32)
    spans = [(_windows(n), i, base) for i, (n, base) in enumerate(zip(lengths, np.cumsum([0, *lengths[:-1]]))) if n]
    first = np.concatenate([[0], *(f + b for (f, _), _, b in spans)]).astype(np.int64)[1:]
    last = np.concatenate([[0], *(e + b for (_, e), _, b in spans)]).astype(np.int64)[1:]
    owner = np.concatenate([[0], *(np.full(len(f), i) for (f, _), i, _ in spans)]).astype(np.int64)[1:]
    n_docs, y = len(texts), toxic.astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))  # both labels count alike

    table = rng.normal(0, 1e-3, (BUCKETS, DIM))  # so n-grams that were never seen weigh next to nothing
    soft = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, soft, bias)]
    for epoch in range(EPOCHS if n_docs else 0):
        sharp = SHARPNESS * min(1.0, epoch / (0.5 * EPOCHS))
        way = soft[:, 1] - soft[:, 0]
        by_bucket = table @ way
        by_word = np.concatenate([np.add.reduceat(by_bucket[flat], begin) / size for flat, begin, size in parts])
        running = np.concatenate([[0.0], np.cumsum(by_word[tokens])])
        window = (running[last] - running[first]) / (last - first)
        logit, share = _pooled(window, owner, n_docs, sharp)
        logit = logit + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        g_window = error[owner] * share / (last - first)
        edge = np.bincount(first, g_window, len(tokens) + 1) - np.bincount(last, g_window, len(tokens) + 1)
        g_word = np.bincount(tokens, np.cumsum(edge)[:-1], len(by_word))
        g_bucket, at = np.zeros(BUCKETS), 0
        for flat, _, size in parts:
            g_bucket += np.bincount(flat, np.repeat(g_word[at : at + len(size)] / size, size), BUCKETS)
            at += len(size)
        g_way = table.T @ g_bucket
        grads = (
            g_bucket[:, None] * way[None, :] + DECAY * table,
            np.stack([-g_way, g_way], axis=1) + 1e-5 * soft,
            np.array([-1.0, 1.0]) * error.sum(),
        )
        for p, g, (m, v) in zip((table, soft, bias), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    return {
        "by_bucket": (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32),
        "bias": float(bias[1] - bias[0]),
        "sharp": SHARPNESS,
    }


def _pooled(window: np.ndarray, owner: np.ndarray, n: int, sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each document, and the weight of each window in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, window)
    weight = np.exp(sharp * (window - top[owner]))
    share = weight / np.bincount(owner, weight, n)[owner] if len(owner) else weight
    return np.bincount(owner, share * window, n), share


class _Scores(dict):
    """Word scores; ``learn`` adds those of the words that are not there yet, all at once."""

    def __init__(self, by_bucket: np.ndarray):
        super().__init__()
        self.by_bucket = by_bucket

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        fresh = list(words.difference(self))
        if fresh:
            flat, row = word_buckets(fresh)
            self.update(zip(fresh, (np.bincount(row, self.by_bucket[flat]) / np.bincount(row)).tolist()))


def probabilities(texts: list[bytes], scores: _Scores, model: dict) -> list[float]:
    """The score of each text."""
    split = [words_of(t) for t in texts]
    scores.learn(set().union(*split))
    out = []
    for words in split:
        logit = 0.0
        if words:
            running = np.zeros(len(words) + 1)
            np.cumsum(np.fromiter(map(scores.__getitem__, words), float, len(words)), out=running[1:])
            first, last = _windows(len(words))
            window = (running[last] - running[first]) / (last - first)
            logit = float(_pooled(window, np.zeros(len(window), np.int64), 1, model["sharp"])[0][0])
        out.append(float(1 / (1 + np.exp(-np.clip(logit + model["bias"], -30, 30)))))
    return out


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _CHUNK_BYTES:
            yield held
            held, size = [], 0
    yield held


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, never learnt from. A null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> pd.DataFrame:
    """Labelled documents that are not held out: of each label the first by a hash of the id, bounded in number and length."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda label, n: (
        known.where(F.col("toxic") == label).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n)
    )
    chosen = first(1, TOXIC_ROWS).unionByName(first(0, CLEAN_ROWS))
    own = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    ).where(F.length("body") <= SAMPLE_CHARS)
    found = own.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).select("id", "body", "toxic")
    return found.toPandas().sort_values(["id", "body"])


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted for each document.

    The model is fitted on the driver on a bounded sample of labelled documents that are not held out (TOXIC_ROWS,
    CLEAN_ROWS, SAMPLE_CHARS); every whole text is scored in the tasks. A score uses the text alone.

    Defined cases: null and empty texts have the score of no words; a long text has more windows; without
    labels of both kinds all scores are those of an untrained bias, 0.5 at most, and nothing is predicted toxic;
    rows that repeat an id are scored one by one; a null id counts as held out; other columns are ignored;
    an empty table gives no rows.
    """
    sample = training_sample(docs, labels, text, doc_id)
    if sample["toxic"].nunique() == 2:
        model = fit([bytes(b) for b in sample["body"]], sample["toxic"].to_numpy())
    else:
        model = {"by_bucket": np.zeros(BUCKETS, np.float32), "bias": -1e-9, "sharp": SHARPNESS}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        held_out(F.col(doc_id)).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value["by_bucket"])
        for batch in batches:
            texts = _chunks(b.as_py() for b in batch.column(2))
            found = np.array([p for part in texts for p in probabilities(part, scores, shared.value)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return own.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
