"""Quality by importance resampling: documents are drawn by how like the target text they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.llm.features import bytes_of, ngram_hashes, stretches
from gapscore.llm.work import Scratch

#: Buckets for the hashes of tokens and token pairs; a model is one count for each.
BUCKETS = 1 << 16
#: The target text: at most so many labelled documents of quality 1, the first by a hash of the id.
TARGET_ROWS = 20_000
#: Prior of the target model: so many tokens a bucket, dealt as in the raw text.
PRIOR = 50.0
SEED = 7
#: Keys of documents are compared as whole multiples of this fraction.
_STEP = 1 << 20
_DIGIT = 16


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS


def model_counts(docs: DataFrame, target_ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(bucket, raw, target): counts over all documents, and over those whose id is a target id.

    A task adds up what it reads and gives one row for each bucket, so the shuffle does not grow with the text
    inside a partition.
    """
    flagged = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    ).join(F.broadcast(target_ids.select(F.col("doc_id").alias("id"), F.lit(True).alias("is_target"))), "id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for part, starts, document in stretches(*bytes_of(batch.column(0))):
                hashes, owner = ngram_hashes(part, starts, document)
                buckets = _bucket(hashes)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[chosen[owner]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], target[used])], ["bucket", "raw", "target"])

    counts = flagged.select("text", "is_target").mapInArrow(count, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The logarithm of target over raw probability for each bucket; BUCKETS numbers at most come to the driver."""
    table = counts.where(F.col("bucket") < BUCKETS).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"]], target[table["bucket"]] = table["raw"], table["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def log_weight(ratios: np.ndarray) -> Callable[[Column], Column]:
    """A function of a binary column: the sum of the ratios over all tokens and pairs of a text."""
    ratios = ratios.astype(np.float64)

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for part, starts, document in stretches(*bytes_of(texts)):
            hashes, owner = ngram_hashes(part, starts, document)
            out += np.bincount(owner, weights=ratios[_bucket(hashes)], minlength=len(out))
        return pa.array(out)

    return weigh


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id and the seed alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest number of a long column, exactly; null if there are fewer.

    Found digit by digit from the top: a round counts rows by the next 16 bits, so the driver sees at most 65,536
    rows a round, and no task sorts the column.
    """
    found, left = 0, k
    rows = keys.where(F.col(column).isNotNull()).select(F.col(column).alias("key"))
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        counts = rows.groupBy(F.shiftright("key", shift).alias("digit")).agg(F.count("*").alias("n")).collect()
        for digit, n in sorted(((r["digit"], r["n"]) for r in counts), reverse=True):
            if n >= left:
                found = digit
                break
            left -= n
        else:
            return None
        rows = rows.where(F.shiftright("key", shift) == F.lit(found))
    return found


def _fit(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, scratch: Scratch) -> tuple[np.ndarray, float]:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    good = known.where("quality = 1").select("doc_id").distinct()
    target_ids = scratch.keep(good.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(TARGET_ROWS), "target")
    counts = scratch.keep(model_counts(docs, target_ids, text, doc_id), "counts")
    ratios = log_ratios(counts)
    scratch.drop("target", "counts")
    return ratios, 1.0 if share is None else share


def _weight(ratios: np.ndarray, text: str) -> Column:
    return log_weight(ratios)(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def resampled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Which documents a draw from the target distribution takes: doc_id, log_weight, key and kept.

    Two models give each token and token pair a probability, by hashed counts: one of the target text, documents
    with label quality 1 (TARGET_ROWS of them at most), one of all documents. log_weight is the logarithm of their
    ratio for the whole text. The k documents with the largest log_weight plus Gumbel noise are a
    sample without replacement by importance; k is the labels' share of quality 1 times all documents.

    Defined cases: a null or empty text has log_weight 0; documents with equal keys at the border are all
    kept; rows that repeat an id have the same noise; a null id has noise of its own value; without labels of
    quality 1 all weights are 0, and without labels all documents are kept; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ratios, share = _fit(docs, labels, text, doc_id, scratch)
    scored = docs.select(F.col(doc_id).alias("doc_id"), _weight(ratios, text).alias("log_weight")).withColumn(
        "key", F.col("log_weight") + gumbel(F.col("doc_id"))
    )
    scored = scratch.keep(scored, "scored")
    limit = _border(scored, share)
    return scored.select("doc_id", "log_weight", "key", (_whole("key") >= limit).alias("kept"))


def _whole(key: str) -> Column:
    return F.floor(F.col(key) * _STEP).cast("long")


def _border(scored: DataFrame, share: float) -> Column:
    k = int(np.ceil(share * scored.count()))
    found = kth_largest(scored.select(_whole("key").alias("key")), "key", max(k, 1))
    return F.lit(-(2**63) if found is None else found).cast("long")


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``resampled`` keeps, with their columns."""
    scratch = Scratch(docs.sparkSession, "quality")
    ratios, share = _fit(docs, labels, text, doc_id, scratch)
    whole = F.floor((_weight(ratios, text) + gumbel(F.col(doc_id))) * _STEP).cast("long")
    keys = scratch.keep(docs.select(whole.alias("key")), "keys")
    found = kth_largest(keys, "key", max(int(np.ceil(share * keys.count())), 1))
    scratch.drop("keys")
    if found is None:
        return docs
    own = docs.select(F.struct("*").alias("row"), whole.alias("key"))
    return own.where(F.col("key") >= F.lit(found)).select("row.*")
