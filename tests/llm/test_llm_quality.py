import math

import numpy as np
from pyspark.sql import functions as F

from gapscore.llm import quality
from gapscore.llm.features import ngram_hashes, stretches
from gapscore.llm.quality import good_documents, kth_largest, resampled


def features(text):
    body = np.frombuffer(text, np.uint8)
    found = [ngram_hashes(*part)[0] for part in stretches(body, np.array([0, len(body)]))]
    return np.concatenate([np.empty(0, np.uint64), *found])


def test_labelled_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = resampled(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, kept))
    assert share[1] > 0.97 and share[0] < 0.15


def test_weights_by_brute_force(documents, labels):
    got = {r["doc_id"]: r for r in resampled(documents, labels).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in texts.items():
        counts = np.bincount(quality._bucket(features(t)), minlength=quality.BUCKETS)
        raw += counts
        target += counts * (i in good)
    ratio = np.log((target + quality.PRIOR) / (raw * target.sum() / raw.sum() + quality.PRIOR))
    for i, t in texts.items():
        assert math.isclose(got[i]["log_weight"], ratio[quality._bucket(features(t))].sum(), abs_tol=1e-6)
    share = labels.agg(F.avg("quality")).first()[0]
    k = math.ceil(share * len(texts))
    best = sorted(got, key=lambda i: -math.floor(got[i]["key"] * quality._STEP))[:k]
    assert {i for i in got if got[i]["kept"]} == set(best)
    assert {r["doc_id"] for r in good_documents(documents, labels).collect()} == set(best)


def test_tokens_and_pairs_stay_in_their_document():
    body = np.frombuffer(b"Ab cd!ab cdx", np.uint8)
    hashes, owner = ngram_hashes(body, np.array([0, 6, 6]), np.array([0, 1, 2]))
    assert owner.tolist() == [0, 0, 0, 2, 2, 0, 0, 2]
    assert hashes[0] == hashes[3] and hashes[1] != hashes[4] and hashes[5] != hashes[7]


def test_long_texts_are_read_to_the_end():
    words = [f"w{i}" for i in range(4000)]
    body = " ".join(words).encode()
    array, at = np.frombuffer(body, np.uint8), np.array([0, 0, len(body), len(body)])
    single = [h for part in stretches(array, at, 1000) for h in ngram_hashes(*part)[0]]
    whole = ngram_hashes(array, np.zeros(1, np.int64), np.array([1]))[0]
    assert len(single) > 4000 and set(whole[:4000]) <= set(single)


def test_gumbel_noise_has_its_distribution(spark):
    mean, spread = spark.range(20000).select(quality.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(mean - 0.5772) < 0.03 and abs(spread - 1.2825) < 0.03


def test_kth_largest(spark):
    values = [-5, 3, 3, 2**40, -(2**62), 0, 7]
    keys = spark.createDataFrame([(v,) for v in values] + [(None,)], "key long")
    assert [kth_largest(keys, "key", k) for k in range(1, 8)] == sorted(values, reverse=True)
    assert kth_largest(keys, "key", 8) is None


def test_awkward_rows(awkward, nothing, labels, spark):
    rows = resampled(awkward, labels).collect()
    assert len(rows) == awkward.count()
    assert {r["log_weight"] for r in rows if r["doc_id"] in (2, 3, 7)} == {0.0}
    assert good_documents(awkward, labels).columns == awkward.columns
    assert resampled(nothing, labels).collect() == []
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert good_documents(awkward, none).count() == awkward.count()
