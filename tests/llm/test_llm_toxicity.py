import zlib

import numpy as np

from gapscore.llm import toxicity
from gapscore.llm.toxicity import fit, probabilities, scored, word_buckets


def synthetic(rng, toxic, stems, n=80):
    syllables = ["ba", "ko", "ri", "tel", "mun", "sa", "ver", "li"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 4)))
    words = [word() for _ in range(n)]
    if toxic:
        for _ in range(6):
            words[rng.integers(n)] = str(rng.choice(stems)) + word()[:3]
    return " ".join(words).encode()


def test_unseen_misspellings_are_found():
    rng = np.random.default_rng(0)
    y = np.arange(800) % 2
    model = fit([synthetic(rng, t, ["grumph", "snarkle"]) for t in y], y)
    scores = toxicity._Scores(model["by_bucket"])
    misspelt = [synthetic(rng, t, ["grumphh", "snarklle"]) for t in y]
    found = np.array(probabilities(misspelt, scores, model))
    assert ((found >= 0.5) == y).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    rank = np.argsort(np.argsort(p))
    area = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert area > 0.9  # there are but 350 toxic documents to learn from; 0.999 with 1,700
    assert ((p >= 0.5) & (y == 0)).mean() < 0.03
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_buckets_do_not_depend_on_the_neighbours():
    words = [b"alpha", b"be", b"alphabet", "naïve".encode(), b"!!!", b""]
    flat, row = word_buckets(words)
    for i, w in enumerate(words):
        alone, _ = word_buckets([w])
        assert sorted(flat[row == i].tolist()) == sorted(alone.tolist())
    assert set(word_buckets([b"alpha,"])[0]) == set(word_buckets([b"alpha"])[0])


def test_labels_of_held_out_rows_do_not_matter(spark, documents, labels):
    flipped = labels.selectExpr(
        "doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic"
    )
    a, b = (sorted(map(tuple, scored(documents, x).collect())) for x in (labels, flipped))
    assert a == b


def test_awkward_rows(awkward, nothing, documents, labels, spark):
    rows = scored(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 7)}) == 1
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert scored(nothing, labels).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r["predicted"] for r in scored(awkward, none).collect()} == {0}
