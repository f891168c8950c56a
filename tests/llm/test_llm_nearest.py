import math

import numpy as np
import pytest

from gapscore.llm.nearest import Tree, chi_square, nearest

from llm_tables import with_clashes


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
            out[q] = [i for _, i in found[:k]]
    return out


def recall(got, want):
    hits = sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("shard_rows, query_rows", [(16_384, 4_096), (60, 4)])
def test_recall(spark, shard_rows, query_rows):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = nearest(table, shard_rows=shard_rows, query_rows=query_rows)
    want = brute(rows, 20, 20)
    assert recall(lists(got), want) >= 0.9
    vectors = dict(rows)
    for r in got.collect():
        product = float(np.dot(np.float64(vectors[r["query_id"]]), np.float64(vectors[r["vec_id"]])))
        assert math.isclose(r["score"], product, rel_tol=1e-12)


def test_recall_over_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.1, 5)).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(lists(nearest(table, k=10)), brute(rows, 10, 20)) >= 0.9


def shares(vectors, queries, k):
    """Recall and the share of the vectors that were verified."""
    tree, hits = Tree(vectors, np.arange(len(vectors))), 0
    for q in queries:
        ids, _ = tree.search(vectors[q], q, k)
        want = [i for i in np.argsort(-(vectors @ vectors[q]), kind="stable")[: k + 1] if i != q][:k]
        hits += len(set(ids.tolist()) & set(want))
    return hits / k / len(queries), tree.verified / len(vectors) / len(queries)


def test_clusters_are_found_in_few_vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32)) * 10
    vectors = np.repeat(centres, 100, axis=0) + rng.standard_normal((4000, 32)) * 0.5
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    recall_, verified = shares(vectors, range(0, 4000, 100), 10)
    assert recall_ >= 0.9 and verified < 0.05


def test_embeddings_are_searched_in_part():
    """Vectors without structure: the search still ends before all are verified, with the recall it aims at."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    vectors = np.stack(table.column("embedding").to_numpy()).astype(np.float64)
    recall_, verified = shares(vectors, range(0, 2000, 20), 20)
    assert recall_ >= 0.9 and verified < 0.6


def test_everything_is_verified_on_demand():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((700, 12))
    tree = Tree(vectors, np.arange(700))
    for q in range(20):
        ids, found = tree.search(vectors[q], q, 15, expected=1)
        products = vectors @ vectors[q]
        products[q] = -np.inf
        assert ids.tolist() == np.argsort(-products, kind="stable")[:15].tolist() and len(found) == 15
    assert tree.verified == 20 * 699


def test_chi_square():
    x = np.array([0.0, 12.592, 2 * math.log(2), 1000.0])
    assert chi_square(x, 6)[:2] == pytest.approx([0, 0.95], abs=1e-4)
    assert chi_square(x, 2)[2:] == pytest.approx([0.5, 1], abs=1e-6)
    drawn = (np.random.default_rng(1).standard_normal((20_000, 24)) ** 2).sum(axis=1)
    assert chi_square(np.array([24.0]), 24)[0] == pytest.approx((drawn < 24).mean(), abs=0.02)


def test_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(1, 6)] + [(20, [1.0, 0.0]), (40, [0.0, 0.0]), (60, None), (80, [nan, 1.0])]
    rows += [(7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    table = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nearest(table, k=4)
    assert lists(got) == {20: [1, 2, 3, 3]}
    assert [r["rank"] for r in got.collect()] == [1, 2, 3, 4]
    assert nearest(table.limit(0)).collect() == []


def test_rows_come_by_distance_a_part_at_a_time(monkeypatch):
    """The parts are those of the whole order, equal distances as they were, however few are put in order at once."""
    from gapscore.llm import nearest as search

    distance = np.random.default_rng(3).integers(0, 12, 90).astype(float)
    rows = np.arange(90) * 3
    order = np.argsort(distance, kind="stable")
    for sorted_at_once in (1, 7, 60, 1000):
        monkeypatch.setattr(search, "SORTED", sorted_at_once)
        parts = list(search._by_distance(rows, distance, 20))
        assert [len(part) for part, _ in parts] == [20, 20, 20, 20, 10]
        assert np.array_equal(np.concatenate([part for part, _ in parts]), rows[order])
        assert [first for _, first in parts] == distance[order][::20].tolist()
    assert list(search._by_distance(rows[:0], distance[:0], 20)) == []


def test_vectors_are_stored_by_leaf():
    """A leaf is one piece of the stored vectors, and each vector keeps its id."""
    vectors = np.random.default_rng(4).standard_normal((500, 6))
    tree = Tree(vectors, np.arange(500) + 1000)
    assert np.array_equal(np.concatenate(tree.leaves), np.arange(500)) and all((np.diff(leaf) == 1).all() for leaf in tree.leaves)
    assert np.array_equal(tree.vectors, vectors[tree.ids - 1000])
