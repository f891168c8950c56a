"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions of the projection. Fewer verify more: on vectors without structure 6 dimensions would leave hardly any out.
PROJECTED = 24
#: A search ends when so large a share of the k nearest is expected among what was verified; 1 verifies everything.
EXPECTED = 0.9
#: Vectors in a leaf of a tree, in one tree, and queries that are searched together.
LEAF, SHARD, QUERIES = 32, 16_384, 4_096
#: The leaves that are opened at once, as a part of all, and the vectors that are verified at once.
STEP, CHUNK = 1 / 8, 256
#: The opened vectors that are put in order at once.
SORTED = 4_096
SEED = 5
#: Steps of the table of the chi-square distribution.
_TABLE = 2_000


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """The share of a chi-square variable below x, by the series of the incomplete gamma function."""
    a, x = freedom / 2, np.maximum(np.asarray(x, dtype=np.float64) / 2, 1e-300)
    term = total = np.full_like(x, 1 / a)
    n = a
    while np.any(term > total * 1e-12):
        n += 1
        term = term * x / n
        total = total + term
    return np.minimum(total * np.exp(-x + a * np.log(x) - math.lgamma(a)), 1.0)


def _by_distance(rows: np.ndarray, distance: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, float]]:
    """The rows by distance, ``size`` at once, each part with its least distance. Equal ones keep their order.

    A search may end early, so rows are put in order about SORTED at a time.
    """
    left_rows, left = rows[:0], distance[:0]
    while len(rows) or len(left_rows):
        if len(rows) and len(left_rows) < size:
            near = distance <= np.partition(distance, SORTED)[SORTED] if len(rows) > SORTED else np.ones(len(rows), dtype=bool)
            order = np.argsort(distance[near], kind="stable")
            left_rows, left = np.concatenate([left_rows, rows[near][order]]), np.concatenate([left, distance[near][order]])
            rows, distance = rows[~near], distance[~near]
            continue
        yield left_rows[:size], left[0]
        left_rows, left = left_rows[size:], left[size:]


class Tree:
    """A kd-tree over projected vectors, as boxes of leaves of equal size."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        """Lengthens the vectors by one coordinate to a common norm: the largest product is then the least distance."""
        square = (vectors * vectors).sum(axis=1)
        self.square = float(square.max())
        extra = np.sqrt(np.maximum(self.square - square, 0.0))
        d = vectors.shape[1] + 1
        m = min(PROJECTED, d)
        drawn = np.random.default_rng(SEED).standard_normal((d, m))
        # orthogonal directions, as long as normal ones: squared lengths are nearer to their mean than chi-square
        self.projection = np.linalg.qr(drawn)[0] * math.sqrt(d)
        self.top = 4.0 * m
        self.share = chi_square(np.linspace(0, self.top, _TABLE + 1), m)
        points = np.hstack([vectors, extra[:, None]]) @ self.projection
        order = np.arange(len(points))
        leaves = [order]
        while any(len(leaf) > LEAF for leaf in leaves):
            leaves = [half for leaf in leaves for half in self._halves(points, leaf)]
        # Stored by leaf, so that a leaf is read in one piece.
        order = np.concatenate(leaves)
        self.vectors, self.ids, self.points = vectors[order], ids[order], points[order]
        self.leaves = np.split(np.arange(len(points)), np.cumsum([len(leaf) for leaf in leaves])[:-1])
        self.own_ids = frozenset(ids.tolist())
        self.low = np.array([points[leaf].min(axis=0) for leaf in leaves])
        self.high = np.array([points[leaf].max(axis=0) for leaf in leaves])
        self.verified = 0

    @staticmethod
    def _halves(points: np.ndarray, leaf: np.ndarray) -> list[np.ndarray]:
        if len(leaf) <= LEAF:
            return [leaf]
        own = points[leaf]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        middle = len(leaf) // 2
        split = np.argpartition(own[:, axis], middle)
        return [leaf[split[:middle]], leaf[split[middle:]]]

    def search(self, query: np.ndarray, own_id: int, k: int, expected: float = EXPECTED) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best found, best first, ties by smaller id.

        Leaves are opened in the order of their distance in the projection, and vectors verified in that of theirs. For a
        vector at true distance d the squared projected distance over d squared is chi-square at most. So a
        vector as near as the j-th found lies inside of what was verified with a probability that the next
        projected distance gives; the search ends when the mean of these over the k found is ``expected``.
        """
        norm = float(query @ query)
        point = np.append(query, 0.0) @ self.projection
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        open_rows, open_distance = np.empty(0, np.int64), np.empty(0)
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        at, step, own = 0, max(1, int(len(order) * STEP)), own_id in self.own_ids
        while at < len(order) or len(open_rows):
            if at < len(order):
                rows = np.concatenate([self.leaves[i] for i in order[at : at + step]])
                at += step
                if own:
                    rows = rows[self.ids[rows] != own_id]
                away = self.points.take(rows, axis=0)
                away -= point
                open_rows = np.concatenate([open_rows, rows])
                open_distance = np.concatenate([open_distance, np.einsum("ij,ij->i", away, away)])
            limit = bound[order[at]] if at < len(order) else np.inf
            ready = open_distance <= limit
            if not ready.any():
                continue
            rows, distance = open_rows[ready], open_distance[ready]
            open_rows, open_distance = open_rows[~ready], open_distance[~ready]
            size = max(CHUNK, k)
            for part, first in _by_distance(rows, distance, size):
                if len(best) == k:
                    near = np.maximum(norm + self.square - 2 * best, 1e-12)  # squared distances of the found
                    place = np.minimum(first / near / self.top, 1.0) * _TABLE
                    if self.share[place.astype(np.int64)].mean() >= expected and expected < 1:
                        return best_ids, best
                self.verified += len(part)
                product = np.einsum("ij,j->i", self.vectors.take(part, axis=0), query)
                if len(best) == k:
                    able = ~(product < best[-1])  # others come after the k found
                    part, product = part[able], product[able]
                if len(part):
                    best_ids = np.concatenate([best_ids, self.ids[part]])
                    best = np.concatenate([best, product])
                    top = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[top], best[top]
        return best_ids, best


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    shard_rows: int = SHARD,
    query_rows: int = QUERIES,
    expected: float = EXPECTED,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by ``every``.

    Nearness is the inner product of the vectors as given, in double precision. The vectors are dealt by a
    hash of the id to shards of about ``shard_rows``; each has a tree of its own. Queries are dealt to blocks
    of about ``query_rows``, and each block meets each shard in one task, so a task holds a shard and a block
    whatever the size of the table. The best of all shards then compete, at most k from each. ``expected`` is the share
    of the true nearest that a search aims at; 1 is exact. How much is verified depends on the vectors: the
    nearer the neighbours are compared with all others, the less.

    Defined cases: a vector that is null, empty, zero or has a null or non-finite component neither asks nor
    answers, nor does a row without an id; vectors of another length than a query's are not compared with it; rows
    that repeat an id are one candidate each and, with vectors of one length, one query, of the least vector; fewer candidates than k
    give fewer rows; other columns are ignored; an empty table gives no rows.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    own = own.withColumn("size", F.size("v"))
    n = own.count()
    shards = max(1, math.ceil(n / shard_rows))
    blocks = max(1, math.ceil(n / every / query_rows))
    place = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    numbers = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    candidates = own.withColumn("shard", place).withColumn("block", F.explode(numbers(blocks)))
    queries = (
        own.where(F.pmod("id", F.lit(every)) == 0)
        .groupBy("id", "size")
        .agg(F.min("v").alias("v"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(numbers(shards)))
    )
    keys = ["shard", "block", "size"]

    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(stored):
            tree = Tree(np.stack(stored["v"].to_numpy()).astype(np.float64), stored["id"].to_numpy(np.int64))
            for own_id, v in zip(asked["id"], asked["v"]):
                rows.append((own_id, *tree.search(np.asarray(v, np.float64), own_id, k, expected)))
        columns = [np.concatenate([[], *part]) for part in zip(*((np.full(len(i), q), i, s) for q, i, s in rows))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns or ([], [], []))))

    found = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
