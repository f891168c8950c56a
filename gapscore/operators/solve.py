"""Logistic regressions of many goals at once: small ones in a task each, medium ones by passes that all of them share."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A goal of at most so many rows and feature values is solved in one task.
SMALL_ROWS, SMALL_VALUES = 20_000, 4_000_000
_STEPS, _INNER, _PRECISION = 100, 200, 1e-9

#: Beyond that, a goal of at most so many feature values is solved with others, by passes over the rows of all.
MEDIUM_VALUES = 16_000_000
#: There, the gradient for each sample at which a fit ends, and by how much each step's conjugate gradients reduce theirs.
SHARED_PRECISION, SHARED_INNER = 1e-6, 0.1
#: Coefficients of all the goals that share their passes; more goals are fitted in several groups.
SHARED_VALUES = 1 << 22
#: Feature values that a task works on at once: few enough for a processor's cache.
BLOCK_VALUES = 1 << 16
# Up to so many partitions send their sums straight to the driver.
_FEW_PARTITIONS = 32

FITTED = "goal STRING, intercept DOUBLE, coefficients ARRAY<DOUBLE>, error STRING"


class Sparse:
    """Rows of sparse features: products with a vector from either side."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, d: int):
        self.row, self.column, self.value, self.n, self.d = row, column, value, n, d

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.n)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.d)


def solve(x: Sparse, y: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
    """The least of the weighted log loss plus half the squared coefficients; the intercept is free.

    Newton steps by conjugate gradients, shortened until the objective falls.
    """
    w, b = np.zeros(x.d), 0.0

    def objective(w: np.ndarray, b: float) -> float:
        z = x.times(w) + b
        return float(s @ (np.logaddexp(0, z) - y * z) + w @ w / 2)

    now = objective(w, b)
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -500, 500)))
        r, curve = s * (p - y), s * p * (1 - p)
        g, g0 = x.transposed_times(r) + w, r.sum()
        size = np.sqrt(g @ g + g0 * g0)
        if size < _PRECISION * max(1.0, s.sum()):
            break
        dw, db, rw, rb = np.zeros(x.d), 0.0, -g, -g0
        pw, pb, rho = rw.copy(), rb, size * size
        for _ in range(_INNER):
            q = curve * (x.times(pw) + pb)
            hw, hb = x.transposed_times(q) + pw, q.sum()
            bend = pw @ hw + pb * hb
            if bend <= 0:
                break
            a = rho / bend
            dw, db, rw, rb = dw + a * pw, db + a * pb, rw - a * hw, rb - a * hb
            last, rho = rho, rw @ rw + rb * rb
            if rho < min(0.01, size) ** 2 * size * size:
                break
            pw, pb = rw + rho / last * pw, rb + rho / last * pb
        slope, step = g @ dw + g0 * db, 1.0
        while (then := objective(w + step * dw, b + step * db)) > now + 1e-4 * step * slope and step > 1e-10:
            step /= 2
        if then >= now and step <= 1e-10:
            break
        w, b, now = w + step * dw, b + step * db, then
    return b, w


def _solve_table(table: pa.Table, size: int) -> pa.Table:
    """One goal, with all its coefficients, or what went wrong."""
    goal, error, intercept, coefficients = table.column("goal")[0].as_py(), None, None, None
    try:
        y, s = (table.column(c).to_numpy().astype(float) for c in ("label", "weight"))
        if len(set(y.tolist())) < 2:
            raise ValueError("all training samples have the same label")
        indices = table.column("indices").combine_chunks()
        row = np.repeat(np.arange(len(y)), indices.value_lengths().to_numpy(zero_copy_only=False))
        column, value = indices.flatten().to_numpy(), table.column("values").combine_chunks().flatten().to_numpy()
        if not (np.isfinite(value).all() and np.isfinite(s).all()):
            raise ValueError("features or weights are not finite")
        used, place = np.unique(column, return_inverse=True)
        intercept, found = solve(Sparse(row, place, value, len(y), len(used)), y, s)
        coefficients = np.zeros(size)
        coefficients[used] = found
        coefficients = coefficients.tolist()
    except Exception as problem:  # noqa: BLE001 - one goal must not stop the others
        error = f"failed: {problem}"
    columns = [pa.array([goal], pa.string()), pa.array([intercept], pa.float64()), pa.array([coefficients], pa.list_(pa.float64())), pa.array([error], pa.string())]
    return pa.Table.from_arrays(columns, ["goal", "intercept", "coefficients", "error"])


def fit_small(rows: DataFrame, size: int) -> DataFrame:
    """``FITTED`` rows of all goals of ``(goal, label, weight, features)``, each small enough for a task.

    A goal that cannot be fitted has an ``error`` and no model.
    """
    parts = F.unwrap_udt("features")
    plain = rows.select("goal", "label", "weight", parts.indices.alias("indices"), parts["values"].alias("values"))
    return plain.groupBy("goal").applyInArrow(lambda table: _solve_table(table, size), FITTED)


def newton(d: int, n: int) -> Generator[tuple[np.ndarray, np.ndarray | None], np.ndarray, np.ndarray]:
    """The objective of ``solve`` for rows that are elsewhere: asks for sums over them, and returns coefficients and intercept.

    ``(x, None)`` asks for loss, gradient and diagonal of the curvature at x; ``(x, p)`` for the curvature along p.
    Conjugate gradients are scaled by the diagonal, as terms differ much in frequency.
    """
    penalty = np.append(np.ones(d), 0.0)

    def at(x: np.ndarray):
        sums = yield x, None
        objective = sums[0] + penalty * x @ x / 2
        if not np.isfinite(sums).all():
            raise ValueError("features or weights are not finite")
        return objective, sums[1 : d + 2] + penalty * x, np.maximum(sums[d + 2 :] + penalty, 1e-300)

    x = np.zeros(d + 1)
    now, g, diagonal = yield from at(x)
    for _ in range(_STEPS):
        if np.linalg.norm(g) < SHARED_PRECISION * n:
            break
        dx, r = np.zeros(d + 1), -g
        p = r / diagonal
        first = rho = r @ p
        for _ in range(_INNER):
            h = (yield x, p) + penalty * p
            bend = p @ h
            if bend <= 0:
                break
            a = rho / bend
            dx, r = dx + a * p, r - a * h
            scaled = r / diagonal
            last, rho = rho, r @ scaled
            if rho < SHARED_INNER**2 * first:
                break
            p = scaled + rho / last * p
        slope, step = g @ dx, 1.0
        then, g_then, diagonal_then = yield from at(x + dx)
        while then > now + 1e-4 * step * slope and step > 1e-10:
            step /= 2
            then, g_then, diagonal_then = yield from at(x + step * dx)
        if then >= now:
            break
        x, now, g, diagonal = x + step * dx, then, g_then, diagonal_then
    return x


def _cuts(lengths: np.ndarray, values: int) -> list[int]:
    """Where rows of so many values each end."""
    return [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // values)) + 1).tolist(), len(lengths)]


_TYPES = {"y": np.float64, "s": np.float64, "lengths": np.int64, "column": np.int32, "value": np.float64}


def _blocks(rows: DataFrame, size: int) -> RDD:
    """``(goal, arrays)``: the rows in blocks, each of one goal and of few values, dealt evenly."""
    parts = F.unwrap_udt("features")
    plain = rows.select("goal", "label", "weight", parts.indices.alias("indices"), parts["values"].alias("values"))
    values = max(BLOCK_VALUES, 8 * size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for goal in batch.column(0).unique():
                part = batch.filter(pc.equal(batch.column(0), goal))
                y, s = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                lengths = part.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                column, value = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
                cuts, ends = _cuts(lengths, values), np.append(0, np.cumsum(lengths))
                for a, b in pairwise(cuts):
                    inner = slice(ends[a], ends[b])
                    arrays = y[a:b], s[a:b], lengths[a:b], column[inner], value[inner]
                    block = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(arrays, _TYPES.values())]
                    yield pa.RecordBatch.from_arrays([pa.array([goal.as_py()], pa.string()), *block], ["goal", *_TYPES])

    packed = plain.mapInArrow(pack, "goal string, " + ", ".join(f"{name} binary" for name in _TYPES))
    dealt = packed.repartition(max(plain.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism))
    return dealt.rdd.map(lambda row: (row[0], [np.frombuffer(b, dtype=t) for b, t in zip(row[1:], _TYPES.values())]))


def _block_sums(arrays: list[np.ndarray], x: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """What ``newton`` asks for, of one block."""
    y, s, lengths, column, value = arrays
    filled = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[filled]

    def times(v: np.ndarray) -> np.ndarray:
        z = np.full(len(y), v[-1])
        if len(filled):
            z[filled] += np.add.reduceat(value * v.take(column), starts)
        return z

    def transposed_times(r: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, value * np.repeat(r, lengths), len(x) - 1), r.sum())

    z = times(x)
    chance = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    curve = s * chance * (1 - chance)
    if p is not None:
        return transposed_times(curve * times(p), value)
    loss = s @ (np.logaddexp(0, z) - y * z)
    return np.concatenate([[loss], transposed_times(s * (chance - y), value), transposed_times(curve, value * value)])


def _added(a: dict, b: dict) -> dict:
    for goal, sums in b.items():
        a[goal] = a[goal] + sums if goal in a else sums
    return a


def _pass(blocks: RDD, asked: dict) -> dict:
    """What each goal asks for, summed over its blocks by one job."""
    sent = blocks.context.broadcast(asked)

    def add(total: dict, block: tuple) -> dict:
        goal, arrays = block
        return _added(total, {goal: _block_sums(arrays, *sent.value[goal])}) if goal in sent.value else total

    try:
        return blocks.treeAggregate({}, add, _added, 1 if blocks.getNumPartitions() <= _FEW_PARTITIONS else 2)
    finally:
        sent.destroy()


def fit_shared(rows: DataFrame, counts: dict[str, int], size: int) -> dict[str, np.ndarray | Exception]:
    """Coefficients and intercept, or what went wrong, for goals of ``(goal, label, weight, features)`` of any size.

    ``counts`` are their numbers of rows. Rows stay where they are; all goals of a group ask at once, so a group takes as many jobs
    as its slowest goal asks questions.
    """
    done, goals, group = {}, list(counts), max(1, SHARED_VALUES // (size + 1))
    for start in range(0, len(goals), group):
        chosen = goals[start : start + group]
        blocks = _blocks(rows.filter(F.col("goal").isin(chosen)), size).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        fits, asked = {goal: newton(size, counts[goal]) for goal in chosen}, {}
        answers = dict.fromkeys(chosen)
        while fits:
            for goal, fit in list(fits.items()):
                try:
                    asked[goal] = fit.send(answers[goal])
                    continue
                except StopIteration as end:
                    done[goal] = end.value
                except Exception as problem:  # noqa: BLE001 - one goal must not stop the others
                    done[goal] = problem
                asked.pop(goal, None)
                del fits[goal]
            if fits:
                answers = _pass(blocks, asked)
        blocks.unpersist()
    return done
