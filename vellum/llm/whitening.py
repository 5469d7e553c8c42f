"""Whitening of embedding vectors by their leading principal components, found by spectrum slicing.

Vectors become whole numbers, each distinct one counts once. Spark sums them exactly, then their centred products: a task
holds one matrix of dimension x dimension, and matrices meet in two steps, so that no task reads one for every other task.
The covariance is a model of bounded size; on it the inertia of shifted LDLᵀ factorisations counts the eigenvalues above any
number (Sylvester's law), bisection by those counts isolates each leading eigenvalue, Rayleigh quotient iteration, which
converges cubically, finds it and its vector, and counts on either side certify its number.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Steps of a whole number in one unit of a vector.
SCALE = 256
#: Matrices of tasks meet in so many sums before these meet in one.
FANS = 64
#: Eigenvalues below this share of the trace are rounding; their components have no variance to whiten.
LEAST = 1e-12
_LONG = 1 << 63


@dataclasses.dataclass(frozen=True)
class Model:
    """n distinct vectors with their sums by dimension; eigenvalues, falling, and unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None


# ---- eigenvalues of a small symmetric matrix ----
def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix exceed the shift: positive pivots of a block LDLᵀ with symmetric exchanges."""
    m = a - shift * np.eye(len(a))
    size, k, positive, bound = len(m), 0, 0, (1 + 17**0.5) / 8

    def exchange(i: int, j: int) -> None:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]

    while k < size:
        pivot, wide = abs(m[k, k]), 1
        if k + 1 < size:
            below = np.abs(m[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            largest = below[r - k - 1]
            if pivot < bound * largest:
                row = np.abs(m[r, k:])
                row[r - k] = 0
                if pivot * row.max() < bound * largest * largest:
                    if abs(m[r, r]) >= bound * row.max():
                        exchange(k, r)
                    else:
                        exchange(k + 1, r)
                        wide = 2
        if wide == 1:
            if m[k, k]:
                positive += bool(m[k, k] > 0)
                c = m[k + 1 :, k].copy()
                m[k + 1 :, k + 1 :] -= np.outer(c, c / m[k, k])
        else:  # such a block is indefinite: one eigenvalue of either sign
            positive += 1
            c = m[k + 2 :, k : k + 2].copy()
            m[k + 2 :, k + 2 :] -= c @ np.linalg.solve(m[k : k + 2, k : k + 2], c.T)
        k += wide
    return positive


def _solved(a: np.ndarray, shift: float, v: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """The unit vector of (a - shift)⁻¹ v without its parts along the known ones."""
    scale = max(1e-300, np.abs(a).max())
    for nudge in (0.0, 4e-16, -1e-15):
        try:
            found = np.linalg.solve(a - (shift + nudge * scale) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all() and found.any():
            break
    else:
        found = v
    found = found / np.abs(found).max()
    for _ in range(2):
        for w in known:
            found = found - (w @ found) * w
    return found / np.linalg.norm(found)


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many largest eigenvalues, falling, that exceed LEAST x trace, and their unit vectors as columns.

    Of eigenvalues that are equal to rounding, orthogonal vectors of their common space are given.
    """
    trace, norm = float(np.trace(a)), float(np.abs(a).sum(axis=1).max(initial=0))
    wanted = min(most, count_above(a, LEAST * trace)) if trace > 0 else 0
    rounding = 8 * len(a) * np.finfo(float).eps * norm
    values, vectors = [], []
    for k in range(1, wanted + 1):
        low, high, above_low, above_high = 0.0, norm * (1 + 1e-12) + rounding, len(a), 0
        v = np.random.default_rng(k).standard_normal(len(a))
        for w in vectors:
            v -= (w @ v) * w
        v /= np.linalg.norm(v)
        while True:
            # Narrow until no other eigenvalue lies between, or until what lies there can't be told apart.
            while (above_low, above_high) != (k, k - 1) and high - low > rounding:
                middle = (low + high) / 2
                above = count_above(a, middle)
                low, high, above_low, above_high = (middle, high, above, above_high) if above >= k else (low, middle, above_low, above)
            own, shift, found = v, (low + high) / 2, None
            for _ in range(3):
                own = _solved(a, shift, own, vectors)
            for _ in range(12):
                rho = float(own @ a @ own)
                if not low - rounding <= rho <= high + rounding:
                    break
                rest = np.linalg.norm(a @ own - rho * own)
                if rest <= rounding:
                    found = rho
                    break
                own = _solved(a, rho, own, vectors)
            if found is None:
                # Another eigenvalue was nearer to the middle: halve the interval and begin again.
                if high - low <= rounding / 64:
                    raise ArithmeticError(f"eigenvalue {k} can't be isolated")
                middle = (low + high) / 2
                above = count_above(a, middle)
                low, high, above_low, above_high = (middle, high, above, above_high) if above >= k else (low, middle, above_low, above)
                continue
            # At most k - 1 lie above it and at least k above what is just below it.
            if count_above(a, found + 2 * rounding) > k - 1 or count_above(a, found - 2 * rounding) < k:
                raise ArithmeticError(f"the number {k} of an eigenvalue isn't certified")
            # One more step, cubic as it is, leaves only rounding.
            own = _solved(a, found, own, vectors)
            values.append(float(own @ a @ own))
            vectors.append(own)
            break
    return np.array(values), np.array(vectors).T.reshape(len(a), len(vectors))


# ---- sums over all vectors ----
def whole_numbers(vector: Column) -> Column:
    """floor(256 c) of each entry, as long; null if the vector is null or holds null or what isn't finite."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where they suffice, else as Python's integers."""
    most = max(1, *(int(abs(int(f(x)))) for f in (np.min, np.max))) if x.size else 1
    if n * most + max(map(abs, map(int, sums)), default=0) < _LONG // 2:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _summed(rows: DataFrame, partial: str) -> np.ndarray | None:
    """The sum of arrays of doubles of one length, one from each task, by way of FANS sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch, partial).sum(axis=0)
                total, part = (own if total is None else total + own), batch.column(0)[0].as_py()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["part", partial])

    schema = f"part int, {partial} array<double>"
    fanned = rows.withColumn("part", (F.spark_partition_id() % FANS).cast("int")).select("part", partial).repartition("part").mapInArrow(add, schema)
    found = fanned.repartition(1).mapInArrow(add, schema).collect()
    return np.array(found[0][partial]) if found else None


def _products(rows: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray | None:
    """Sum of the products of centred vectors, first turned by a basis if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _deviations(_matrix(batch, "x"), n, sums).astype(float) / n
                y = y if basis is None else y @ basis
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["products"])

    found = _summed(rows.select("x").mapInArrow(run, "products array<double>"), "products")
    return None if found is None else found.reshape([round(len(found) ** 0.5)] * 2)


def fit(vectors: DataFrame, column: str = "embedding", most: int = 4) -> Model:
    """The model of all distinct vectors of a table; null ones, those with null or non-finite entries take no part.

    Vectors are those of the commonest length, of equally common ones the longest; others, and empty ones, take no part.
    Repeated rows and vectors that become the same whole numbers count once. Entries beyond 64 bits are held at their ends.
    A table without vectors, and one where all are equal, gives a model without components.
    """
    x = vectors.select(whole_numbers(F.col(column)).alias("x")).where("size(x) > 0")
    length = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length.d if length else 0
    distinct = common.durable(x.where(F.size("x") == d).distinct(), "whitening-distinct")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [0] * d, 0
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch, "x")
                safe = max(abs(int(m.min())), abs(int(m.max()))) * len(m) < _LONG // 2
                total = [a + int(b) for a, b in zip(total, (m if safe else m.astype(object)).sum(axis=0), strict=True)]
                count += len(m)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([*map(Decimal, (*total, count))], pa.decimal128(38, 0))], ["at", "s"])

    found = {r["at"]: int(r["s"]) for r in distinct.mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    n, sums = found.get(d, 0) if found else 0, [found.get(i, 0) for i in range(d)]
    exact = np.array(sums, dtype=object)
    products = _products(distinct, n, exact) if n else None
    if products is None:
        return Model(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, None)
    covariance = (products + products.T) / (2 * n)
    values, components = leading(covariance, most)
    error = None
    if len(values):
        own = _products(distinct, n, exact, components / np.sqrt(values))
        error = float(np.abs(own / n - np.eye(len(values))).max())
    return Model(n, tuple(sums), values, components, float(np.trace(covariance)), error)


def whiten(vectors: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """vectors -> the rows that can be whitened, with all their columns and `deviation` and `whitened`.

    deviation is the sum of (n x - S)² over the dimensions, null if it exceeds a long; whitened has a value for each of the
    model's components. Rows of another length than the model's vectors, null and non-finite ones are left out; repeated
    rows stay as often as they are there. Columns of these names are replaced; others come through.
    """
    n, d, sums = model.n, len(model.sums), np.array(model.sums, dtype=object)
    basis = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((d, 0))
    hidden = common.fresh(vectors, "x")
    kept = vectors.drop("deviation", "whitened").withColumn(hidden, whole_numbers(F.col(column))).where((F.size(hidden) == d) & F.lit(d > 0))
    names = [c for c in kept.columns if c != hidden]
    schema = kept.drop(hidden).withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _deviations(_matrix(batch, hidden), n, sums)
            largest = max(abs(int(off.min())), abs(int(off.max())))
            squares = ((off if largest**2 * d < _LONG else off.astype(object)) ** 2).sum(axis=1)
            whitened = (off.astype(float) / n) @ basis
            places = pa.array(np.arange(len(off) + 1) * basis.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array([int(s) if s < _LONG else None for s in squares], pa.int64()), pa.ListArray.from_arrays(places, pa.array(whitened.ravel(), pa.float64()))],
                [*names, "deviation", "whitened"],
            )

    return kept.mapInArrow(run, schema)
