"""Embedding whitening by polarisation: covariances from variances of sums, without a product of two columns.

For integers, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2. So one aggregate, the sum of squared centred
values, taken for every dimension and for the sum of every pair of dimensions, gives the whole covariance
matrix. All sums are exact integers; the matrix (dimensions squared, whatever the rows) goes to the driver
for ``eigh``, and the components go back into one pass over the rows.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left out. A vector
that repeats is fitted once, and every row of it is whitened; a null id stays null. Components whose
eigenvalue is zero up to rounding (a constant table, fewer vectors than dimensions) have null in ``whitened``
and do not count in ``identity_error``, which is null if no other is left. An empty table gives no rows.
Vectors of different lengths are an error, and so are entries or deviations beyond 64-bit integers. Other columns are never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.session import shared_dir

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components of a row that are returned.
COMPONENTS = 16
#: Eigenvalues below this share of the trace are rounding.
LEAST_SHARE = 1e-12
#: Rows that are worked on together.
ROWS = 4096


def quantised(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the rows whose vector is whole; x are integers."""
    entry = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(key).alias("id"), x.alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, written in the shared folder: it is read several times."""
    path = f"{shared_dir(rows.sparkSession)}/fitted-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(path)
    return rows.sparkSession.read.schema("x array<bigint>").parquet(path)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of integers, a bounded number at a time."""
    for batch in batches:
        column = batch.column("x")
        for start in range(0, len(column), ROWS):
            part = column.slice(start, ROWS)
            yield part.flatten().to_numpy().reshape(len(part), -1)


def _exact_squares(values: np.ndarray) -> list[int]:
    """Sum of squares of each column, exact."""
    largest = int(max(values.max(initial=0), -int(values.min(initial=0))))
    if largest * largest * max(1, len(values)) >= 2**63:
        values = values.astype(object)
    return [int(v) for v in (values * values).sum(axis=0)]


def _pair_squares(batches: Iterator[pa.RecordBatch], centre: list[int]) -> Iterator[pa.RecordBatch]:
    """(a, b, total): this task's sums of squares of y_a (b = a) and of y_a + y_b, y = x - centre."""
    totals: dict[tuple[int, int], int] = {}
    for x in _matrices(batches):
        y = x - np.array(centre, np.int64)
        for a in range(y.shape[1]):
            sums = y[:, a:] + y[:, a : a + 1]
            sums[:, 0] = y[:, a]
            for b, square in enumerate(_exact_squares(sums), a):
                totals[a, b] = totals.get((a, b), 0) + square
    if totals:
        keys = list(totals)
        yield pa.RecordBatch.from_pydict(
            {
                "a": pa.array([a for a, _ in keys], pa.int32()),
                "b": pa.array([b for _, b in keys], pa.int32()),
                "total": pa.array([str(totals[k]) for k in keys], pa.string()),
            }
        )


@dataclass
class Whitening:
    """What the rows are projected with."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float

    def usable(self) -> np.ndarray:
        return self.values > LEAST_SHARE * self.trace if self.trace > 0 else np.zeros(len(self.values), bool)


def covariance(fitted: DataFrame) -> tuple[int, list[int], list[list[Fraction]]]:
    """(n, sums, covariance matrix) of a fit list, exact.

    With m = floor(S / n) and y = x - m, the squared centred values (n * x - S)^2 sum up to
    n * (n * sum(y^2) - r^2), r = S - n * m. So the aggregated integers stay small.
    """
    lengths = fitted.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] == 0:
        return 0, [], []
    if lengths[1] != lengths[2]:
        raise ValueError(f"vectors have {lengths[1]} to {lengths[2]} entries")
    n, d = lengths[0], lengths[2]
    entries = fitted.select(F.posexplode("x").alias("a", "v"))
    per_entry = entries.groupBy("a").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total"))
    sums = [0] * d
    for row in per_entry.collect():
        sums[row["a"]] = int(row["total"])
    centre = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    partial = fitted.mapInArrow(lambda batches: _pair_squares(batches, centre), "a int, b int, total string")
    squares = partial.groupBy("a", "b").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    spread = {}
    for row in squares.collect():
        a, b = row["a"], row["b"]
        left = rest[a] if a == b else rest[a] + rest[b]
        spread[a, b] = n * int(row["total"]) - left * left  # n^2 times the variance
    matrix = [[Fraction(0)] * d for _ in range(d)]
    for (a, b), own in spread.items():
        value = own if a == b else Fraction(own - spread[a, a] - spread[b, b], 2)
        matrix[a][b] = matrix[b][a] = Fraction(value) / (n * n)
    return n, sums, matrix


def fit(fitted: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None if it is empty. Each component's largest entry is positive."""
    n, sums, matrix = covariance(fitted)
    if n == 0:
        return None
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in matrix]))
    order = np.argsort(values)[::-1][:components]
    chosen = vectors[:, order]
    largest = np.abs(chosen).argmax(axis=0)
    chosen = chosen * np.where(chosen[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(sum((matrix[k][k] for k in range(len(matrix))), Fraction(0)))
    return Whitening(n, sums, chosen, values[order], trace)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S as exact integers."""
    reach = model.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, model.sums))
    if reach >= 2**63:
        return model.n * x.astype(object) - np.array(model.sums, object)
    return model.n * x - np.array(model.sums, np.int64)


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(centred integers, whitened values); unusable components are nan."""
    centred = _centred(x, model)
    scale = np.where(model.usable(), model.values, np.nan)
    return centred, (centred.astype(np.float64) / model.n) @ model.vectors / np.sqrt(scale)


def _sums(fitted: DataFrame, model: Whitening, means: list[float] | None) -> dict[tuple[int, int], float]:
    """Sums of whitened values (means None; keys (a, a)), or of products of centred ones, over the fit list."""

    def partial(batches):
        used = np.flatnonzero(model.usable())
        total = np.zeros((len(used), len(used)))
        for x in _matrices(batches):
            w = _project(x, model)[1][:, used]
            if means is None:
                total += np.diag(w.sum(axis=0))
            else:
                w = w - np.array(means)
                total += w.T @ w
        a, b = np.triu_indices(len(used))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "v": total[a, b]})

    found = fitted.mapInArrow(partial, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    return {(r["a"], r["b"]): r["v"] for r in found.collect()}


def identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    used = int(model.usable().sum())
    if not used:
        return None
    sums = _sums(fitted, model, None)
    means = [sums[k, k] / model.n for k in range(used)]
    products = _sums(fitted, model, means)
    return max(abs(v / model.n - (a == b)) for (a, b), v in products.items())


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, deviation, whitened, explained) of every row and component; no shuffle."""
    count = len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(count, np.nan)

    def work(batches):
        for batch in batches:
            ids = batch.column("id")
            for start in range(0, len(ids), ROWS):
                part = batch.slice(start, ROWS)
                (x,) = _matrices([part])
                centred, w = _project(x, model)
                if centred.dtype != object and len(centred) and int(np.abs(centred).max()) ** 2 * x.shape[1] >= 2**63:
                    centred = centred.astype(object)
                deviation = pa.array([int(v) for v in (centred * centred).sum(axis=1)], pa.int64())
                row = np.repeat(np.arange(len(x)), count)
                flat = w.reshape(-1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id").take(pa.array(row)),
                        "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        "deviation": deviation.take(pa.array(row)),
                        "whitened": pa.array(flat, mask=np.isnan(flat)),
                        "explained": pa.array(np.tile(explained, len(x)), mask=np.isnan(np.tile(explained, len(x)))),
                    }
                )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(work, f"id {kind}, component int, deviation long, whitened double, explained double")


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of all whole vectors."""
    rows = quantised(vectors, vector, key)
    fitted = fit_list(rows)
    model = fit(fitted, components)
    if model is None:
        kind = dict(rows.dtypes)["id"]
        return rows.sparkSession.createDataFrame(
            [], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    error = identity_error(fitted, model)
    return apply(rows, model).select(
        "id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
