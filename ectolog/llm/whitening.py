"""Embedding whitening: incremental eigendecomposition, then distributed Rayleigh-Ritz refinement.

Vectors become whole numbers ``x = floor(256 c)``; different ones, each once, are
the fit list. Every task grows running spectra of its part of the list by centred
rank-one updates (``spectra``), and spectra of tasks are merged by successive
rank-one updates in a tree. A running spectrum keeps the ``rank`` leading pairs.
What that leaves out is mended by Rayleigh-Ritz steps: a pass over the list
applies the covariance to the basis, the small projected problem is solved, and
the residuals of the leading pairs widen the basis, until the wanted pairs are
exact to double precision; with a basis of all dimensions they are at once.

Sizes: a task holds one Arrow batch and its spectra; the driver holds matrices of
d rows and at most d columns and sums of d longs. Nothing grows with the rows.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries
are dropped; shorter vectors are filled up with zeros to the longest; repeated
rows all return, but count once in the fit; ``deviation`` is null where the exact
number is no long; components without variance (below 1e-9 of the first) have no
``whitened`` and don't count in the error; ``explained`` is null if nothing
varies; there are no more components than dimensions; without rows the result is
empty; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.llm import spectra
from ectolog.llm.rows import stored

WANTED = 4
#: Pairs kept by a running spectrum, and columns by which the basis is widened.
RANK = 16
#: Residual of a wanted pair, relative to the first eigenvalue, that needs no more passes.
EXACT = 1e-13
#: Components with less variance than this part of the first aren't whitened.
NO_VARIANCE = 1e-9
#: Partial results merged by one task.
FAN_IN = 16
LARGEST = 2**63 - 1


def whole(entries: Column) -> Column:
    return F.transform(entries, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))


def usable(entries: Column) -> Column:
    off = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == math.inf)
    return entries.isNotNull() & ~F.coalesce(F.exists(entries, off), F.lit(False))


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``vec_id``, ``x`` of usable rows, and the dimension."""
    found = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("c"))
    found = found.where(usable(F.col("c")))
    size = found.agg(F.max(F.size("c")).alias("most"), F.min(F.size("c")).alias("least")).first()
    x = whole(F.col("c"))
    if size["most"] != size["least"]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size["most"]) - F.size("c")))
    return found.select("vec_id", x.alias("x")), size["most"] or 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension."""
    schema = "dim int, n long, s long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, s = n + len(x), s + x.sum(axis=0)
        columns = [pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), pa.array(s)]
        yield pa.record_batch(columns, ["dim", "n", "s"])

    found = fit.select("x").mapInArrow(run, schema).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rows = found.orderBy("dim").collect()
    return (rows[0]["n"], [r["s"] for r in rows]) if rows else (0, [])


def _tree(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """All ``data`` arrays merged, ``FAN_IN`` at a time, whatever their number."""
    schema = "part long, data array<double>"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [key[0]], "data": [merge([np.asarray(a) for a in rows["data"]])]})

    parts = stored(parts)
    last = parts.agg(F.max("part")).first()[0]
    while last > 0:
        group = F.floor(F.col("part") / FAN_IN).cast("long")
        parts = stored(parts.groupBy(group.alias("group")).applyInPandas(run, schema))
        last //= FAN_IN
    return np.asarray(parts.first()["data"])


def _packed(s: spectra.Spectra) -> np.ndarray:
    return np.concatenate([s.n, s.mean[0], s.values[0], s.vectors[0].ravel()])


def _unpacked(data: np.ndarray, d: int) -> spectra.Spectra:
    r = (len(data) - 1 - d) // (d + 1)
    values, vectors = data[1 + d : 1 + d + r], data[1 + d + r :].reshape(d, r)
    return spectra.Spectra(data[:1].copy(), data[None, 1 : 1 + d].copy(), values[None].copy(), vectors[None].copy())


def running_spectrum(fit: DataFrame, d: int, rank: int = RANK) -> spectra.Spectra:
    """The spectrum of all ``x``: rank-one updates in the tasks, rank-one updates between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            x = _matrix(batch.column(0), d).astype(float)
            if found is None:
                found = spectra.Spectra.empty(spectra.side_by_side(len(x), rank), d)
            spectra.grow(found, x, rank)
        found = spectra.Spectra.empty(1, d) if found is None else spectra.folded(found, rank)
        part = TaskContext.get().partitionId()
        columns = [pa.array([part], pa.int64()), pa.array([_packed(found).tolist()], pa.list_(pa.float64()))]
        yield pa.record_batch(columns, ["part", "data"])

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        every = [_unpacked(p, d) for p in parts]
        # A spectrum of fewer pairs is the cheaper one to add.
        every.sort(key=lambda s: -s.values.shape[1])
        for other in every[1:]:
            every[0].merge(other, rank)
        return _packed(every[0])

    return _unpacked(_tree(fit.select("x").mapInArrow(run, "part long, data array<double>"), merge), d)


def _applied(fit: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times the basis, and its trace: one pass over the fit list."""
    d, m = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, trace = np.zeros((d, m)), 0.0
        for batch in batches:
            off = _matrix(batch.column(0), d) - mean
            product += off.T @ (off @ basis)
            trace += float((off * off).sum())
        part = TaskContext.get().partitionId()
        data = np.append(product.ravel(), trace) / n
        columns = [pa.array([part], pa.int64()), pa.array([data.tolist()], pa.list_(pa.float64()))]
        yield pa.record_batch(columns, ["part", "data"])

    data = _tree(fit.select("x").mapInArrow(run, "part long, data array<double>"), lambda parts: np.sum(parts, axis=0))
    return data[:-1].reshape(d, m), float(data[-1])


def _orthonormal(basis: np.ndarray, new: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` unit columns in the span of ``new`` outside of ``basis``."""
    found = basis[:, :0]
    for column in new.T:
        size = np.linalg.norm(column)
        if found.shape[1] == most or size == 0:
            continue
        column = column / size
        for _ in range(3):
            for known in (basis, found):
                column = column - known @ (known.T @ column)
            size = np.linalg.norm(column)
            if size <= 1e-8:
                break
            column = column / size
        else:
            found = np.column_stack([found, column])
    return found


def refined(
    fit: DataFrame, mean: np.ndarray, n: int, start: np.ndarray, wanted: int, width: int = RANK
) -> tuple[np.ndarray, np.ndarray, float]:
    """(falling eigenvalues, unit eigenvectors as columns, trace) by Rayleigh-Ritz passes."""
    d = len(mean)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthonormal(basis, np.column_stack([start, np.eye(d)]), max(wanted, start.shape[1]))
    while True:
        product, trace = _applied(fit, mean, n, new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        projected = basis.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        rest = image @ turn - vectors * values
        size = np.linalg.norm(rest[:, :wanted], axis=0).max()
        if basis.shape[1] == d or size <= EXACT * abs(values[0]):
            return values[:wanted], vectors[:, :wanted], trace
        # Residuals of the leading pairs; directions of no entry yet if these are used up.
        new = _orthonormal(basis, np.column_stack([rest[:, :width], np.eye(d)]), min(width, d - basis.shape[1]))


@dataclass
class Whitening:
    """A fitted model: exact ``n`` and ``sums``, eigenvalues, eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def weights(self) -> np.ndarray:
        """Eigenvectors over the root of their variance; NaN where there is none."""
        live = self.values > NO_VARIANCE * max(self.values[0], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(live, self.vectors / np.sqrt(self.values), np.nan)

    def explained(self) -> list[float | None]:
        return [max(0.0, float(e)) / self.trace if self.trace > 0 else None for e in self.values]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; None beyond a long."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) <= LARGEST:
        off = n * x - np.asarray(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
    return [value if value <= LARGEST else None for value in exact]


def fit_whitening(vectors: DataFrame, d: int, wanted: int = WANTED, rank: int = RANK) -> Whitening | None:
    """The model of the different ``x`` of ``vectors``; None without any."""
    fit = stored(vectors.select("x").distinct())
    n, sums = _sums(fit, d)
    if n == 0:
        return None
    mean = np.array([s / n for s in sums])
    start = running_spectrum(fit, d, rank).vectors[0][:, ::-1]
    values, found, trace = refined(fit, mean, n, start, min(wanted, d), rank)
    # Either sign is right; the largest entry is made positive.
    found = found * np.sign(found[np.argmax(np.abs(found), axis=0), np.arange(found.shape[1])])
    model = Whitening(n, sums, values, found, trace)
    model.identity_error = _identity_error(fit, model)
    return model


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    live = [k for k, w in enumerate(model.weights().T) if not np.isnan(w).any()]
    if not live:
        return None
    rows = transform(fit.select(F.lit(0).alias("vec_id"), "x"), model)
    pairs = [(i, j) for i in live for j in live if i <= j]
    column = lambda k: F.col("whitened")[k]
    found = rows.agg(*[F.covar_pop(column(i), column(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation``, ``whitened`` (an entry for each component) of each row."""
    d = len(model.sums)
    weights, mean = model.weights(), np.array([s / model.n for s in model.sums])
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(1), d)
            # Over the centred entries, so that nothing is lost by differences of large sums.
            w = (x - mean) @ np.nan_to_num(weights)
            w[:, np.isnan(weights).any(axis=0)] = np.nan
            arrays = pa.ListArray.from_arrays(
                pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)),
                pa.array(w.ravel(), pa.float64(), from_pandas=True),
            )
            columns = [batch.column(0), pa.array(deviations(x, model.n, model.sums), pa.int64()), arrays]
            yield pa.record_batch(columns, ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, schema)


def whiten(
    rows: DataFrame,
    wanted: int = WANTED,
    rank: int = RANK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """A row for each usable row and component: ``vec_id``, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    vectors, d = whole_vectors(rows, id_col, vector_col)
    model = fit_whitening(vectors, d, wanted, rank) if d else None
    if model is None:
        schema = "deviation long, whitened array<double>"
        found = rows.sparkSession.createDataFrame([], schema)
        found = found.withColumn("vec_id", F.lit(None).cast(vectors.schema["vec_id"].dataType))
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    else:
        found = transform(vectors, model)
    parts = F.array(*[F.lit(v).cast("double") for v in model.explained()])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(parts, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
