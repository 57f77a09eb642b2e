"""Penalised least squares with one block of coefficients per individual.

The model is ``y = X β + Z_i b_i + e`` where the block of individual i is
penalised by ``P`` (a random intercept is one column with a ridge; a curve per
individual is a spline block). Eliminating the blocks leaves sums over
individuals of p x p matrices, so one pass gives everything needed for a whole
grid of penalties:

    X'X, X'y, y'y                        (no block)
    Σ C'B⁻¹C, Σ C'B⁻¹z, Σ z'B⁻¹z, Σ log|B|   with B = Z'Z + P, C = Z'X, z = Z'y
    Σ tr(B⁻¹P), Σ C'B⁻¹PB⁻¹C, Σ C'B⁻¹PB⁻¹z, Σ z'B⁻¹PB⁻¹z

Rows come in as cells (id, design levels) -> (n, Σy, Σ(y - mean)²). The number
of cells of one individual is bounded by the design (temperature bins x
factor levels), whatever the number of readings. Tasks get codes and counts, and
make one design row for each combination that occurs. Z'Z, Z'X and Z'y of every
individual are summed and stored once; a pass over penalties reads only these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.session import settle
from ectolog.stats.design import Design, spline_values


@dataclass
class Sums:
    """Sums for one penalty."""

    n: float
    ids: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    cc: np.ndarray
    cz: np.ndarray
    zz: float
    logdet: float
    tr: float
    cpc: np.ndarray
    cpz: np.ndarray
    zpz: float


def whole_ids(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no individual is split between two."""
    rest = None
    for pdf in batches:
        if rest is not None and len(rest):
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        cut = int((pdf[key] != last).sum())
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def by_individual(cells: DataFrame, id_col: str) -> DataFrame:
    """Put each individual's cells together, once, for all later passes.

    The checkpoint keeps the partitions as written, so a search over many
    penalties needs no further shuffle.
    """
    return settle(cells.repartition(id_col).sortWithinPartitions(id_col))


#: Individuals whose cells are counted at once, and whose blocks are solved at once.
COUNTED = 64
SOLVED = 2048


@dataclass
class Parts:
    """Sums over all cells, and those of each individual as a stored table of rows ``v``."""

    p: int
    k: int
    fixed: np.ndarray
    blocks: DataFrame | None


class _Rows:
    """The design rows of a batch's cells, one for each combination of levels and x."""

    def __init__(self, pdf: pd.DataFrame, design: Design, kind: str | None):
        codes = {c: pdf[c].to_numpy() for c in pdf.columns if c.startswith("_f_")}
        x, at = np.unique(pdf["_x"].to_numpy(float), return_inverse=True)
        for f, levels in design.factors.items():
            at = at * (len(levels) + 1) + codes[f"_f_{f}"] + 1
        _, first, self.at = np.unique(at, return_index=True, return_inverse=True)
        x = pdf["_x"].to_numpy(float)[first]
        self.x = design.values({c: v[first] for c, v in codes.items()}, x)
        self.z = spline_values(x, design.lo, design.hi, design.size) if kind == "curve" else np.ones((len(x), 1))

    def sums(self, who: np.ndarray, size: int, weight: np.ndarray) -> np.ndarray:
        """``weight`` by individual and combination."""
        width = len(self.x)
        return np.bincount(who * width + self.at, weight, size * width).reshape(size, width)


def _together(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch of whole individuals, ``COUNTED`` of them at a time; ``_who`` numbers them."""
    ids = pdf["_id"]
    who = np.cumsum(np.r_[0, ids.to_numpy()[1:] != ids.to_numpy()[:-1]]) if len(pdf) else np.zeros(0, np.int64)
    pdf = pdf.assign(_who=who)
    for at in range(0, int(who[-1]) + 1 if len(who) else 0, COUNTED):
        low, high = np.searchsorted(who, [at, at + COUNTED])
        part = pdf.iloc[low:high]
        yield part.assign(_who=part["_who"] - at)


def _parts(pdf: pd.DataFrame, rows: _Rows):
    """Z'Z, Z'X and Z'y of each individual."""
    who = pdf["_who"].to_numpy(np.int64)
    size = int(who[-1]) + 1
    n, sy = (rows.sums(who, size, pdf[c].to_numpy(float)) for c in ("_n", "_sy"))
    k, p = rows.z.shape[1], rows.x.shape[1]
    zz = (n @ (rows.z[:, :, None] * rows.z[:, None, :]).reshape(-1, k * k)).reshape(size, k, k)
    zx = (n @ (rows.z[:, :, None] * rows.x[:, None, :]).reshape(-1, k * p)).reshape(size, k, p)
    return n, sy, zz, zx, sy @ rows.z


def _cell_columns(cells: DataFrame, id_col: str | None, design: Design, *more: str) -> DataFrame:
    return cells.select(
        (F.col(id_col) if id_col else F.lit(0)).alias("_id"),
        *design.codes(),
        F.col("n").cast("double").alias("_n"),
        F.col("sy").cast("double").alias("_sy"),
        *more,
    )


def individual_parts(cells: DataFrame, id_col: str | None, design: Design, kind: str | None) -> Parts:
    """The sums of one model, from one pass over the cells.

    With blocks, the cells must come from :func:`by_individual`.
    """
    p = len(design.names())
    k = 0 if kind is None else design.size if kind == "curve" else 1
    rows = _cell_columns(cells, id_col if kind else None, design, F.col("syy").alias("_syy"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed = np.zeros(p * p + p + 3)
        for pdf in whole_ids(batches, "_id") if kind else batches:
            blocks = []
            for part in _together(pdf):
                found = _Rows(part, design, kind)
                n, sy, zz, zx, zy = _parts(part, found)
                size = len(n)
                n, sy = n.sum(axis=0), sy.sum(axis=0)
                xx = (found.x * n[:, None]).T @ found.x
                fixed += np.r_[xx.ravel(), found.x.T @ sy, part["_syy"].sum(), n.sum(), size]
                if kind:
                    blocks.append(np.concatenate([zz.reshape(size, -1), zx.reshape(size, -1), zy], axis=1))
            if blocks:
                yield pd.DataFrame({"fixed": False, "v": list(np.concatenate(blocks))})
        yield pd.DataFrame({"fixed": [True], "v": [fixed]})

    found = settle(rows.mapInPandas(run, "fixed boolean, v array<double>"))
    total = found.where("fixed").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    fixed = np.zeros(p * p + p + 3)
    for i, v in total.collect():
        fixed[i] = v
    if not kind:
        fixed[-1] = 0
    return Parts(p, k, fixed, found.where("NOT fixed").select("v") if kind else None)


def block_sums(parts: Parts, penalties: Sequence[np.ndarray]) -> list[Sums]:
    """One pass over the individuals; a list of :class:`Sums`, one per penalty."""
    p, k = parts.p, parts.k
    width = 2 * p * p + 2 * p + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(penalties), width))
        for batch in batches:
            held = batch.column(0).flatten().to_numpy().reshape(-1, k * k + k * p + k)
            for at in range(0, len(held), SOLVED):
                part = held[at : at + SOLVED]
                zz, zx = part[:, : k * k].reshape(-1, k, k), part[:, k * k : -k].reshape(-1, k, p)
                # Z'X and Z'y side by side: one product gives all sums of a kind.
                right = np.concatenate([zx, part[:, -k:, None]], axis=2)
                for t, pen in enumerate(penalties):
                    b = zz + pen[None]
                    inverse = np.linalg.inv(b)
                    solved = inverse @ right
                    flat = solved.reshape(-1, p + 1)
                    plain = right.reshape(-1, p + 1).T @ flat
                    bent = flat.T @ (pen @ solved).reshape(-1, p + 1)
                    sums[t] += np.r_[
                        plain[:p, :p].ravel(), plain[:p, p], plain[p, p], np.linalg.slogdet(b)[1].sum(),
                        (inverse * pen).sum(), bent[:p, :p].ravel(), bent[:p, p], bent[p, p],
                    ]
        held = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * width, pa.array(sums.ravel()))
        yield pa.record_batch([pa.array(range(len(sums)), pa.int32()), held], ["t", "v"])

    flat = np.zeros((len(penalties), width))
    if parts.blocks is not None:
        found = parts.blocks.mapInArrow(run, "t int, v array<double>")
        total = found.select("t", F.posexplode("v").alias("i", "v")).groupBy("t", "i").agg(F.sum("v").alias("v"))
        for t, i, v in total.collect():
            flat[t, i] = v
    f = parts.fixed
    xx, xy = f[: p * p].reshape(p, p), f[p * p : p * p + p]
    yy, n, ids = f[p * p + p :]
    out = []
    for s in flat:
        a, b = p * p, p * p + p
        c = b + 3
        out.append(
            Sums(
                n, ids, xx, xy, yy,
                s[:a].reshape(p, p), s[a:b], s[b], s[b + 1], s[b + 2],
                s[c : c + a].reshape(p, p), s[c + a : c + a + p], s[c + a + p],
            )
        )
    return out


def predict_cells(
    cells: DataFrame,
    id_col: str,
    design: Design,
    kind: str,
    penalty: np.ndarray,
    beta: np.ndarray,
    hinv: np.ndarray,
    sigma2: float,
    keep: Sequence[str],
    offset: float,
) -> DataFrame:
    """Fitted value and standard error of every cell, its own block included.

    Cells with ``n = 0`` add nothing to a block and are only predicted.
    ``cells`` must hold each individual's rows together, sorted by individual.
    """
    rows = _cell_columns(cells, id_col, design, *keep)
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["fit double", "se double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_ids(batches, "_id"):
            for part in _together(pdf):
                found = _Rows(part, design, kind)
                _, _, zz, zx, zy = _parts(part, found)
                inverse = np.linalg.inv(zz + penalty[None])
                coef = np.einsum("ikl,il->ik", inverse, zy - zx @ beta)
                fixed = found.x @ beta + offset
                who = part["_who"].to_numpy()
                ends = np.searchsorted(who, np.arange(len(zz) + 1))
                fit, var = np.empty(len(part)), np.empty(len(part))
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    at = found.at[a:b]
                    x, z = found.x[at], found.z[at]
                    pull = z @ inverse[i]
                    away = x - pull @ zx[i]
                    fit[a:b] = fixed[at] + z @ coef[i]
                    var[a:b] = np.einsum("mk,mk->m", pull, z) + np.einsum("mp,mp->m", away @ hinv, away)
                out = part[list(keep)].copy()
                out["fit"] = fit
                out["se"] = np.sqrt(np.maximum(var * sigma2, 0))
                yield out

    return rows.mapInPandas(run, schema)


def predict_fixed(
    rows: DataFrame,
    x_cols: Sequence[Column],
    beta: np.ndarray,
    cov: np.ndarray,
    keep: Sequence[str],
) -> DataFrame:
    """Fitted value and standard error from the fixed part alone."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["fit double", "se double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf["_x"].to_numpy())
            out = pdf[list(keep)].copy()
            out["fit"] = x @ beta
            out["se"] = np.sqrt(np.maximum(np.einsum("mp,pq,mq->m", x, cov, x), 0))
            yield out

    return rows.select(F.array(*x_cols).alias("_x"), *keep).mapInPandas(run, schema)
