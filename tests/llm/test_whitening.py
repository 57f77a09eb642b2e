"""Whitening beside dense results."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from ectolog.llm import registry, spectra, whitening

SCHEMA = T.StructType(
    [
        T.StructField("x", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("part", T.StringType()),
        T.StructField("vec_id", T.LongType()),
    ]
)


def grown(x, rank, at_once=None):
    found = spectra.Spectra.empty(at_once or spectra.side_by_side(len(x), rank), x.shape[1])
    spectra.grow(found, x.astype(float), rank)
    return spectra.folded(found, rank)


def cases():
    rng = np.random.default_rng(3)
    yield rng.normal(size=(300, 6)) * 40
    yield rng.integers(-2, 3, size=(500, 12))
    yield np.repeat(rng.integers(-3, 4, size=(5, 8)), 30, axis=0)
    yield np.repeat(np.eye(6), 20, axis=0) * 100
    yield np.ones((40, 4)) * 7
    yield np.zeros((10, 3))
    yield rng.integers(-100, 100, size=(3, 16))
    yield np.concatenate([rng.normal(size=(200, 5)) * 1e-6, rng.normal(size=(200, 5)) * 1e6])


@pytest.mark.parametrize("x", list(cases()))
def test_running_spectrum_is_dense_spectrum(x):
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    size = max(np.linalg.eigvalsh(scatter)[-1], 1e-300)
    for at_once in (None, 1, 4):
        s = grown(x, x.shape[1], at_once)
        q = s.vectors[0]
        assert s.n[0] == len(x) and np.allclose(s.mean[0], x.mean(0), rtol=1e-12, atol=1e-12 * np.abs(x).max())
        assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12
        assert np.abs((q * s.values[0]) @ q.T - scatter).max() < 1e-11 * size
        assert (np.diff(s.values[0]) >= 0).all()


def dense(rows, wanted=4):
    """(row id, component) to what the contract says, from dense numpy results."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = [(i, [math.floor(256 * c) for c in v] + [0] * (d - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array([s / n for s in sums])
    v = a.T @ a / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    out = {}
    for i, c in x:
        off = np.array(c) - np.array([s / n for s in sums])
        far = sum((n * b - s) ** 2 for b, s in zip(c, sums))
        for k in range(len(e)):
            live = e[k] > 1e-9 * e[0]
            w = float(off @ q[:, k] / math.sqrt(e[k])) if live else None
            out.setdefault((i, k + 1), []).append((n, far, w, e[k] / np.trace(v) if np.trace(v) else None))
    return out


def agree(found, rows, tight=1e-9):
    want, got = dense(rows), {}
    for r in found.collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = {}
    for (i, k), many in want.items():
        order = lambda r: (r[0], r[1], abs(r[2] or 0))
        ours = sorted(((r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got[i, k]), key=order)
        for a, b in zip(ours, sorted(many, key=order)):
            assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
            assert a[3] == b[3] or abs(a[3] - b[3]) <= 1e-9 * max(abs(b[3]), 1e-6)
            if b[2] is not None:
                assert abs(abs(a[2]) - abs(b[2])) <= tight
                if abs(b[2]) > 1e-6:
                    assert signs.setdefault(k, a[2] * b[2] > 0) == (a[2] * b[2] > 0)
        for r in got[i, k]:
            assert r["identity_error"] is None or r["identity_error"] <= 1e-9


def test_query_is_dense_result(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    agree(registry.QUERIES["op12_whitening"](spark, sf_dir), [tuple(r) for r in table], 1e-7)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=7) * np.arange(1, 8)).tolist()) for k in range(150)]
    rows += [(1, rows[1][1])] * 40 + [(7, rows[3][1]), (None, rows[4][1])]
    rows += [(200, None), (201, [1.0, None]), (202, [math.nan]), (203, [math.inf] * 7), (204, [-math.inf])]
    rows += [(205, [0.5, -0.5]), (206, []), (207, [-0.0] * 7)]
    table = spark.createDataFrame([("a", v, "b", i) for i, v in rows], SCHEMA).repartition(5)
    for rank in (2, 16):
        agree(whitening.whiten(table, rank=rank), rows)


def test_flat_and_few(spark):
    make = lambda rows: spark.createDataFrame([("a", v, "b", i) for i, v in rows], SCHEMA)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(make([(1, [1.0, 2.0, 3.0])] * 3)).collect()
    assert len(one) == 9 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one} == {(1, 0, None, None)}
    few = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [0.0, 2.0, 3.5, 4.0, 5.0])]
    agree(whitening.whiten(make(few)), few)
    # Beyond a long there is no exact deviation.
    far = whitening.whiten(make([(1, [1e9, 0.0]), (2, [-1e9, 1.0])])).collect()
    assert {r["deviation"] for r in far} == {None}


def test_sums_of_large_numbers():
    x = np.array([[3, -5], [2**20, 1]], np.int64)
    n, sums = 10**6, [10**9 + 7, -(10**8)]
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 2**63 else None for w in want]
