"""Whitening against a dense eigendecomposition; exact sums; odd rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from verdica.llm import queries, whitening


def table(spark, vectors, kind="double"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n int, whitened double").repartition(5)


def dense(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)) + 1e6
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > whitening.RANK * e[0]).sum()))
    return e[:k], u[:, :k], c, e.sum()


def compare(frame, vectors, ids=None):
    e, u, c, trace = dense(vectors)
    got = frame.toPandas()
    ids = list(range(len(vectors))) if ids is None else ids
    assert sorted(got.groupby("vec_id").size()) == [len(e)] * len(ids) and set(got.vec_id) == set(ids)
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = c @ u / np.sqrt(e)
    want *= np.sign((want * w).sum(axis=0))
    assert np.abs(w - want).max() < 1e-7
    assert np.allclose(got.groupby("component").explained.first(), e / trace, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] <= 1e-9 and set(got.n) == {len(vectors)}
    assert np.abs(w.T @ w / len(w) - np.eye(len(e))).max() <= 1e-9
    x = [[math.floor(64 * v) + 1_000_000 for v in row] for row in vectors]
    sums = [sum(col) for col in zip(*x, strict=True)]
    assert {int(r.vec_id): int(r.deviation) for r in got.itertuples()} == {i: sum((len(x) * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in zip(ids, x, strict=True)}


def spectrum(n, d, fall, seed=1):
    rng = np.random.default_rng(seed)
    return ((rng.standard_normal((n, d)) * np.array([fall**i for i in range(d)])) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).tolist()


@pytest.mark.parametrize(("n", "d", "fall"), [(400, 64, 1.0), (300, 64, 0.9), (200, 24, 0.8), (30, 50, 1.0), (60, 1, 1.0)])
def test_like_dense(spark, n, d, fall):
    vectors = spectrum(n, d, fall)
    compare(whitening.whitened(table(spark, vectors)), vectors)


@pytest.mark.parametrize(("fall", "columns"), [(0.3, 8), (1.0, 40)])
def test_blocks_grow_where_residuals_fail(spark, fall, columns):
    """A falling spectrum is found in a narrow block; a flat one takes the whole space. Both give the same as dense."""
    vectors = (100 * np.array(spectrum(300, 40, fall))).tolist()
    frame = table(spark, vectors).select("embedding")
    d, about = whitening.centre(frame)
    e, found, trace, used = whitening.components(frame, d, about, k=2, oversampling=6, passes=14)
    want, u, _, total = dense(vectors, 2)
    assert used == columns and np.allclose(e, want, rtol=1e-12) and abs(trace - total) < 1e-9 * total
    assert np.abs(np.abs((found * u).sum(axis=0)) - 1).max() < 1e-12


def test_odd_rows(spark):
    good = spectrum(60, 12, 0.9)
    bad = [None, [], [None] * 12, [1.0] * 11 + [None], [1.0] * 11 + [math.nan], [math.inf] * 12, [1.0] * 5, [1.0] * 13, [2.0**57] + [0.0] * 11]
    mixed = good[:20] + bad + good[20:]
    ids = [i for i, v in enumerate(mixed) if v in good]
    for kind in ("double", "float"):
        frame = table(spark, mixed, kind)
        compare(whitening.whitened(frame), (np.array(good, np.float32) if kind == "float" else np.array(good)).astype(float).tolist(), ids)
    copies = [*good, *[good[0]] * 200]  # a hot vector
    compare(whitening.whitened(table(spark, copies)), copies)


def test_without_spread(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 9):
        out = whitening.whitened(table(spark, vectors))
        assert not out.count() and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_less_rank_than_components(spark):
    vectors = [[i, 2 * i, 5.0, -i] for i in range(50)]
    compare(whitening.whitened(table(spark, vectors)), vectors)
    assert {r.component for r in whitening.whitened(table(spark, vectors)).collect()} == {1}


def test_large_numbers_are_exact(spark):
    x = np.array([[1 << 61, 5], [-(1 << 61), 7], [3, 9]])
    about = whitening.Centre(3, [int(a) for a in x.astype(object).sum(axis=0)])
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, about.sums, strict=True)) for row in x]
    small = whitening.Centre(3, about.sums)
    assert small.numerators(x).dtype == object
    assert [int(v) for v in small.deviations(x).to_pylist()] == want and max(want) > 1 << 120
    with pytest.raises((pa.ArrowInvalid, ValueError)):  # beyond 38 digits
        whitening.Centre(9, [0, 0]).deviations(x)
    y = x // (1 << 30)
    about = whitening.Centre(3, [int(a) for a in y.sum(axis=0)])
    assert [int(v) for v in about.deviations(y).to_pylist()] == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, about.sums, strict=True)) for row in y]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    out = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes)["deviation"] == "bigint"
    compare(out, [list(r.embedding) for r in rows], [r.vec_id for r in rows])
