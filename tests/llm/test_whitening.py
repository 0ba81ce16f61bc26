"""Whitening against NumPy's eigenvectors, whole-number sums in Python, and the contract's error bounds."""

from fractions import Fraction

import numpy as np
import pytest

from inkfold.llm import queries
from inkfold.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(ids, x, n, S, V) by definition, in whole numbers."""
    kept = [(i, e) for i, e, *_ in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    x = [[int(np.floor(1024 * float(np.float32(v)))) + 100_000 for v in e] for _, e in kept]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    v = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(len(s))] for i in range(len(s))]
    return [i for i, _ in kept], np.array(x, object), n, np.array(s, object), np.array(v)


def holds(rows, got, k=8):
    ids, x, n, s, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(k, int((values > 1e-9 * values[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert set(by) == set(range(1, rank + 1)) and len(got) == rank * n
    want = ((x.astype(np.float64) - (s / n).astype(np.float64)) @ vectors[:, :rank]) / np.sqrt(values[:rank])
    deviation = {i: int(((n * r - s) ** 2).sum()) for i, r in zip(ids, x, strict=True)}
    shown = np.zeros((n, rank))
    for c, rows_of in by.items():
        own = np.array([rows_of[i].pop().whitened for i in ids])
        shown[:, c - 1] = own
        gap = min([abs(values[c - 1] - values[j]) for j in range(len(values)) if j != c - 1], default=1) / values[0]
        if gap > 1e-6:
            assert np.abs(own - np.sign(own @ want[:, c - 1]) * want[:, c - 1]).max() < 1e-8 / gap
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-9
    assert np.abs(np.cov(shown.T, bias=True).reshape(rank, rank) - np.eye(rank)).max() < 1e-8


def vectors(n, width, seed=1, rank=None):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, rank or width)) @ rng.standard_normal((rank or width, width)) * 0.3 + rng.standard_normal(width)
    return [(i, [float(v) for v in np.float32(e)], 0) for i, e in enumerate(base)]


@pytest.mark.parametrize(("n", "width"), [(300, 16), (9, 5), (2, 3), (40, 1), (12, 30)])
def test_against_numpy(spark, n, width):
    rows = vectors(n, width)
    holds(rows, W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def test_odd_vectors(spark):
    rows = [*vectors(50, 6), (90, None, 1), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (92, [float("nan")] * 6, 1), (93, [float("inf")] + [0.0] * 5, 1), (3, vectors(50, 6)[3][1], 2)]
    got = W.whiten(spark.createDataFrame([*rows, (94, [], 1), (95, [1.0], 1), (96, [3e38] + [0.0] * 5, 1)], SCHEMA)).collect()
    holds(rows, got)
    assert not {90, 91, 92, 93, 94, 95, 96} & {r.vec_id for r in got}
    null = [(None, v, 1) for _, v, _ in vectors(5, 3)]
    assert {r.vec_id for r in W.whiten(spark.createDataFrame(null, SCHEMA)).collect()} == {None}
    for none in ([], [(1, None, 1)], [(1, [0.5, 0.25], 1)], [(i, [0.5, 0.25], 1) for i in range(9)], [(1, [], 1)]):
        assert W.whiten(spark.createDataFrame(none, SCHEMA)).collect() == []
    clash = spark.createDataFrame([(*r, 1, 2.0) for r in vectors(20, 4)], SCHEMA + ", component int, `high.low` double")
    holds(vectors(20, 4), W.whiten(clash).collect())


def test_large_numbers(spark):
    """Products beyond doubles and beyond 64 bits are exact."""
    for size in (3e3, 1e9):
        rows = [(i, [float(np.float32(v * size)) for v in e], 0) for i, e, _ in vectors(30, 4)]
        x, n, s, v = plain(rows)[1:]
        got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
        model = W.fit(W.usable(spark.createDataFrame(rows, SCHEMA)))
        values = np.linalg.eigvalsh(v)[::-1]
        assert np.allclose(model.values, values, rtol=1e-9, atol=1e-13 * values[0]) and model.trace == pytest.approx(np.trace(v), rel=1e-15)
        want = {i: int(((n * r - s) ** 2).sum()) for i, r in enumerate(x)}
        assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got) and max(r.identity_error for r in got) < 1e-6


def test_inertia_and_intervals():
    rng = np.random.default_rng(3)
    for width in (1, 2, 7, 40):
        a = rng.standard_normal((width, width))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        assert all(W.above(a, t) == (values > t).sum() for t in [0, 0.5, -2, *(values[:-1] + values[1:]) / 2])
    assert W.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1 and W.above(np.zeros((3, 3)), 0) == 0


@pytest.mark.parametrize(
    "spectrum",
    [np.linspace(1, 2, 64), np.ones(20), np.r_[np.full(8, 2.0), np.full(20, 1.0)], np.r_[5.0, np.full(11, 1.0)], 10.0 ** -np.arange(0, 15.0), np.r_[3, 3 - 1e-12, 2, np.zeros(9)], np.r_[1.0, 1 - 1e-9, 1 - 2e-9, np.linspace(0.5, 0.9, 30)]],
)
def test_spectra(spectrum):
    """Close, equal and vanishing eigenvalues: none is missed, and vectors are unit and orthogonal to rounding."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))
    v = q * spectrum @ q.T
    v = (v + v.T) / 2
    values, vectors_ = W.components(v, 8)
    want = np.sort(spectrum)[::-1][: len(values)]
    assert len(values) == min(8, (spectrum > 4 * len(v) * 2.3e-16 * np.abs(v).sum(1).max()).sum()) and np.allclose(values, want, rtol=0, atol=1e-13 * want[0])
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max() < 1e-12 and np.abs(v @ vectors_ - vectors_ * values).max() < 1e-13 * len(v) * want[0]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    holds(rows, got.collect())
