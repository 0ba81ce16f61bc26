"""Embedding whitening with principal components from FEAST contour integration.

Vectors become whole numbers, so the covariance's numerators are summed exactly, in any order, and V is rounded once. The
eigenvalues asked for are the largest; `spans_of` finds intervals that hold them by bisection on inertia counts (signs
of the pivots of a symmetric factorisation of V - shift). In each interval, `feast` turns a block of vectors into one that lies in the
interval's eigenspace: the contour integral of (z - V)^-1 around it, by Gauss-Legendre quadrature of complex shifted solves.
Rayleigh-Ritz takes the components out of that block, and the two steps repeat until the residual is down to rounding. The
inertia count says how many there are: an interval that gave another number is solved again with a larger block, so none is missed.

Scale: three passes over the vectors, without a shuffle of vectors: sums, centred products, and the check of the whitened
covariance; then the projection itself. A task keeps matrices of the dimension's square; they are added by a
grouped sum on (i, j), and the driver gets that matrix once and solves it (dimensions up to a few thousand; bounded by the
vectors' width, never by rows). The input is read four times; save it first if it is costly to make.

Defined cases: vectors that are null, or hold null or non-finite entries, or entries of 2^51 or more (whose centred numbers may leave 64 bits), take no
part; of several lengths the most frequent counts (ties: the longer), others count as incomplete; null ids and repeated rows are
rows like others; components of eigenvalue 0 (to rounding) have no whitened value and are left out, so equal vectors alone give no rows; ties of eigenvalues
give any orthonormal set of that eigenspace, the same for all rows; deviations beyond 64 bits are null; very long vectors make larger matrices; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
NODES, SPAN, ROUNDS, SEED = 16, 8, 12, 13
#: Blocks of rows whose products are exact in doubles while entries are below SMALL; what is added up goes out after FLUSH blocks.
BLOCK, SMALL, FLUSH = 4096, 1 << 20, 256
LIMB = 40


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part, but for their length."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(2.0**51)))
    return vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & fits)


def _numbers(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of that width in the batch, their whole numbers)."""
    offsets = column.offsets.to_numpy()
    at = np.flatnonzero(np.diff(offsets) == width)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    own = flat[offsets[:-1][at][:, None] + np.arange(width)]
    return at, np.floor(SCALE * own).astype(np.int64) + SHIFT


def _limbs(values) -> tuple[pa.Array, pa.Array]:
    """Whole numbers as high and low parts whose sums can't overflow."""
    split = [(int(v) >> LIMB, int(v) & ((1 << LIMB) - 1)) for v in values]
    return pa.array([Decimal(h) for h, _ in split], pa.decimal128(38, 0)), pa.array([low for _, low in split], pa.int64())


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """Whole numbers added up by keys, in their two parts."""
    return parts.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def _joined(row) -> int:
    return (int(row["high"]) << LIMB) + int(row["low"])


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, per-dimension sums) of the vectors of the most frequent length."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in it:
            column = batch.column(0)
            for width in np.unique(np.diff(column.offsets.to_numpy())).tolist():
                at, x = _numbers(column, width)
                parts = ((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())
                held = total.setdefault(width, [0, [0] * width])
                held[0] += len(at)
                held[1] = [s + (h << 32) + low for s, h, low in zip(held[1], *parts, strict=True)]
        for width, (n, s) in total.items():
            high, low = _limbs([n, *s])
            yield pa.RecordBatch.from_arrays([pa.array([width] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()), high, low], ["width", "i", "high", "low"])

    found = _added(vectors.select("embedding").mapInArrow(partial, "width int, i int, high decimal(38,0), low long"), "width", "i")
    counts = found.filter("i = -1").select("width", (F.col("high") * F.lit(1 << LIMB) + F.col("low")).alias("n"))
    best = counts.orderBy(F.col("n").desc(), F.col("width").desc()).limit(1).first()
    if best is None or best["width"] == 0:
        return 0, []
    rows = {r["i"]: _joined(r) for r in found.filter(F.col("width") == best["width"]).collect()}
    return rows[-1], [rows[i] for i in range(best["width"])]


def covariance(vectors: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """(V, centre, sums of the centred numbers). Numbers are centred by whole numbers next to the means; what is left of the means is taken off exactly."""
    width = len(total)
    centre = [s // n for s in total]
    around = np.array(centre, np.int64)
    i_at, j_at = np.triu_indices(width)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(products) -> pa.RecordBatch:
            high, low = _limbs(products[i_at, j_at].tolist())
            return pa.RecordBatch.from_arrays([pa.array(i_at, pa.int32()), pa.array(j_at, pa.int32()), high, low], ["i", "j", "high", "low"])

        held, blocks = np.zeros((width, width), np.int64), 0
        for batch in it:
            _, x = _numbers(batch.column(0), width)
            for lo in range(0, len(x), BLOCK):
                d = x[lo : lo + BLOCK] - around
                if np.abs(d).max(initial=0) >= SMALL:  # products in whole numbers of any size
                    yield out(d.astype(object).T @ d.astype(object))
                    continue
                d = d.astype(np.float64)
                held, blocks = held + (d.T @ d).astype(np.int64), blocks + 1
                if blocks == FLUSH:
                    yield out(held)
                    held, blocks = np.zeros((width, width), np.int64), 0
        if blocks:
            yield out(held)

    found = _added(vectors.select("embedding").mapInArrow(partial, "i int, j int, high decimal(38,0), low long"), "i", "j")
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    v = np.zeros((width, width))
    for r in found.collect():  # a cell of the covariance each
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * _joined(r) - rest[i] * rest[j]) / (n * n)
    return v, centre, rest


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric v are above shift: positive pivots of v - shift, single or in pairs."""
    a = v - shift * np.eye(len(v))
    count, alpha = 0, (1 + np.sqrt(17)) / 8
    while len(a):
        p = int(np.abs(np.diag(a)).argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(off.argmax(), off.shape)
        if abs(a[p, p]) >= alpha * off[r, s]:
            if a[p, p] == 0:
                break
            count += a[p, p] > 0
            keep = np.arange(len(a)) != p
            a = a[np.ix_(keep, keep)] - np.outer(a[keep, p], a[keep, p]) / a[p, p]
        else:
            count += 1  # such a pair has one pivot of each sign
            keep, pair = ~np.isin(np.arange(len(a)), (r, s)), [r, s]
            a = a[np.ix_(keep, keep)] - a[np.ix_(keep, pair)] @ np.linalg.solve(a[np.ix_(pair, pair)], a[np.ix_(pair, keep)])
        a = (a + a.T) / 2
    return int(count)


def spans_of(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the k largest eigenvalues, and few more, none twice; of eigenvalues that are 0 to rounding none."""
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    if top == 0:
        return []
    least = 4 * len(v) * np.finfo(float).eps * top
    narrow = 64 * np.finfo(float).eps * top
    k = min(k, above(v, least))
    low, high = least, top  # above(low) is at least k
    while high - low > narrow:
        middle = (low + high) / 2
        n = above(v, middle)
        if n >= k:
            low = middle
            if n <= k + SPAN // 2:
                break
        else:
            high = middle
    todo, spans = [(low, top, above(v, low))] if k else [], []
    while todo:
        low, high, n = todo.pop()
        if n <= SPAN or high - low <= narrow:
            spans += [(low, high, n)] if n else []
            continue
        middle = (low + high) / 2
        upper = above(v, middle) - above(v, high)
        todo += [(low, middle, n - upper), (middle, high, upper)]
    return spans


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the interval, which holds `count`."""
    centre, radius = (low + high) / 2, (high - low) / 2 * (1 + 1e-6) + np.finfo(float).eps * abs(high)
    x, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (x + 1))  # the upper half circle; the lower one is its conjugate
    size = min(len(v), 2 * count + SPAN)
    rng = np.random.default_rng(SEED)
    while True:
        y, best = rng.standard_normal((len(v), size)), np.inf
        for _ in range(ROUNDS):
            q = sum(w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(len(v)) - v, y)).real for w, t in zip(weight, turn, strict=True))
            u, s, _ = np.linalg.svd(q, full_matrices=False)
            u = u[:, s > 1e-13 * s[0]]
            ritz, inner = np.linalg.eigh(u.T @ v @ u)  # Rayleigh-Ritz in the block
            y = u @ inner
            held = (ritz > low - narrow_of(v)) & (ritz <= high + narrow_of(v))
            residual = np.abs(v @ y[:, held] - y[:, held] * ritz[held]).max(initial=0)
            if held.sum() >= count and (residual <= 8 * np.finfo(float).eps * abs(high) or residual > best / 2):
                order = np.argsort(-ritz[held], kind="stable")[:count]
                return ritz[held][order], y[:, held][:, order]
            best = min(best, residual) if held.sum() >= count else best
        if size == len(v):
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high}: {int(held.sum())} found")
        size = min(len(v), 2 * size)


def narrow_of(v: np.ndarray) -> float:
    """Rounding of an eigenvalue of v."""
    return 8 * np.finfo(float).eps * float(np.abs(v).sum(1).max())


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the k largest, falling; fewer where v has a lower rank."""
    parts = [feast(v, *span) for span in spans_of(v, k)]
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    basis, _ = np.linalg.qr(np.column_stack([p[1] for p in parts]))  # neighbours in two intervals are made orthogonal
    values, inner = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = basis @ inner[:, order]
    largest = np.abs(vectors).argmax(0)
    return values[order], vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


@dataclass
class Whitening:
    n: int
    centre: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        d = (x - np.array(self.centre, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return d @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
        d = x - np.array(self.centre, np.int64)
        near = ((self.n * d.astype(np.float64) - np.array(self.rest, np.float64)) ** 2).sum(1)
        if near.max(initial=0) < 2.0**62:
            return ((self.n * d - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * d.astype(object) - np.array(self.rest, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """None without vectors. vectors: vec_id, embedding, as `usable` gives them."""
    n, total = sums(vectors)
    if not n:
        return None
    v, centre, rest = covariance(vectors, n, total)
    values, own = components(v, k)
    return Whitening(n, centre, rest, values, own, float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity."""
    width, k = len(model.centre), len(model.values)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k + 1))
        for batch in it:
            _, x = _numbers(batch.column(0), width)
            y = np.column_stack([np.ones(len(x)), model.project(x)])
            held += y.T @ y
        i, j = (a.ravel() for a in np.indices(held.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held.ravel())], ["i", "j", "s"])

    found = vectors.select("embedding").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    moments = np.zeros((k + 1, k + 1))
    for r in found.collect():
        moments[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component. vectors: vec_id, embedding."""
    rows = usable(vectors)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, k)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    width, found, error = len(model.centre), len(model.values), identity_error(rows, model)

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, x = _numbers(batch.column(1), width)
            ids = batch.column(0).take(pa.array(np.repeat(at, found)))
            each = [np.tile(a, len(at)) for a in (np.arange(1, found + 1, dtype=np.int32), model.values / model.trace)]
            deviation = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), found)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(each[0]), pa.array(np.full(len(ids), model.n)), deviation, pa.array(model.project(x).ravel()), pa.array(each[1]), pa.array(np.full(len(ids), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
