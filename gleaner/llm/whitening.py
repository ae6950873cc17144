"""Operator 11: whitening of embeddings by an incremental eigendecomposition.

Each partition keeps count, mean and spectrum of what it has read: a vector changes the centred
scatter by one rank, and the new spectrum follows from the old one by the secular equation, with
components deflated that the change doesn't touch or that have equal values. The spectra of
partitions are combined in a tree, each by as many rank-one changes as it has components and one
for the distance of the means. The basis that this gives is refined by two rounds of Rayleigh-Ritz
over all vectors: each centred vector is projected on it, the small covariance of the projections
is summed over the partitions, and its eigenvectors turn the basis. Only matrices of dimension x
dimension leave a task, and each task combines a few of them.

Entries become integers (floor of 64 times the entry), so sums and deviations are exact, and
vectors are centred as integers before anything is multiplied.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped, as are
those whose length isn't the commonest (of equally common ones the greatest); rows that repeat a
vec_id (null too) or a vector count each; directions without variance (RANK_TOLERANCE of the
greatest) are no components, so one vector, or equal ones, give no rows, and neither does an empty
table; equal eigenvalues may come in any order; a deviation beyond 64 bits is null; entries whose
64-fold is beyond 2^31 count as that; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, pick

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Share of the greatest eigenvalue up to which one counts as 0.
RANK_TOLERANCE = 1e-12
#: Summaries that a task combines, and rounds of refinement.
FAN, ROUNDS = 8, 2
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Row j: the distances from root j of 1 + sum(z2 / (poles - root)) to all poles (poles - root).

    Poles ascend strictly and z2 > 0. Root j lies behind pole j; it is sought as a distance from the
    nearer pole, by a rational model of both sides' sums, in a bracket that is halved where the model leaves it."""
    k = len(poles)
    gap = np.append(np.diff(poles), z2.sum())
    side = np.tri(k)  # poles up to the root
    last = np.arange(k) == k - 1
    from_left = poles[None] - poles[:, None]
    middle = 1 + (z2 / (from_left - gap[:, None] / 2)).sum(1)
    left = (middle >= 0) | last
    anchor = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    away = poles[None] - poles[anchor][:, None]
    lo = np.where(left, 0, -gap / 2)
    hi = np.where(last, gap, np.where(left, gap / 2, 0))
    tau = (lo + hi) / 2
    d1 = away[np.arange(k), np.arange(k)]
    e2 = np.append(away[np.arange(k - 1), np.arange(1, k)], 0)  # the last root has no pole above
    with np.errstate(all="ignore"):
        for _ in range(100):
            inverse = 1 / (away - tau[:, None])
            term = z2 * inverse
            psi = np.einsum("ij,ij->i", term, side)
            phi = term.sum(1) - psi
            f = 1 + psi + phi
            lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
            done = (np.abs(f) <= 4 * _EPS * k * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            term *= inverse
            dpsi = np.einsum("ij,ij->i", term, side)
            dphi = term.sum(1) - dpsi
            dphi[-1] = 0
            n1, n2 = d1 - tau, e2 - tau
            c, q, s = 1 + psi - dpsi * n1 + phi - dphi * n2, dpsi * n1 * n1, dphi * n2 * n2
            a, b = c * (d1 + e2) + q + s, c * d1 * e2 + q * e2 + s * d1
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            model = np.where(last, d1 + q / c, np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c)))
            model = np.where((model > lo) & (model < hi), model, (lo + hi) / 2)
            tau = np.where(done, tau, model)
    return away - tau[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of vectors diag(values) vectors' + change change'."""
    z, values = vectors.T @ change, values.copy()
    size = float(z @ z)
    small = 8 * _EPS * max(float(np.abs(values).max(initial=0)), size)
    if size <= small * _EPS:
        return values, vectors
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > small)
    kept = []
    if len(live) > 1 and (np.diff(values[live]) <= 2 * np.sqrt(small * max(size, small))).any():  # some may be equal
        vectors = vectors.copy()
        before = live[0]
        for j in live[1:]:
            r = np.hypot(z[before], z[j])
            c, s = z[j] / r, z[before] / r
            if abs((values[j] - values[before]) * c * s) <= small:
                a, b = values[before], values[j]
                values[before], values[j] = a * c * c + b * s * s, a * s * s + b * c * c
                u, v = vectors[:, before].copy(), vectors[:, j].copy()
                vectors[:, before], vectors[:, j] = c * u - s * v, s * u + c * v
                z[before], z[j] = 0, r
            else:
                kept.append(before)
            before = j
        kept.append(before)
        live = np.array(kept)
        live = live[np.argsort(values[live], kind="stable")]
    poles, zl = values[live], z[live]
    if len(live) == 1:
        values[live] += zl * zl
    else:
        near = secular_roots(poles, zl * zl)  # root j, pole i
        k = len(live)
        i, j = np.arange(k)[:, None], np.arange(k - 1)[None]
        other = poles[j + (j >= i)] - poles[i]
        squared = -near[k - 1] * np.prod(-near.T[:, : k - 1] / other, axis=1)
        zs = np.sqrt(np.maximum(squared, 0)) * np.sign(zl)
        turn = zs[:, None] / near.T
        turn /= np.linalg.norm(turn, axis=0)
        nearest = np.abs(near).argmin(1)
        values[live] = poles[nearest] - near[np.arange(k), nearest]
        vectors = vectors.copy() if not kept else vectors
        vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and centred scatter (its eigenvalues and eigenvectors) of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        away, n = other.mean - self.mean, self.n + other.n
        for e, v in zip(other.values, other.vectors.T):
            if e > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, v * np.sqrt(e))
        self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n * other.n / n))
        self.n, self.mean = n, self.mean + away * (other.n / n)


@dataclass
class Whitening:
    """What fit() finds: count and exact sums of the integer vectors, the basis (columns by falling eigenvalue) and its eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        if float(np.abs(x).max(initial=0)) * self.n >= 2.0**61:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums

    def project(self, x: np.ndarray, basis: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float) @ basis

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return self.project(x, self.basis[:, :k]) / np.sqrt(self.values[:k])


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the rows that count, and their dimension (0 if there are none)."""
    rows = pick(vectors, vec_id="long", embedding="array<double>")
    rows = rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = common.d if common else 0
    return rows.filter(F.size("embedding") == d), d


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = np.asarray(batch["embedding"].flatten())
    return np.clip(np.floor(SCALE * flat), -(2.0**31), 2.0**31).astype(np.int64).reshape(-1, d) + SHIFT


def _tree(parts: DataFrame, combine: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The rows (part, arrays as bytes of doubles or longs) combined, a few in each task, until one is left."""
    names = [c for c in parts.columns if c != "part"]
    schema = ", ".join(["part long", *(f"{c} binary" for c in names)])

    def few(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        out = combine([[np.frombuffer(r[c], np.int64 if c == "exact" else float) for c in names] for r in rows])
        return pa.table({"part": pa.array([rows[0]["part"] // FAN], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(names, out)}})

    parts = cut(parts)
    top = parts.agg(F.max("part").alias("n")).first().n
    if top is None:
        return None
    while True:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("few")).applyInArrow(few, schema)
        if not top:
            break
        top //= FAN
    row = parts.first()
    return [np.frombuffer(row[c], np.int64 if c == "exact" else float) for c in names]


def _summaries(rows: DataFrame, d: int) -> DataFrame:
    """Of each task: part, exact (count and sums), state (mean, eigenvalues, eigenvectors)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Spectrum.empty(d), np.zeros(d, np.int64)
        for b in batches:
            x = _integers(b, d)
            sums += x.sum(0)
            for v in (x - SHIFT).astype(float):
                own.add(v)
        if own.n:
            exact, state = np.append(np.int64(own.n), sums), np.concatenate([own.mean, own.values, own.vectors.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([exact.tobytes()], pa.binary()), pa.array([state.tobytes()], pa.binary())], ["part", "exact", "state"])

    return rows.select("embedding").mapInArrow(summarise, "part long, exact binary, state binary")


def _combined(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    out, exact = None, rows[0][0] * 0
    for own, state in rows:
        d, exact = len(own) - 1, exact + own
        one = Spectrum(int(own[0]), state[:d].copy(), state[d : 2 * d].copy(), state[2 * d :].reshape(d, d).copy())
        if out is None:
            out = one
        else:
            out.combine(one)
    return [exact, np.concatenate([out.mean, out.values, out.vectors.ravel()])]


def _covariance(rows: DataFrame, d: int, k: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The covariance (divisor n) of what ``of`` makes of all vectors, k values each; centred in every task, then combined."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = of(_integers(b, d))
                mean = y.mean(0)
                own = [np.array([float(len(y))]), mean, ((y - mean).T @ (y - mean)).ravel()]
                total = own if total is None else _merged([total, own])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in total)], ["part", "n", "mean", "scatter"])

    n, _, total = _tree(rows.select("embedding").mapInArrow(scatter, "part long, n binary, mean binary, scatter binary"), _merged)
    return total.reshape(k, k) / n[0]


def _merged(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    n, mean, scatter = rows[0]
    for m, other, own in rows[1:]:
        away, both = other - mean, n + m
        scatter = scatter + own + np.outer(away, away).ravel() * (n * m / both)
        n, mean = both, mean + away * (m / both)
    return [n, mean, scatter]


def fit(rows: DataFrame, d: int, rounds: int = ROUNDS) -> Whitening | None:
    """The whitening of the usable rows; None if there are none."""
    found = _tree(_summaries(rows, d), _combined) if d else None
    if found is None:
        return None
    exact, state = found
    basis = np.linalg.qr(state[2 * d :].reshape(d, d)[:, ::-1])[0]
    out = Whitening(int(exact[0]), exact[1:], basis, state[d : 2 * d][::-1] / exact[0], 0.0)
    for _ in range(rounds):
        small = _covariance(rows, d, d, lambda x: out.project(x, basis))
        values, turn = np.linalg.eigh((small + small.T) / 2)
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
        out = Whitening(out.n, out.sums, basis, values[::-1], float(np.trace(small)))
    real = out.values > RANK_TOLERANCE * max(out.values[0], 0)
    return Whitening(out.n, out.sums, basis[:, real], out.values[real], out.trace)


def identity_error(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """How far the covariance of all whitened vectors is from the identity, at its worst entry."""
    k = min(components, len(model.values))
    found = _covariance(rows, model.dimension, k, lambda x: model.whitened(x, components))
    return float(np.abs(found - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, error: float, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component."""
    k = min(components, len(model.values))
    share = model.values[:k] / model.trace
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = _integers(b, model.dimension)
                y, away = model.whitened(x, components), model.centred(x)
                if float((away.astype(float) ** 2).sum(1).max()) >= 2.0**62:
                    deviation = [int(v) if v < 1 << 63 else None for v in (away.astype(object) ** 2).sum(1)]
                else:
                    deviation = (away * away).sum(1).astype(np.int64)
                each = pa.array(np.repeat(np.arange(b.num_rows), k))
                columns = [b["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(each), model.n)), pa.array(deviation, pa.int64()).take(each), pa.array(y.ravel()), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(project, schema)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fits and whitens all usable vectors."""
    rows, d = usable(vectors)
    model = fit(rows, d)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, model, identity_error(rows, model, components), components)
