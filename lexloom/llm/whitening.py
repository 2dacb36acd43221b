"""Embedding whitening: exact sums, a distributed centred scatter, cyclic Jacobi on the driver, a broadcast whitening matrix.

Vectors become whole numbers first, so that counts, sums and deviations are exact and don't depend on how rows are
dealt. Three passes fit (sums; scatter of centred rows; covariance of what whitening gives, as a check), one applies.
Partial matrices are summed row by row on the cluster; the driver gets one matrix of d x d numbers, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

#: Components that are returned.
COMPONENTS = 8
#: An entry c counts as floor(GRID * c) + OFFSET; entries of LARGEST and more in size have no exact sums.
GRID, OFFSET, LARGEST = 1024, 100_000, float(1 << 40)
#: An off-diagonal entry has vanished when it is so small beside its two diagonal ones; sweeps at most.
VANISHED, SWEEPS = 1e-16, 60
#: Tasks that join the tasks' covariances, at most.
SUM_PARTS = 32


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep turns every pair once, in rounds of disjoint pairs (everyone meets everyone), until each off-diagonal
    entry is negligible beside its own diagonal entries; so small eigenvalues are as accurate as large ones.
    """
    n = len(a)
    a, u = a.astype(float).copy(), np.eye(n)
    seats = np.arange(n + n % 2)
    for _ in range(SWEEPS if n > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            there = (p < n) & (q < n)
            p, q = np.minimum(p, q)[there], np.maximum(p, q)[there]
            off = a[p, q]
            use = np.abs(off) > VANISHED * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if use.any():
                turned = True
                _rotate(a, u, p[use], q[use], off[use])
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order]


def _rotate(a: np.ndarray, u: np.ndarray, p: np.ndarray, q: np.ndarray, off: np.ndarray) -> None:
    tau = (a[q, q] - a[p, p]) / (2 * off)
    t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
    c = 1 / np.sqrt(1 + t * t)
    s = t * c
    dp, dq = a[p, p] - t * off, a[q, q] + t * off
    a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
    for m in (a, u):
        m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
    a[p, p], a[q, q] = dp, dq
    a[p, q] = a[q, p] = 0.0


@dataclass
class Whitener:
    """What whitening needs, for vectors of one length."""

    n: int
    total: np.ndarray
    directions: np.ndarray  # d x k, each divided by the root of its eigenvalue; NaN where that is 0
    explained: np.ndarray
    identity_error: float = float("nan")

    @classmethod
    def of(cls, n: int, total: np.ndarray, scatter: np.ndarray, most: int) -> Whitener:
        e, u = jacobi(scatter / n)
        k = min(most, len(e))
        trace = float(np.trace(scatter)) / n
        flat = e[:k] <= len(e) * np.finfo(float).eps * max(float(e[0]), 0.0)
        scale = np.sqrt(np.where(flat, np.nan, e[:k]))
        return cls(n, total, u[:, :k] / scale, np.where(flat, 0.0, e[:k]) / trace if trace > 0 else np.full(k, np.nan))

    def far(self, x: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exact."""
        return self.n * x - self.total

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.far(x) / self.n) @ self.directions

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Squared lengths of `far`, exact; None where 64 bits can't hold one."""
        far = self.far(x)
        rough = (far.astype(float) ** 2).sum(1)
        exact = (far * far).sum(1).tolist()
        for i in np.flatnonzero(rough > 9e18).tolist():
            own = sum(int(v) ** 2 for v in far[i])
            exact[i] = own if own < 1 << 63 else None
        return exact


def _vectors(batch: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as whole numbers), by length of the vectors."""
    d = batch["d"].to_numpy()
    flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(d) - d
    for size in np.unique(d).tolist():
        at = np.flatnonzero(d == size)
        yield at, np.floor(GRID * flat[start[at][:, None] + np.arange(size)]).astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By length: how many vectors, and their sums, exact."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, list] = {}
        for b in batches:
            for at, x in _vectors(b):
                own = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                own[0] += len(at)
                own[1] += x.sum(0)
        yield {"d": list(total), "n": [n for n, _ in total.values()], "s": [s.tolist() for _, s in total.values()]}

    parts = map_batches(rows, run, "d int, n long, s array<long>", rows=4096).select("d", "n", F.posexplode("s").alias("i", "s"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out.setdefault(r.d, (r.n, np.zeros(r.d, np.int64)))[1][r.i] = r.s
    return out


def _scatter(rows: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """By length: the sum of the outer products of vectors from which the mean was taken first."""
    sent = rows.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _vectors(b):
                n, s = sent.value[x.shape[1]]
                far = (n * x - s) / n
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + far.T @ far
        for d, m in total.items():
            yield {"d": [d] * d, "i": list(range(d)), "part": [r.tobytes() for r in m]}

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for d, i, part in zip(*(b[c].to_pylist() for c in ("d", "i", "part")), strict=True):
                total[d, i] = total.get((d, i), 0.0) + np.frombuffer(part)
        yield {"d": [d for d, _ in total], "i": [i for _, i in total], "part": [x.tobytes() for x in total.values()]}

    schema = "d int, i int, part binary"
    out = {d: np.zeros((d, d)) for d in sums}
    for r in map_batches(map_batches(rows, run, schema, rows=4096).repartition("d", "i"), add, schema).collect():
        out[r.d][r.i] = np.frombuffer(r.part)
    return {d: (m + m.T) / 2 for d, m in out.items()}


def _join(a: tuple, b: tuple) -> tuple:
    """Two (count, mean, centred scatter) of different rows as one."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_error(rows: DataFrame, fitted: dict[int, Whitener]) -> dict[int, float]:
    """By length: how far the covariance of the whitened vectors is from the identity, measured over all of them."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def pack(found: dict[int, tuple]) -> dict:
        return {"d": list(found), "n": [x[0] for x in found.values()], "mean": [x[1].tobytes() for x in found.values()], "m": [x[2].tobytes() for x in found.values()]}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        found: dict[int, tuple] = {}
        for b in batches:
            for at, x in _vectors(b):
                w = sent.value[x.shape[1]](x)
                mean = w.mean(0)
                own = len(at), mean, (w - mean).T @ (w - mean)
                found[x.shape[1]] = _join(found[x.shape[1]], own) if x.shape[1] in found else own
        yield pack(found)

    def merge(found: dict[int, tuple], rows_: Iterator[tuple]) -> None:
        for d, n, mean, m in rows_:
            mean = np.frombuffer(mean)
            own = n, mean, np.frombuffer(m).reshape(len(mean), -1)
            found[d] = _join(found[d], own) if d in found else own

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        found: dict[int, tuple] = {}
        for b in batches:
            merge(found, zip(*(b[c].to_pylist() for c in ("d", "n", "mean", "m")), strict=True))
        yield pack(found)

    schema = "d int, n long, mean binary, m binary"
    dealt = map_batches(rows, run, schema, rows=4096).repartition(F.pmod(F.spark_partition_id(), F.lit(SUM_PARTS)))
    total: dict[int, tuple] = {}
    merge(total, ((r.d, r.n, r.mean, r.m) for r in map_batches(dealt, add, schema).collect()))
    out = {}
    for d, (n, _, m) in total.items():
        good = ~np.isnan(fitted[d].directions).any(0)
        off = np.abs(m / n - np.eye(len(m)))[np.ix_(good, good)]
        out[d] = float(off.max()) if off.size else float("nan")
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, d): vectors of at least one entry, all of them finite numbers below LARGEST in size; zero vectors and null ids stay."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    good = (F.size(F.array_compact("v")) == F.size("v")) & (F.array_max("v") < LARGEST) & (F.array_min("v") > -LARGEST)  # NaN counts as the largest
    return rows.where(F.coalesce(good, F.lit(False))).withColumn("d", F.size("v"))


def fit_whitening(rows: DataFrame, *, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each length of vectors, from rows that `usable` gave."""
    sums = _sums(rows)
    scatter = _scatter(rows, sums)
    fitted = {d: Whitener.of(n, s, scatter[d], components) for d, (n, s) in sums.items()}
    for d, error in _identity_error(rows, fitted).items():
        fitted[d].identity_error = error
    return fitted


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null or hold null or non-finite entries go, as do those with an entry of 2**40 and more in size,
    which have no exact sums. Zero vectors, ties, repeated rows and rows of a null id each count. Vectors of
    different lengths are fitted each with their own. A component without variance has whitened null and explained 0
    (null without any variance at all, as for a single row); identity_error is that of the other components, null without
    any. deviation is null where 64 bits can't hold it. Empty table, and vectors without entries: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    sent = spark.sparkContext.broadcast(fit_whitening(rows, components=components))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at, x in _vectors(b):
                own = sent.value[x.shape[1]]
                k = own.directions.shape[1]
                w = own(x)
                yield {
                    "id": b["id"].take(np.repeat(at, k)), "component": np.tile(np.arange(1, k + 1), len(at)), "n": np.full(len(at) * k, own.n), "deviation": [v for v in own.deviation(x) for _ in range(k)],
                    "whitened": [None if v != v else v for v in w.ravel().tolist()], "explained": [None if v != v else v for v in np.tile(own.explained, len(at)).tolist()],
                    "identity_error": [None if own.identity_error != own.identity_error else own.identity_error] * (len(at) * k),
                }

    return map_batches(rows, run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double", rows=1024)
