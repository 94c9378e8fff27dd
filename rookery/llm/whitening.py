"""Whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers. Each task keeps the eigendecomposition of the scatter of the vectors that
it has met: a further vector adds a centred rank-one update, whose eigenvalues are the roots of a
secular equation between the old ones. Entries of the update that are too small to matter, and all but
one of those of equal eigenvalues, are deflated. Eigenvectors come from the update recomputed from the
roots, so that they stay orthogonal. Spectra of tasks are combined in the same way, one eigenpair after
another and one update for the difference of their means, in a tree. The result is a basis that is
close; one distributed pass gives the exact covariance in it (Rayleigh-Ritz), whose small eigenproblem
turns the basis into the components; a second pass measures the covariance of the whitened vectors.

Scale: three maps over the vectors, each of constant memory, and trees of one row a task, FAN rows
meeting at a time. A row is a spectrum: d * d numbers for vectors of d entries, at most MAX_DIM. Only
the last one, of that same bounded size, is with the driver and is what tasks receive. Sums are of whole numbers and
exact. A repeated vector costs what another one does.

Defined results: rows whose vector is null, empty, or holds null, non-finite or enormous entries (2^46
or more, which have no exact whole number here) are dropped; null and repeated ids are kept and stand
for themselves; vectors of different lengths are an error; a component whose eigenvalue is nothing but
rounding (constant or too few vectors) has null for `whitened`, is left out of `identity_error`, and
`explained` is 0; a deviation beyond a long is null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

COMPONENTS = 32
#: Entries of a vector at most: a spectrum then has at most 8 MB.
MAX_DIM = 1024
#: Spectra that one task combines.
FAN = 16
SHIFT = 1_000_000
EPS = np.finfo(float).eps
ROUNDS = 80


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z_j^2 / (d_j - x)), each as the number of the nearest pole and the distance from it.

    `d` rises strictly and no z is zero, so that one root follows each pole.
    """
    k, zz = len(d), z * z
    total = zz.sum()
    last = np.arange(k) == k - 1
    above = np.append(d[1:], d[-1] + total)
    gap = above - d
    # the sign at the middle of an interval tells which of its ends is nearer
    middle = 1 + zz @ (1 / ((d[:, None] - d) - gap / 2))
    right = (middle < 0) & ~last
    pole = np.where(right, np.arange(k) + 1, np.arange(k))
    away = d[:, None] - d[pole]
    lo = np.where(right, -gap / 2, np.where(last & (middle < 0), gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where(last & (middle < 0), gap, gap / 2))
    x = (lo + hi) / 2
    below = np.tri(k).T  # poles up to the root's own, by column
    near, far = d - d[pole], np.where(last, np.inf, above - d[pole])
    todo = np.ones(k, bool)
    for _ in range(ROUNDS):
        part = 1 / (away - x)
        f = 1 + zz @ part
        lo, hi = np.where(f < 0, np.maximum(lo, x), lo), np.where(f > 0, np.minimum(hi, x), hi)
        size = 1 + zz @ np.abs(part)
        todo &= (np.abs(f) > 4 * EPS * size) & (hi - lo > 2 * EPS * np.abs(x))
        if not todo.any():
            break
        part *= part
        whole = zz @ part
        left = zz @ (part * below)
        a0, b0 = near - x, far - x
        with np.errstate(all="ignore"):
            # the last root: one pole that matches value and slope below; others: one pole on each side
            own = -a0 * a0 * left / (f - a0 * left)
            b = np.where(last, 0.0, b0)
            c = f - a0 * left - b * (whole - left)
            p = (a0 + b) * f - a0 * b * whole
            q = a0 * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            new = np.where(last, near - own, x + step)
        bad = ~((new > lo) & (new < hi))
        x = np.where(todo, np.where(bad, (lo + hi) / 2, new), x)
    return pole, x


class Spectrum:
    """Number, exact sums, mean, and the eigendecomposition of the scatter of vectors."""

    def __init__(self, size: int) -> None:
        self.n = 0
        self.sums = np.zeros(size, np.int64)
        self.mean = np.zeros(size)
        self.values = np.zeros(size)
        self.vectors = np.eye(size)

    def update(self, v: np.ndarray) -> None:
        """Add the rank-one matrix v v'."""
        d, q, z = self.values, self.vectors, v @ self.vectors
        norm = z @ z
        if norm == 0:
            return
        # eigenvalues that are equal but for rounding: one mirror turns the update onto the last of them
        bound = 8 * EPS * max(d[-1], norm)
        steps = np.flatnonzero(np.diff(d) > bound) + 1
        if len(steps) < len(d) - 1:
            edges = [0, *steps, len(d)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1 and (length := np.sqrt(z[a:b] @ z[a:b])) > 0:
                    u = z[a:b].copy()
                    u[-1] += np.copysign(length, u[-1])
                    q[:, a:b] -= np.outer(q[:, a:b] @ u, u * (2 / (u @ u)))
                    z[a:b] = 0
                    z[b - 1] = -np.copysign(length, u[-1])
        on = np.flatnonzero(np.abs(z) * np.sqrt(norm) > bound)
        if not len(on):
            return
        dk, zk = d[on], z[on]
        pole, x = secular_roots(dk, zk)
        # differences root - pole, without cancellation; the update whose roots these exactly are
        over = x - (dk[:, None] - dk[pole])
        ratio = over / np.where(np.eye(len(on), dtype=bool), 1.0, dk[None, :] - dk[:, None])
        own = np.sqrt(np.abs(np.prod(ratio, 1))) * np.sign(zk)
        turn = own[:, None] / over
        turn /= np.sqrt((turn * turn).sum(0))
        q[:, on] = q[:, on] @ turn
        d[on] = dk[pole] + x
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def add(self, x: np.ndarray) -> None:
        """One further vector of whole numbers."""
        self.n += 1
        self.sums += x
        off = x - self.mean
        self.mean += off / self.n
        if self.n > 1:
            self.update(off * np.sqrt((self.n - 1) / self.n))

    def join(self, other: Spectrum) -> None:
        """Further vectors, of which the spectrum is known."""
        n = self.n + other.n
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(np.sqrt(value) * vector)
        off = other.mean - self.mean
        if self.n and other.n:
            self.update(off * np.sqrt(self.n / n * other.n))
        self.mean = self.mean + off * (other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def row(self) -> dict:
        return {"n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(), "vals": self.values.tolist(), "vecs": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        out = cls(len(row["sums"]))
        out.n, out.sums = row["n"], np.array(row["sums"], np.int64)
        out.mean, out.values = np.array(row["mean"]), np.array(row["vals"])
        out.vectors = np.array(row["vecs"]).reshape(len(out.sums), -1)
        return out


SPECTRUM = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("vals", pa.list_(pa.float64())), ("vecs", pa.list_(pa.float64()))])


def whole_vectors(df: DataFrame) -> DataFrame:
    """id, x: the usable vectors as whole numbers."""
    c = F.col("vector")
    fine = (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= float(1 << 46)))
    return df.where(c.isNotNull() & fine).select("id", F.transform(c, lambda v: F.floor(v * F.lit(64.0)).cast("long") + SHIFT).alias("x"))


def matrix_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    lists = batch.column("x")
    if any(n != size for n in lists.value_lengths().to_pylist()):
        raise ValueError(f"vectors of different lengths: {size} and others")
    return lists.flatten().to_numpy().reshape(-1, size)


def in_tree(rows: DataFrame, name: str, combine: Callable[[list[dict]], dict], schema: pa.Schema, ddl: str) -> dict | None:
    """Rows of one a task combined FAN at a time, each round written; the last one, or None if there is none."""

    def meet(group: pa.Table) -> pa.Table:
        some = sorted(group.drop_columns(["group"]).to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([combine(some) | {"part": some[0]["part"] // FAN}], schema)

    rows = materialise(rows, name)
    parts = rows.agg(F.max("part").alias("last")).first()["last"]
    if parts is None:
        return None
    while parts:
        grouped = rows.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("group")
        rows, parts = materialise(grouped.applyInArrow(meet, ddl), name), parts // FAN
    return rows.first().asDict()


def spectrum_of(vectors: DataFrame, size: int) -> Spectrum | None:
    """The spectrum of all vectors: rank-one updates in tasks, then their spectra in a tree."""
    ddl = "part long, n long, sums array<long>, mean array<double>, vals array<double>, vecs array<double>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(size)
        for b in batches:
            for x in matrix_of(b, size):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row() | {"part": TaskContext.get().partitionId()}], SPECTRUM)

    def combine(rows: list[dict]) -> dict:
        first, *others = map(Spectrum.of, rows)
        for other in others:
            first.join(other)
        return first.row()

    row = in_tree(vectors.select("x").mapInArrow(gather, ddl), "whitening-spectra", combine, SPECTRUM, ddl)
    return Spectrum.of(row) if row else None


def covariance_in(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the vectors' exact deviations projected on the columns of `basis`, centred again against rounding."""
    size, k = basis.shape
    schema = pa.schema([("part", pa.int64()), ("total", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
    ddl = "part long, total array<double>, products array<double>"
    given = vectors.sparkSession.sparkContext.broadcast((sums, basis))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, basis = given.value
        total, products, some = np.zeros(k), np.zeros((k, k)), False
        for b in batches:
            y = ((n * matrix_of(b, size) - sums) / n) @ basis
            total += y.sum(0)
            products += y.T @ y
            some = some or b.num_rows > 0
        if some:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "total": total.tolist(), "products": products.ravel().tolist()}], schema)

    def combine(rows: list[dict]) -> dict:
        return {c: np.sum([r[c] for r in rows], 0).tolist() for c in ("total", "products")}

    row = in_tree(vectors.select("x").mapInArrow(gather, ddl), "whitening-covariance", combine, schema, ddl)
    mean = np.array(row["total"]) / n
    return np.array(row["products"]).reshape(k, k) / n - np.outer(mean, mean)


def deviations(off: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers by row; None beyond a long."""
    if off.size and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2.0**62:
        sums = [sum(int(v) ** 2 for v in row) for row in off]
        return [s if s < 1 << 63 else None for s in sums]
    return (off * off).sum(1).tolist()


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector of `df` (id, vector) and component, as OUT has it; at most `components` of them."""
    spark = df.sparkSession
    vectors = whole_vectors(df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    head = vectors.select(F.size("x").alias("size")).first()
    if head is None:
        return spark.createDataFrame([], OUT)
    size = head["size"]
    if size > MAX_DIM:
        raise ValueError(f"vectors of {size} entries; {MAX_DIM} at most")
    start = spectrum_of(vectors, size)
    n, sums = start.n, start.sums
    # Rayleigh-Ritz: the basis is orthonormal but for rounding, which one more factorisation takes away
    basis = np.linalg.qr(start.vectors)[0]
    values, turn = np.linalg.eigh(covariance_in(vectors, n, sums, basis))
    k = min(components, size)
    values, basis = values[::-1], (basis @ turn[:, ::-1])[:, :k]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    trace = float(values.sum())
    real = values[:k] > 1e-12 * max(trace, 0.0)
    scale = np.where(real, np.sqrt(np.where(real, values[:k], 1.0)), 1.0)
    explained = np.where(real, values[:k] / (trace or 1.0), 0.0)
    whitened = covariance_in(vectors, n, sums, basis / scale)[np.ix_(real, real)]
    error = float(np.abs(whitened - np.eye(len(whitened))).max()) if real.any() else 0.0
    given = spark.sparkContext.broadcast((sums, basis / scale))
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, turn = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                off = n * matrix_of(b, size) - sums
                y, rows = (off / n) @ turn, b.num_rows
                gone = np.tile(~real, rows)
                columns = [
                    b.column("id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations(off), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(y.ravel(), mask=gone),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(project, OUT)
