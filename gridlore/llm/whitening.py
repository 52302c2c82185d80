"""Embedding whitening: exact covariance, its eigenvectors by QDWH spectral divide-and-conquer, broadcast projection.

Entries become whole numbers, so counts, sums and the sums of centred products
are exact whatever the partitioning. The covariance of d dimensions (d squared
numbers, however many rows) is divided on the driver: the polar factor of a
shifted symmetric matrix is its sign, whose projector splits the space into two
invariant subspaces, and so on down to single components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm._common import free_name, map_texts, slices

EPS = float(np.finfo(float).eps)
#: Entries from which whole numbers no longer fit count as not finite.
LIMIT = 2.0**61
#: Added to every whole number.
SHIFT = 1_000_000
#: Dimensions up to which a covariance goes to the driver.
DIMENSIONS = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by QDWH: dynamically weighted Halley steps, by QR while weights are large, then by Cholesky."""
    n = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low if np.isfinite(low) else 0.0, EPS / 4))
    for _ in range(30):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        alpha = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(gamma) * x, np.eye(n)]))
            new = beta / gamma * x + (alpha - beta / gamma) / math.sqrt(gamma) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(np.eye(n) + gamma * (x.T @ x))
            new = beta / gamma * x + (alpha - beta / gamma) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (alpha + beta * low**2) / (1 + gamma * low**2))
        if moved <= EPS ** (1 / 3) and abs(1 - low) < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above a shift, the rest those below; None if no shift parts them."""
    n, diagonal = len(a), np.sort(np.diag(a))
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(n), 2)
    shifts = [np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread * f for f in (0.03, -0.03, 0.11, -0.11, 0.29, -0.29, 0.47, -0.47))]
    rng = np.random.default_rng(n)
    best = None
    for shift in shifts:
        sign = polar(a - shift * np.eye(n))
        projector = (sign + sign.T) / 4 + np.eye(n) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis, _ = np.linalg.qr(projector @ rng.normal(size=(n, k)))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        rest, _ = np.linalg.qr(np.hstack([basis, rng.normal(size=(n, n - k))]))
        basis = np.hstack([basis, rest[:, k:]])
        error = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or error < best[0]:
            best = error, basis, k
        if error <= 8 * EPS * scale:
            break
    return (best[1], best[2]) if best is not None and best[0] <= 1e4 * EPS * n * scale else None


def _pair(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two dimensions: the rotation that makes them diagonal."""
    angle = 0.5 * math.atan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    return np.diag(turn.T @ a @ turn), turn


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix, by falling value; the largest entry of a vector is positive.

    A block that is diagonal up to rounding is done; blocks of two are turned.
    The bases of the splits are multiplied up, and each value is the Rayleigh
    quotient of its vector.
    """
    n = len(a)
    scale = float(np.linalg.norm(a)) or 1.0

    def divide(block: np.ndarray) -> np.ndarray:
        m = len(block)
        if m == 1 or np.linalg.norm(block - np.diag(np.diag(block))) <= EPS * scale / 4:
            return np.eye(m)
        if m == 2:
            return _pair(block)[1]
        found = _split(block, scale)
        if found is None:  # values closer than rounding can part
            return np.eye(m)
        basis, k = found
        upper, lower = basis[:, :k], basis[:, k:]
        halves = [half @ divide((s + s.T) / 2) for half in (upper, lower) for s in [half.T @ block @ half]]
        return np.hstack(halves)

    vectors = divide((a + a.T) / 2)
    for _ in range(2):  # what rounding left off the diagonal, by one first-order step each
        rest = vectors.T @ a @ vectors
        gaps = np.diag(rest)[None, :] - np.diag(rest)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where((np.abs(gaps) > 1e4 * np.abs(rest)) & (np.abs(gaps) > 1e5 * EPS * scale), rest / gaps, 0.0)
        np.fill_diagonal(step, 0.0)
        vectors, _ = np.linalg.qr(vectors + vectors @ step)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values[order], vectors * np.where(signs == 0, 1.0, signs)


@dataclass
class Whitener:
    """What is learned of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float | None = None

    def __post_init__(self) -> None:
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s - int(b) * self.n for s, b in zip(self.sums, self.base)]

    def live(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > len(self.base) * EPS * max(self.trace, 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers as unit-variance components; not a number where a component has no variance."""
        centred = (x - self.base) - np.array(self.rest, float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live(), centred @ self.axes / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S) squared, exact."""
        z = x - self.base
        most = int(np.abs(z).max(initial=0)) * self.n + self.n
        if most * most * len(self.base) < 1 << 62:
            return ((z * self.n - np.array(self.rest)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in z.tolist()]


def _sent(spark: SparkSession, fitted: dict[int, Whitener]):
    """Whiteners as a broadcast of plain values, and how a task gets them back."""
    plain = spark.sparkContext.broadcast({size: (w.n, w.sums, w.values, w.axes, w.trace, w.error) for size, w in fitted.items()})
    return lambda: {size: Whitener(*fields) for size, fields in plain.value.items()}


def whole(batch: pa.RecordBatch, name: str = "vector") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and whole numbers floor(64 c) + 1000000 of a batch's vectors, by their length; vectors with null or non-finite entries are left out."""
    column = batch.column(name)
    used = np.flatnonzero(column.is_valid())
    column = column.take(pa.array(used, pa.int64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    entries = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = entries[(ends[rows] - size)[:, None] + np.arange(size)]
        good = (np.isfinite(x) & (np.abs(np.where(np.isfinite(x), x, 0)) < LIMIT / 64)).all(axis=1)
        if good.any():
            out[int(size)] = used[rows[good]], np.floor(64 * x[good]).astype(np.int64) + SHIFT
    return out


def exact_products(z: np.ndarray) -> list[list[int]]:
    """z'z in whole numbers: in double precision where all sums fit in 53 bits, else in Python's integers."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        return (z.astype(float).T @ z.astype(float)).astype(np.int64).tolist()
    if len(z) > 1 and most * most < 1 << 50:
        half = len(z) // 2
        return [[a + b for a, b in zip(p, q)] for p, q in zip(exact_products(z[:half]), exact_products(z[half:]))]
    rows = z.astype(object)
    return (rows.T @ rows).tolist()


def _totals(vectors: DataFrame, sums) -> list:
    """(size, i, j, total) with totals as whole numbers: `sums(size, x)` gives a batch's entries, which are added up in the task, then by Spark.

    A total travels in two parts, its rest modulo 2**40 and what is above, as decimals.
    """

    def run(batches):
        held: dict = {}
        for batch in slices(batches):
            for size, (_, x) in whole(batch).items():
                for key, value in sums(size, x):
                    held[key] = held.get(key, 0) + value
        keys = list(held)
        column = lambda values, kind: pa.array(values, kind)
        yield pa.RecordBatch.from_arrays(
            [column([k[i] for k in keys], pa.int32()) for i in range(3)] + [column([held[k] & ((1 << 40) - 1) for k in keys], pa.int64()), column([str(held[k] >> 40) for k in keys], pa.string())],
            names=["size", "i", "j", "low", "high"],
        )

    parts = map_texts(vectors, run, "size int, i int, j int, low long, high string")
    total = parts.groupBy("size", "i", "j").agg(F.sum("low").alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"))
    return [(r["size"], r["i"], r["j"], r["low"] + (int(r["high"]) << 40)) for r in total.collect()]


def fit(df: DataFrame, vector: str, components: int = 32) -> dict[int, Whitener]:
    """A whitener for each length of vector: count and sums, then centred products, then the measured error, each one pass with sums of a task's rows.

    The driver gets d sums and d squared products of a length, never rows.
    Centres are the sums' whole quotients, and what remains of the mean is
    taken off exactly, so the covariance is rounded once. Lengths beyond 4096
    raise a ValueError. Vectors that are null, empty, or hold null, non-finite or
    too large entries (2**55 and more) are left out; without vectors nothing is learned.
    """
    vectors = df.select(F.col(vector).cast("array<double>").alias("vector"))
    spark = df.sparkSession

    def count(size, x):
        if size > DIMENSIONS:
            return [((size, -1, -1), len(x))]
        totals = [sum(c) for c in x.T.tolist()] if np.abs(x).max(initial=0) > (1 << 62) // max(1, len(x)) else x.sum(axis=0).tolist()
        return [((size, -1, -1), len(x)), *[((size, i, -1), v) for i, v in enumerate(totals)]]

    sums: dict[int, dict[int, int]] = {}
    for size, i, _, total in _totals(vectors, count):
        sums.setdefault(size, {})[i] = total
    if any(size > DIMENSIONS for size in sums):
        raise ValueError(f"vectors of more than {DIMENSIONS} dimensions")
    blank = {size: Whitener(s[-1], [s[i] for i in range(size)], np.zeros(0), np.zeros((size, 0)), 0.0) for size, s in sums.items()}
    if not blank:
        return {}
    bases = spark.sparkContext.broadcast({size: w.base for size, w in blank.items()})

    def products(size, x):
        found = exact_products(x - bases.value[size])
        return [((size, i, j), found[i][j]) for i in range(size) for j in range(i, size)]

    found: dict[int, np.ndarray] = {size: np.zeros((size, size)) for size in blank}
    for size, i, j, total in _totals(vectors, products):
        w = blank[size]
        found[size][i, j] = found[size][j, i] = float(Fraction(w.n * total - w.rest[i] * w.rest[j], w.n * w.n))
    fitted = {}
    for size, covariance in found.items():
        values, axes = eigen(covariance)
        fitted[size] = Whitener(blank[size].n, blank[size].sums, values[:components], axes[:, :components], float(np.trace(covariance)))
    for size, error in identity_errors(vectors, fitted).items():
        fitted[size].error = error
    return fitted


def identity_errors(vectors: DataFrame, fitted: dict[int, Whitener]) -> dict[int, float]:
    """By length, the largest entry by which the covariance of the whitened vectors differs from the identity.

    Two passes, means and centred products, over components that have a variance.
    """
    spark = vectors.sparkSession

    def total(value) -> dict:
        """Sums of `value(size, whitened rows)`, arrays of one shape for a length; a task sends one row for each length."""

        def run(batches):
            held: dict = {}
            whiteners = models()
            for batch in slices(batches):
                for size, (_, x) in whole(batch).items():
                    w = whiteners[size]
                    got = value(size, w.whitened(x)[:, w.live()])
                    held[size] = held[size] + got if size in held else got
            entries = [(s, i, float(v)) for s, a in held.items() for i, v in enumerate(a.ravel())]
            columns = list(zip(*entries)) if entries else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], names=["size", "i", "v"])

        summed = map_texts(vectors, run, "size int, i int, v double").groupBy("size", "i").agg(F.sum("v").alias("v"))
        out: dict[int, dict[int, float]] = {}
        for r in summed.collect():
            out.setdefault(r["size"], {})[r["i"]] = r["v"]
        return out

    models = _sent(spark, fitted)
    first = total(lambda size, y: y.sum(axis=0))
    means = spark.sparkContext.broadcast({s: np.array([m[i] for i in range(len(m))]) / fitted[s].n for s, m in first.items()})
    second = total(lambda size, y: (y - means.value.get(size, 0.0)).T @ (y - means.value.get(size, 0.0)))
    return {s: max(abs(v / fitted[s].n - (i % k == i // k)) for i, v in m.items()) for s, m in second.items() if m for k in [math.isqrt(len(m))]}


def whiten(df: DataFrame, vector: str, fitted: dict[int, Whitener]) -> DataFrame:
    """The usable rows with `whitened` (array of double, null where a component has no variance) and `deviation` (decimal, null beyond 38 digits); names that the table has get an underscore.

    The whiteners are broadcast: a length's axes are at most 4096 by the number of components.
    """
    models, columns = _sent(df.sparkSession, fitted), df.columns
    names = [free_name(df, "whitened"), free_name(df, "deviation")]
    at = free_name(df, "vector_")
    held = df.withColumn(at, F.col(vector).cast("array<double>"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], f"{names[0]} array<double>, {names[1]} string"])

    def run(batches):
        whiteners = models()
        for batch in slices(batches):
            for size, (rows, x) in whole(batch, at).items():
                w = whiteners[size]
                y = w.whitened(x)
                flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], lists, pa.array([str(v) for v in w.deviations(x)], pa.string())], names=[*columns, *names])

    return map_texts(held, run, schema).withColumn(names[1], F.col(names[1]).try_cast("decimal(38,0)"))


def components(df: DataFrame, key: str, vector: str, count: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row, components numbered from 1 by falling variance.

    Vectors of each length are a space of their own with a fit of their own.
    Rows that repeat are kept. `deviation` is null where it goes beyond a long;
    `whitened` is null for a component without variance, `explained` where
    there is no variance at all, `identity_error` where no component has any.
    Columns other than these two are not read. An empty table gives none.
    """
    fitted = fit(df, vector, count)
    two = df.select(F.col(key).alias("key_"), F.col(vector).cast("array<double>").alias("vector_"))
    out = whiten(two, "vector_", fitted).withColumn("size_", F.size("vector_"))
    rows = [(s, c, w.n, float(w.values[c] / w.trace) if w.trace > 0 else None, w.error) for s, w in fitted.items() for c in range(len(w.values))]
    about = df.sparkSession.createDataFrame(rows, "size_ int, c_ int, n long, explained double, identity_error double")
    shown = out.select("key_", "size_", "deviation", F.posexplode("whitened").alias("c_", "whitened"))
    told = shown.join(F.broadcast(about), ["size_", "c_"])
    return told.select(F.col("key_").alias(key), (F.col("c_") + 1).cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
