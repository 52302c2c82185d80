"""Distributions held as arrays, and their scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

import gridlore

# Functions of this package travel to the executors by value.
cloudpickle.register_pickle_by_value(gridlore)

#: The coefficients of Abramowitz and Stegun 7.1.26.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """Divided by the sum, which is taken once."""
    return F.transform(F.array(total(a)), lambda t: F.transform(a, lambda x: x / t))[0]


def erf(x: Column) -> Column:
    """Rational approximation with an error below 1.5e-7."""
    p, a1, a2, a3, a4, a5 = ERF
    t = 1 / (1 + p * F.abs(x))
    y = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.signum(x) * y


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


#: Rows of a task's batch whose grids are computed at once.
GRID_ROWS = 1024


def _normal_grid(m: np.ndarray, s: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows of a rounded normal's masses from low to high, tails folded into the ends."""
    x = (np.arange(low, high) + 0.5 - m[:, None]) / s[:, None] / math.sqrt(2)
    p, *a = ERF
    t = 1 / (1 + p * np.abs(x))
    cdf = 0.5 * (1 + np.sign(x) * (1 - sum(c * t ** (i + 1) for i, c in enumerate(a)) * np.exp(-x * x)))
    return np.diff(np.hstack([np.zeros((len(m), 1)), cdf, np.ones((len(m), 1))]), axis=1)


def _grid_slices(m: np.ndarray, s: np.ndarray, low: int, high: int):
    """(rows, masses) of a batch, a slice of `GRID_ROWS` at a time."""
    for at in range(0, len(m), GRID_ROWS):
        rows = slice(at, at + GRID_ROWS)
        yield rows, _normal_grid(m[rows], s[rows], low, high)


def normal_pmf(mu: Column, sigma: Column, low: int, high: int) -> Column:
    """The normal rounded to whole numbers from low to high, tails folded into the ends; null without mu or sigma.

    A batch's grids are array operations on slices of it, and leave the task
    as one array of masses, without an object for each row; as a column
    expression, the hundreds of steps of a wide grid would be interpreted one
    by one.
    """

    @F.arrow_udf("array<double>")
    def mass(mu: pa.Array, sigma: pa.Array) -> pa.Array:
        m, s = (x.to_numpy(zero_copy_only=False).astype(float) for x in (mu, sigma))
        known, wide = ~(np.isnan(m) | np.isnan(s)), high - low + 1
        flat = np.empty(int(known.sum()) * wide)
        for rows, grid in _grid_slices(m[known], s[known], low, high):
            flat[rows.start * wide : rows.stop * wide] = grid.ravel()
        ends = np.concatenate([[0], np.cumsum(known) * wide]).astype(np.int32)
        starts = pa.array(ends, pa.int32(), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(starts, pa.array(flat))

    return mass(mu.cast("double"), sigma.cast("double"))


def on_normal_grid(mu: Column, sigma: Column, low: int, high: int, value: Callable[..., np.ndarray], *others: Column) -> Column:
    """A number of each rounded normal: `value(masses, k, *others)` over slices of a batch, whose grids don't leave the task; null if an input is."""

    @F.pandas_udf("double")
    def run(inputs: pd.DataFrame) -> pd.Series:
        m, s, *rest = (inputs[c].to_numpy(float, na_value=np.nan) for c in inputs.columns)
        seen = ~np.isnan(np.vstack([m, s, *rest])).any(axis=0)
        known = np.flatnonzero(seen)
        out = np.full(len(m), np.nan)
        for rows, grid in _grid_slices(m[known], s[known], low, high):
            at = known[rows]
            out[at] = value(grid, np.arange(low, high + 1), *[r[at] for r in rest])
        return pd.Series(out).where(seen, None)

    return run(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate((mu, sigma, *others))]))


def crps_of(masses: np.ndarray, k: np.ndarray, actual: np.ndarray) -> np.ndarray:
    return ((masses.cumsum(axis=1) - (k >= actual[:, None])) ** 2).sum(axis=1)


def above_of(masses: np.ndarray, k: np.ndarray) -> np.ndarray:
    return masses @ np.where(k > 0, 1.0, np.where(k == 0, 0.5, 0.0))


def median_of(masses: np.ndarray, k: np.ndarray) -> np.ndarray:
    return k[(masses.cumsum(axis=1) >= 0.5 - 1e-9).argmax(axis=1)].astype(float)


def reweighted(pmf: Column, low: int, factors: Column) -> Column:
    """A pmf times a factor of |k|, made to add up to 1 again."""
    return normalised(F.transform(pmf, lambda p, i: p * F.coalesce(F.get(factors, F.abs(i + low)), F.lit(1.0))))


def above(pmf: Column, low: int, at: int = 0) -> Column:
    """P(k > at) and half of P(k = at)."""
    return total(F.transform(pmf, lambda p, i: F.when(i + low > at, p).when(i + low == at, p / 2).otherwise(0.0)))


def median(pmf: Column, low: int) -> Column:
    """The least k whose cumulative mass is a half or more, to nine places."""

    def step(s, x):
        c = s["c"] + x
        return F.struct(c.alias("c"), (s["n"] + F.when(c < 0.5 - 1e-9, 1).otherwise(0)).alias("n"))

    return F.aggregate(pmf, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")), step, lambda s: s["n"]) + low


def crps_normal(actual: Column, mu: Column, sigma: Column) -> Column:
    z = (actual - mu) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def crps_grid(actual: Column, pmf: Column, low: int) -> Column:
    """Sum over the grid of the squared gap between the cumulative mass and the outcome's step."""

    def step(s, x):
        c = s["c"] + x
        gap = c - F.when(s["k"] >= actual, 1.0).otherwise(0.0)
        return F.struct(c.alias("c"), (s["k"] + 1).alias("k"), (s["sum"] + gap * gap).alias("sum"))

    start = F.struct(F.lit(0.0).alias("c"), F.lit(low).cast("long").alias("k"), F.lit(0.0).alias("sum"))
    return F.aggregate(pmf, start, step, lambda s: s["sum"])


def crps_sample(actual: Column, samples: Column) -> Column:
    """Mean distance to the outcome less half the mean distance between samples, by one sort."""
    s, n = F.array_sort(samples), F.size(samples)
    near = total(F.transform(s, lambda x: F.abs(x - actual))) / n
    apart = total(F.transform(s, lambda x, i: x * (2 * i - n + 1)))
    return near - apart / (n * n)


def fold(pmf: Column, limit: Column, floor: float) -> Column:
    """Mass of the bins beyond `limit` moves to it; floored and made to add up to 1."""
    beyond = total(F.transform(pmf, lambda p, i: F.when(i > limit, p).otherwise(0.0)))
    moved = F.transform(pmf, lambda p, i: F.when(i < limit, p).when(i == limit, p + beyond).otherwise(0.0))
    return normalised(F.transform(moved, lambda p, i: F.when(i <= limit, F.greatest(p, F.lit(floor))).otherwise(0.0)))


def expectation(pmf: Column, low: int) -> Column:
    return total(F.transform(pmf, lambda p, i: p * (i + low)))


def shift_event(pmf: Column, low: int, at: Column, beta: float) -> Column:
    """Rescaled so that the logit of P(k >= at) moves by beta."""
    p = total(F.transform(pmf, lambda x, i: F.when(i + low >= at, x).otherwise(0.0)))

    def scaled(p):
        new = 1 / (1 + F.exp(-(F.log(p / (1 - p)) + beta)))
        ratios = F.struct((new / p).alias("up"), ((1 - new) / (1 - p)).alias("down"))
        return F.transform(F.array(ratios), lambda r: F.transform(pmf, lambda x, i: x * F.when(i + low >= at, r["up"]).otherwise(r["down"])))[0]

    return F.transform(F.array(p), lambda p: F.when((p > 0) & (p < 1), scaled(p)).otherwise(pmf))[0]


def trimmed(pmf: Column, tiny: float) -> Column:
    """struct(start, bins): without the tiny bins at both ends."""
    big = F.filter(F.sequence(F.lit(0), F.size(pmf) - 1), lambda i: F.get(pmf, i) >= tiny)
    lo, hi = F.array_min(big), F.array_max(big)
    return F.struct(lo.alias("start"), F.slice(pmf, lo + 1, hi - lo + 1).alias("bins"))
