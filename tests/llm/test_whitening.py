"""Whitening against plain numpy: covariances, eigenvectors and awkward vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridlore.llm import whitening as W
from gridlore.llm.queries import QUERIES


def _brute(vectors):
    """Whole numbers, count, sums, eigenvalues and axes by numpy's own solver."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[r[j] - s[j] / n for j in range(d)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    return n, deviation, centred @ v[:, ::-1] / np.sqrt(np.abs(e[::-1])), e[::-1] / e.sum()


def _same(rows, keys, vectors, count):
    n, deviation, white, explained = _brute(vectors)
    got = {(r["k"], r["component"]): r for r in rows}
    count = min(count, len(vectors[0]))
    assert sorted(got) == sorted((k, c + 1) for k in keys for c in range(count))
    for c in range(count):
        own = np.array([got[k, c + 1]["whitened"] for k in keys])
        want = white[:, c] * (1 if own @ white[:, c] > 0 else -1)
        assert np.allclose(own, want, atol=1e-8)
        assert math.isclose(got[keys[0], c + 1]["explained"], explained[c], rel_tol=1e-9)
    assert [got[k, 1]["deviation"] for k in keys] == deviation
    assert {r["n"] for r in rows} == {n} and all(r["identity_error"] < 1e-9 for r in rows)


@pytest.mark.parametrize("d,count", [(1, 32), (9, 4)])
def test_whitened(spark, d, count):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(150, d)) * rng.uniform(0.3, 3, d) + rng.normal(size=d) * 5).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "k long, v array<double>").repartition(7)
    _same(W.components(df, "k", "v", count).collect(), list(range(150)), vectors, count)


def test_query(spark, sf):
    rows = QUERIES["op11_qdwh_whitening"](spark, sf).withColumnRenamed("vec_id", "k").collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    _same(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table], 32)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0]]
    others = rng.normal(size=(12, 2)).tolist()
    vectors = [*good, *bad, *others]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in enumerate(vectors)], "k long, v array<double>, whitened double, vector_ string").repartition(5)
    rows = W.components(df, "k", "v").collect()
    _same([r for r in rows if r["k"] < 30], list(range(30)), good, 32)
    _same([r for r in rows if r["k"] >= 36], list(range(36, 48)), others, 32)
    assert len(rows) == 30 * 3 + 12 * 2
    full = W.whiten(df, "v", W.fit(df, "v")).collect()
    assert len(full) == 42 and {len(r["whitened_"]) for r in full} == {2, 3} and {r["whitened"] for r in full} == {1.0}


def test_no_variance_and_repeats(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "k long, v array<double>")
    rows = W.components(df, "k", "v").collect()
    assert len(rows) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(3, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)] * 2, "k long, v array<float>")
    rows = W.components(line, "k", "v").collect()
    assert {r["component"] for r in rows if r["whitened"] is not None} == {1} and len(rows) == 30
    assert max(r["identity_error"] for r in rows) < 1e-9 and math.isclose(max(r["explained"] for r in rows), 1.0)
    assert W.components(line.where("k > 9"), "k", "v").collect() == []


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(6)
    vectors = [[float(v) for v in rng.integers(-(1 << 52), 1 << 52, 3)] for _ in range(9)]
    rows = W.whiten(spark.createDataFrame(list(enumerate(vectors)), "k long, v array<double>"), "v", (fitted := W.fit(spark.createDataFrame([(0, v) for v in vectors], "k long, v array<double>"), "v"))).collect()
    n, deviation, white, _ = _brute(vectors)
    assert fitted[3].sums == [sum(math.floor(64 * v[j]) + 1_000_000 for v in vectors) for j in range(3)]
    assert all(r["deviation"] is None or int(r["deviation"]) == deviation[r["k"]] for r in rows)
    own = np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["k"])])
    assert np.allclose(np.abs(own), np.abs(white), atol=1e-6) and fitted[3].error < 1e-9
    assert W.components(spark.createDataFrame(list(enumerate(vectors)), "k long, v array<double>"), "k", "v").where("deviation IS NULL").count() == 27


@pytest.mark.parametrize("values", [[5.0] * 4 + [2.0] * 3 + [1.0], [3.0] * 6, [0.0] * 5, list(10.0 ** -np.arange(12.0)), [1.0, 1.0 + 1e-14, 2.0, 2.0]])
def test_eigen(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    a = q @ np.diag(values) @ q.T
    e, v = W.eigen((a + a.T) / 2)
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-14 * max(1.0, max(values)))
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-14 and np.abs(a @ v - v * e).max() <= 2e-15 * d * (max(values) or 1)


def test_polar():
    a = np.random.default_rng(1).normal(size=(20, 20)) @ np.diag(10.0 ** -np.linspace(0, 12, 20))
    u = W.polar(a)
    left, _, right = np.linalg.svd(a)
    assert np.abs(u.T @ u - np.eye(20)).max() < 1e-13 and np.abs(u - left @ right).max() < 1e-3
    h = u.T @ a
    assert np.abs(h - h.T).max() < 1e-13 * np.linalg.norm(a)
