"""Operators that SQL cannot express, against plain Python, and the errors that guards raise."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlore.functions import distributions as D
from gridlore.operators import aggregates as A
from gridlore.operators import boosting as B
from gridlore.operators import asof, contests, folds
from gridlore.operators import joins as J
from gridlore.operators import models as M
from gridlore.operators import quality as Q
from gridlore.operators import resampling as R
from gridlore.operators import windows as X
from gridlore.sources import files as S
from gridlore.streaming import ledger as L

GAMES = "game_id long, season int, week int, kickoff timestamp, home long, away long, home_score long, away_score long, neutral boolean, y double, league string"


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        h, a = rng.sample(range(6), 2)
        hs, as_ = rng.randrange(30), rng.randrange(30)
        played = i < 290
        rows.append((i, 2000 + i // 100, i % 100 // 6, None, h, a, hs if played else None, as_ if played else None, i % 9 == 0, (1.0 if hs > as_ else 0.5 if hs == as_ else 0.0) if played else None, "AB"[i % 2]))
    return spark.createDataFrame(rows, GAMES)


def test_elo_replay(games):
    cfg = folds.Elo(k=24.0, newcomer=1400.0, edge_step=2.0)
    got = {r["game_id"]: r for r in folds.elo(games, ["league"], ["season", "week", "game_id"], {5: cfg}).collect()}
    for league in "AB":
        r, season, first, edge = {}, None, True, cfg.edge
        for g in sorted((x for x in games.collect() if x["league"] == league), key=lambda x: (x["season"], x["week"], x["game_id"])):
            if g["season"] != season:
                if season is not None:
                    r, first = {t: v + cfg.regress * (cfg.mean - v) for t, v in r.items()}, False
                season = g["season"]
            new = cfg.mean if first else cfg.newcomer
            h, a = r.get(g["home"], new), r.get(g["away"], new)
            diff = h - a + (0 if g["neutral"] else edge)
            p = 1 / (1 + 10 ** (-diff / 400))
            assert math.isclose(got[g["game_id"]]["p_elo"], p) and math.isclose(got[g["game_id"]]["edge"], edge)
            if g["home_score"] is None:
                assert math.isclose(got[g["game_id"]]["home_post"], h)
                continue
            won = diff if g["home_score"] >= g["away_score"] else -diff
            margin = abs(g["home_score"] - g["away_score"])
            step = cfg.k * (math.log(margin + 1) * 2.2 / (0.001 * won + 2.2) if margin else 1.0) * (g["y"] - p)
            r[g["home"]], r[g["away"]] = h + step, a - step
            if not g["neutral"]:
                edge += cfg.edge_step * (g["y"] - p)


def test_margin_weight():
    """Values that the formula fixes: a tie counts 1, a favourite's win less, an upset too if leads count by size."""
    cfg = folds.Elo()
    assert folds.margin_weight(0, 100, cfg) == 1.0
    assert math.isclose(folds.margin_weight(1, 0, cfg), math.log(2)) and math.isclose(folds.margin_weight(10, 200, cfg), math.log(11) * 2.2 / 2.4)
    assert folds.margin_weight(10, 200, cfg) < folds.margin_weight(10, -200, cfg)
    size = folds.Elo(absolute=True, cap=2.0)
    assert folds.margin_weight(10, -200, size) == folds.margin_weight(10, 200, size) and folds.margin_weight(60, 0, size) == 2.0


def test_elo_ties_and_playoffs():
    tie = folds._EloState(folds.Elo(k=20.0, edge=0.0))
    tie.r = {"a": 1600.0, "b": 1500.0}
    _, _, p, h, a, _ = tie.play(2000, "a", "b", 10, 10, True)
    assert math.isclose(h, 1600 + 20 * (0.5 - p)) and math.isclose(h + a, 3100)
    kept = folds._EloState(folds.Elo(playoffs=False, edge_step=3.0))
    assert kept.play(2000, "a", "b", 30, 0, False, "POST")[3:] == (1500.0, 1500.0, 48.0) and kept.edge == 48.0
    assert kept.play(2000, "a", "b", 30, 0, False, "REG")[3] > 1500 and kept.edge > 48.0


def test_elo_grid_is_its_replays(games):
    kinds = games.withColumn("game_type", F.when(F.col("game_id") % 5 == 0, "POST").otherwise("REG"))
    grid = {i: folds.Elo(k=10.0 + 3 * i, edge=10.0 * i, edge_step=0.5 * i, absolute=i % 2 == 0, cap=[None, 1.5][i % 2], playoffs=i != 3, edge_by_margin=i > 2, newcomer=1450.0) for i in range(6)}
    got = {r["config"]: r for r in folds.elo_grid(kinds, ["league"], ["season", "week", "game_id"], grid, (2001, 2002)).collect()}
    rows = folds.elo(kinds, ["league"], ["season", "week", "game_id"], grid).where("season >= 2001 AND y IS NOT NULL").collect()
    for c in grid:
        own = [r for r in rows if r["config"] == c]
        assert got[c]["n"] == len(own) and math.isclose(got[c]["brier"], sum((r["p_elo"] - r["y"]) ** 2 for r in own) / len(own))


def test_kalman_is_the_posterior_mean(spark):
    """One week of games, then one more: the filter's mean is the Gaussian posterior's."""
    cfg = folds.Kalman()
    rows = [(1, 2000, 1, None, 0, 1, 20, 10, True, 1.0, "A"), (2, 2000, 1, None, 1, 2, 14, 17, True, 0.0, "A"), (3, 2000, 2, None, 0, 2, 7, 3, True, 1.0, "A")]
    got = {r["game_id"]: r for r in folds.kalman(spark.createDataFrame(rows, GAMES), ["league"]).collect()}
    h = np.array([[1.0, -1, 0], [0, 1, -1]])
    v = cfg.start_var * np.eye(3)
    s = h @ v @ h.T + cfg.noise_var * np.eye(2)
    m = v @ h.T @ np.linalg.solve(s, [10, -3])
    after = v - v @ h.T @ np.linalg.solve(s, h @ v) + cfg.week_var * np.eye(3)
    w = np.array([1.0, 0, -1])
    assert math.isclose(got[3]["mean"], w @ m) and math.isclose(got[3]["sd"] ** 2, w @ after @ w + cfg.noise_var)


def _posterior(games, cfg, teams):
    """(mean, covariance) of every measurement of games, in order, in one joint Gaussian, by unrolling the states: state 0 is the edge."""
    n, now = len(teams) + 1, None
    mean, rows, noise = np.zeros(n), [], []
    root = np.diag([math.sqrt(cfg.edge_var), *[math.sqrt(cfg.start_var)] * len(teams)])
    mean[0] = cfg.edge
    for season, week, home, away, site in games:
        if now is not None and (season, week) != now:
            new_season = season != now[0]
            drift = [cfg.edge_drift * (1 if new_season else week - now[1]), *[cfg.season_var if new_season else cfg.week_var * (week - now[1])] * len(teams)]
            if new_season:
                mean[1:] *= cfg.carry
                root[1:] *= cfg.carry
            root = np.hstack([root, np.diag(np.sqrt(drift))])
        now = (season, week)
        d = np.zeros(n)
        d[1 + teams.index(home)], d[1 + teams.index(away)] = 1.0, -1.0
        a = d.copy()
        a[0] = site
        rows.append((a @ mean, a @ root, d @ mean, d @ root))
    width = root.shape[1]
    pad = lambda r: np.pad(r, (0, width - len(r)))
    return [(m, pad(r), m2, pad(r2)) for m, r, m2, r2 in rows]


def _brute_kalman(games, cfg, teams):
    """Mean, variance, own and joint log density of each game given all games of earlier weeks, by conditioning one joint Gaussian."""
    rows = _posterior([g[:5] for g in games], cfg, teams)
    cross = cfg.rho * math.sqrt(cfg.noise_var * cfg.second_var)
    out = []
    for k, g in enumerate(games):
        seen, values, kinds = [], [], []
        for q, h in enumerate(games):
            if h[:2] < g[:2] and h[5] is not None:
                seen.append((rows[q][0], rows[q][1])); values.append(h[5]); kinds.append((q, 0))
                if h[6] is not None:
                    seen.append((rows[q][2], rows[q][3])); values.append(cfg.scale * (h[6] - cfg.second_edge * h[4])); kinds.append((q, 1))
        own = [(rows[k][0], rows[k][1]), (rows[k][2], rows[k][3])]
        noise = lambda x, y: 0.0 if x[0] != y[0] else cross if x[1] != y[1] else (cfg.noise_var, cfg.second_var)[x[1]]
        every, kinds = seen + own, kinds + [(k, 0), (k, 1)]
        cov = np.array([[a[1] @ b[1] + noise(x, y) for b, y in zip(every, kinds)] for a, x in zip(every, kinds)])
        mu = np.array([m for m, _ in every])
        n = len(seen)
        if n:
            w = np.linalg.solve(cov[:n, :n], cov[:n, n:]).T
            mu, cov = mu[n:] + w @ (np.array(values) - mu[:n]), cov[n:, n:] - w @ cov[:n, n:]
        loglik = joint = None
        if g[5] is not None:
            loglik = -0.5 * (math.log(2 * math.pi * cov[0, 0]) + (g[5] - mu[0]) ** 2 / cov[0, 0])
            joint = loglik
            if g[6] is not None:
                r = np.array([g[5], cfg.scale * (g[6] - cfg.second_edge * g[4])]) - mu
                joint = -0.5 * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(cov)) + r @ np.linalg.solve(cov, r)) + math.log(cfg.scale)
        out.append((mu[0], math.sqrt(cov[0, 0]), loglik, joint))
    return out


def test_kalman_with_two_measurements(spark):
    """Means, deviations and both densities against one joint Gaussian: gaps of weeks, three seasons, missing second measurements, unplayed games."""
    rng = random.Random(12)
    configs = {3: folds.Kalman(edge_var=5.0, edge_drift=0.2, second_var=80.0, rho=0.6, scale=9.0, second_edge=0.1), 8: folds.Kalman(carry=0.4, rho=-0.4, edge_var=1.0, noise_var=90.0), 9: folds.Kalman()}
    rows, games = [], []
    for week in [(2000, 1), (2000, 2), (2000, 5), (2001, 3), (2001, 4), (2003, 1)]:
        for _ in range(4):
            h, a = rng.sample(range(5), 2)
            played, site = rng.random() < 0.85, rng.random() < 0.7
            hs, as_ = (rng.randrange(30), rng.randrange(30)) if played else (None, None)
            e = rng.gauss(0, 1) if rng.random() < 0.6 else None
            rows.append((len(rows), *week, None, h, a, hs, as_, not site, None, "A", e))
            games.append((*week, h, a, float(site), hs - as_ if played else None, e))
    # all sides start at level 0 in the first week, so that the filter's prior is the joint one
    rows = [(-1, 2000, 1, None, 0, 1, None, None, True, None, "A", None), (-2, 2000, 1, None, 2, 3, None, None, True, None, "A", None), (-3, 2000, 1, None, 4, 0, None, None, True, None, "A", None), *rows]
    df = spark.createDataFrame(rows, f"{GAMES}, e double").repartition(4)
    got = {(r["config"], r["game_id"]): r for r in folds.kalman(df, ["league"], configs, "e").collect()}
    sums = {r["config"]: r for r in folds.kalman_profile(df, ["league"], configs, (2001, 2003), "e").collect()}
    early = {r["config"]: r for r in folds.kalman_profile(df, ["league"], configs, (2000, 2001), "e", (1, 3)).collect()}
    for c, cfg in configs.items():
        want = _brute_kalman(games, cfg, list(range(5)))
        for i, (mean, sd, own, joint) in enumerate(want):
            r = got[c, i]
            assert math.isclose(r["mean"], mean, abs_tol=1e-8) and math.isclose(r["sd"], sd, rel_tol=1e-9)
            assert (r["loglik"] is None) == (own is None) and (own is None or math.isclose(r["loglik"], own, rel_tol=1e-9) and math.isclose(r["joint_loglik"], joint, rel_tol=1e-9))
        late = [w for w, g in zip(want, games) if g[0] >= 2001 and w[2] is not None]
        assert sums[c]["n"] == len(late) and math.isclose(sums[c]["joint_loglik"], sum(w[3] for w in late), rel_tol=1e-9)
        some = [w for w, g in zip(want, games) if g[0] <= 2001 and g[1] <= 3 and w[2] is not None]
        assert early[c]["n"] == len(some) and math.isclose(early[c]["loglik"], sum(w[2] for w in some), rel_tol=1e-9)


def test_kalman_second_measurement_adds_information(spark):
    cfg = {0: folds.Kalman(edge_var=1.0)}
    row = lambda i, w, h, a, hs, e: (i, 2000, w, None, h, a, hs, 0 if hs is not None else None, False, None, "A", e)
    rows = lambda e: spark.createDataFrame([row(1, 1, 0, 1, 7, e), row(2, 2, 0, 1, None, None)], f"{GAMES}, e double")
    one, two = (folds.kalman(rows(e), ["league"], cfg, "e").where("game_id = 2").first() for e in (None, 14.0))
    assert two["sd"] < one["sd"] and two["mean"] > one["mean"]


def test_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (80, 2))
    y, w = rng.normal(size=80), rng.uniform(0.5, 2, 80)
    rows = [([("mean|", 1.0), (f"a|{i}", 1.0), (f"b|{j}", 1.0)], float(v), float(k), n) for n, ((i, j), v, k) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "terms array<struct<key:string,x:double>>, y double, w double, n long")
    got = {r["key"]: r["coef"] for r in M.solve_ridge(M.gram(df, [], ["n"], "y", "w"), [], {"mean": 1e-6, "a": 2.0}, 3.0).collect()}
    keys = sorted(got)
    design = np.array([[float(k in {t for t, _ in r[0]}) for k in keys] for r in rows])
    pen = np.diag([{"mean": 1e-6, "a": 2.0}.get(k.split("|")[0], 3.0) for k in keys])
    want = np.linalg.solve(design.T @ (design * w[:, None]) + pen, design.T @ (w * y))
    assert np.allclose([got[k] for k in keys], want)


def _members(spark, n, keys, seed=1, seasons=3):
    """Rows of several members of two sides and a situation term, of a few seasons."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        off, dfn = (rng.choice(keys, 4, replace=False) for _ in range(2))
        terms = [("mean|", 1.0), ("z|home", float(i % 2)), *[(f"off|{k}", 1.0) for k in off], *[(f"def|{k}", 1.0) for k in dfn]]
        rows.append((2000 + i % seasons, i, terms, float(rng.normal() + 0.1 * off[0] - 0.05 * dfn[0]), float(rng.uniform(0.5, 2))))
    df = spark.createDataFrame(rows, "season int, n long, terms array<struct<key:string,x:double>>, y double, w double")
    priors = [(k, float(rng.normal()), float(rng.uniform(1, 20))) for k in [*[f"off|{k}" for k in range(0, keys, 2)], *[f"def|{k}" for k in range(0, keys, 3)], "off|unseen"]]
    return rows, df, priors


def _dense_ridge(rows, weights, priors, penalty, default):
    keys = sorted({k for r in rows for k, _ in r[2]})
    x = np.array([[dict(r[2]).get(k, 0.0) for k in keys] for r in rows])
    known = {k: (m, p) for k, m, p in priors}
    m = np.array([known.get(k, (0.0, 0))[0] for k in keys])
    lam = np.array([known[k][1] if k in known else penalty.get(k.split("|")[0], default) for k in keys])
    y = np.array([r[3] for r in rows])
    h = x.T @ (x * weights[:, None])
    return dict(zip(keys, m + np.linalg.solve(h + np.diag(lam), x.T @ (weights * (y - x @ m)))))


def test_ridge_with_priors(spark):
    """Prior means, a penalty for each key, both sides and a situation term; dense and by conjugate gradients."""
    rows, df, priors = _members(spark, 160, 12)
    table = spark.createDataFrame([(s, *p) for s in (2000, 2001, 2002) for p in priors], "season int, key string, prior double, penalty double")
    equations = M.gram(df, ["season"], ["n"], "y", "w").persist()
    for dense in (1500, 3):
        got = {(r["season"], r["key"]): r for r in M.solve_ridge(equations, ["season"], {"mean": 1e-3, "z": 0.5}, 4.0, table, dense).collect()}
        for season in (2000, 2001, 2002):
            own = [r for r in rows if r[0] == season]
            want = _dense_ridge(own, np.array([r[4] for r in own]), priors, {"mean": 1e-3, "z": 0.5}, 4.0)
            assert all(math.isclose(got[season, k]["coef"], v, abs_tol=1e-8) for k, v in want.items())
            assert got[season, "off|unseen"]["coef"] == dict((k, m) for k, m, _ in priors)["off|unseen"] and got[season, "off|unseen"]["weight"] == 0
    assert M.solve_ridge(equations.where("season > 2005"), ["season"], {}, 1.0).count() == 0


def test_season_ahead_statistics(spark):
    """Statistics of seasons that decay and add up, against one dense fit of the weighted rows before each season."""
    rows, df, priors = _members(spark, 150, 10, seed=5)
    combined = M.decayed_gram(M.gram(df, ["season"], ["n"], "y", "w"), "season", 0.4, 2004)
    table = spark.createDataFrame([(s, *p) for s in range(2001, 2005) for p in priors], "season int, key string, prior double, penalty double")
    got = {(r["season"], r["key"]): r["coef"] for r in M.solve_ridge(combined, ["season"], {"mean": 1e-3}, 4.0, table).collect()}
    assert {s for s, _ in got} == {2001, 2002, 2003, 2004}
    for season in range(2001, 2005):
        past = [r for r in rows if r[0] < season]
        w = np.array([r[4] * 0.4 ** (season - 1 - r[0]) for r in past])
        assert all(math.isclose(got[season, k], v, abs_tol=1e-8) for k, v in _dense_ridge(past, w, priors, {"mean": 1e-3}, 4.0).items())


def test_ridge_of_many_members(spark):
    """20,000 members, without a dense system: the residual of the normal equations is nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, [("mean|", 1.0), *[(f"m|{k}", 1.0) for k in rng.integers(0, 20_000, 3)]], float(rng.normal())) for i in range(20_000)]
    df = spark.createDataFrame(rows, "n long, terms array<struct<key:string,x:double>>, y double")
    equations = M.gram(df, [], ["n"], "y").persist()
    coefs = M.solve_ridge(equations, [], {"mean": 1e-3}, 2.0).persist()
    assert coefs.count() > M.DENSE_KEYS
    left = equations.where("j IS NOT NULL").join(coefs.select(F.col("key").alias("j"), "coef"), "j").groupBy("i").agg(F.sum(F.col("s") * F.col("coef")).alias("ax"))
    penalty = F.when(F.col("i") == "mean|", 1e-3).otherwise(2.0)
    gap = left.join(coefs.select(F.col("key").alias("i"), "coef"), "i").join(equations.where("j IS NULL").select("i", F.col("s").alias("b")), "i").select(F.max(F.abs(F.col("ax") + penalty * F.col("coef") - F.col("b")))).first()[0]
    assert gap < 1e-7


def test_waterfill(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([1.0, 2.0, 5.0, 40.0])) for g in range(6) for i in range(1 + 3 * g)]
    for slots in (1, 3, 5):
        got = {(r["g"], r["i"]): r["share"] for r in A.waterfill(spark.createDataFrame(rows, "g int, i int, u double"), ["g"], "u", slots, ["i"]).collect()}
        for g in range(6):
            u = {i: v for h, i, v in rows if h == g}
            share = [got[g, i] for i in u]
            assert math.isclose(sum(share), min(slots, len(u))) and max(share) <= 1 + 1e-9
            free = [(got[g, i] / u[i]) for i in u if got[g, i] < 1]
            assert not free or max(free) - min(free) < 1e-9


def test_distributions(spark):
    row = spark.range(1).select(D.normal_pmf(F.lit(1.5), F.lit(4.0), -30, 30).alias("p"), D.normal_cdf(F.lit(1.0)).alias("c"))
    got = row.select("p", "c", D.median(F.col("p"), -30).alias("m"), D.total(F.col("p")).alias("t"), D.crps_sample(F.lit(2.0), F.array(*[F.lit(x) for x in (0.0, 3.0, 7.0)])).alias("s")).first()
    assert abs(got["c"] - 0.8413447) < 1e-6 and got["m"] in (1, 2) and abs(got["t"] - 1) < 1e-9
    assert math.isclose(got["s"], (2 + 1 + 5) / 3 - (3 + 7 + 4) * 2 / 18)


def test_bootstrap(spark):
    df = spark.createDataFrame([(i // 4, float((i * 7) % 11)) for i in range(400)], "c long, v double")
    r = R.bootstrap_mean(df, "v", ["c"], reps=200).first()
    sums = np.array([sum((i * 7) % 11 for i in range(4 * c, 4 * c + 4)) for c in range(100)]) / 4
    assert r["n"] == 400 and r["low"] < r["mean"] < r["high"] and 0.6 < r["se"] / (sums.std() / 10) < 1.5
    assert abs(R.replicates(df, 50, 1, ["c", "v"]).agg(F.sum("weight")).first()[0] / 20_000 - 1) < 0.05


def test_bits_of_many_hashes():
    """Hashes taken together are those of hashlib, for texts of one block and longer ones."""
    for texts in ([b"", b"|1", b"|123456", b"|a|bc"], [b"x" * 55, b"y" * 70], [b"|%d" % i for i in range(20_000)]):
        heads = [b"7|%d" % r for r in (0, 9, 10, 99)] if len(texts[0]) < 50 else [b""]
        want = [[int(hashlib.md5(h + x).hexdigest()[:13], 16) for x in texts] for h in heads]
        assert R.md5_bits(heads, texts).tolist() == want
    assert [R.POISSON_HEX[0], len(R.POISSON_HEX[-1])] == [f"{math.ceil(math.exp(-1) * 2**52):013x}", 13]


def test_bootstrap_of_means_draws_as_replicates(spark):
    """A task's sums are those of the repeated rows, by group and with a null cluster; only partial sums reach the shuffle."""
    df = spark.createDataFrame([(i % 3, i // 4 if i > 20 else None, float((i * 7) % 11)) for i in range(400)], "k long, c long, v double").repartition(7)
    sums = df.groupBy("k", "c").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    means = R.replicates(sums, 30, 7, ["c"]).groupBy("k", "rep").agg((F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("n"))).alias("m"))
    want = {r["k"]: r for r in means.groupBy("k").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.stddev_samp("m").alias("se")).collect()}
    got = R.bootstrap_mean(df, "v", ["c"], ["k"], reps=30)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        assert np.allclose([r["low"], r["se"]], [want[r["k"]]["low"], want[r["k"]]["se"]])


def test_corrupted_numbers_all_change(spark):
    """Numbers that equal their own noise change too."""
    df = spark.range(3000).withColumns({"at": F.lit(1), "v": F.pmod(F.xxhash64(F.lit(0), F.lit("v"), "id"), F.lit(2_000_001)) / 1e6 - 1.0})
    got = asof.corrupt_after(df.withColumn("v0", F.col("v")), "at", F.lit(1), ["v"], ["id"]).agg(F.count_if(F.col("v") == F.col("v0")), F.min("v"), F.max("v")).first()
    assert got[0] == 0 and -1 <= got[1] and got[2] <= 1


def _newton(x, y, w, rounds=60):
    design, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        m = 1 / (1 + np.exp(-design @ b))
        b = b + np.linalg.solve(design.T @ (design * (w * m * (1 - m))[:, None]), design.T @ (w * (y - m)))
    return b


def test_multinomial_weights(spark):
    df = spark.createDataFrame([(i % 37 if i % 37 else None, "x") for i in range(200)], "g long, s string").repartition(5)
    rows = R.multinomial_weights(df, ["g"], 25, 4).collect()
    assert sorted(r["g"] or 0 for r in rows) == list(range(37))
    assert all(sum(r["weights"][k] for r in rows) == 37 for k in range(25))  # n draws each
    drawn = np.array([r["weights"] for r in rows])
    assert abs((drawn == 0).mean() - (1 - 1 / 37) ** 37) < 0.05 and len({tuple(d) for d in drawn.T}) == 25
    again = R.multinomial_weights(df.repartition(2), ["g"], 25, 4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert R.multinomial_weights(df.where("g > 99"), ["g"], 3, 1).collect() == []
    at = R.numbered(spark.range(5000), ["id"], 3, 16).collect()
    assert sorted(r["at"] for r in at) == list(range(5000))


def test_refits_equal_single_weighted_fits(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 + x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    y[:30] = 0.5
    rows = [(i // 5, "ab"[i % 2], *map(float, x[i]), float(y[i])) for i in range(n)] + [(1, "a", None, 0.0, 1.0), (2, None, 1.0, 1.0, None)]
    df = R.with_weights(spark.createDataFrame(rows, "game long, side string, x0 double, x1 double, y double").repartition(6), ["game"], 3, 8)
    weights = {r["game"]: r["weights"] for r in df.select("game", "weights").distinct().collect()}
    for by in (None, "side"):
        fits = R.refit_logistic(df, ["x0", "x1"], "y", "weights", by).collect()
        assert len(fits) == (3 if by is None else 6)
        for f in fits:
            use = [i for i in range(n) if by is None or rows[i][1] == f["side"]]
            w = np.array([weights[rows[i][0]][f["rep"]] for i in use], float)
            assert np.allclose(f["coefs"], _newton(x[use], y[use], w), atol=1e-6)


def test_option_bands(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(40, 3, 12)).round(2)
    df = spark.createDataFrame([(i, *[v.tolist() for v in row]) for i, row in enumerate(values)], "id long, go array<double>, kick array<double>, punt array<double>")
    for r in R.option_bands(df, ["id"], ["go", "kick", "punt"], 0.8).collect():
        v = values[r["id"]]
        order = sorted(range(3), key=lambda k: (-v[k, 0], k))
        gaps = v[order[0], 1:] - v[order[1], 1:]
        low, high = np.quantile(gaps, [0.1, 0.9])
        assert (r["best"], r["second"]) == tuple(("go", "kick", "punt")[k] for k in order[:2])
        assert np.allclose([r["margin"], r["band_low"], r["band_high"]], [v[order[0], 0] - v[order[1], 0], low, high]) and r["tossup"] == (low <= 0 <= high)


def test_stack(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.8 * x[:, 2])))).astype(float)
    w = rng.random(400) + 0.5
    df = spark.createDataFrame([(*map(float, r), float(v), float(u)) for r, v, u in zip(x, y, w, strict=True)], "a double, b double, c double, y double, w double")
    for penalty in (0.001, 0.3):
        want, design = np.array([0.0, 1 / 3, 1 / 3, 1 / 3]), np.c_[np.ones(400), x]
        for _ in range(20_000):  # projected gradient
            slope = design.T @ (w * (1 / (1 + np.exp(-design @ want)) - y)) / w.sum() + 2 * penalty * np.r_[0.0, want[1:] - 1 / 3]
            want = want - 0.5 * slope
            want[1:] = np.maximum(want[1:], 0.0)
        assert np.allclose(M.fit_stack(df, ["a", "b", "c"], "y", penalty, "w"), want, atol=1e-6), penalty
    assert np.allclose(M.fit_stack(df, ["a", "b", "c"], "y", 1e6)[1:], 1 / 3, atol=1e-4)
    assert M.fit_stack(df.where("y > 5"), ["a", "b", "c"], "y", 1.0) == [0.0, 1 / 3, 1 / 3, 1 / 3]


def _ladder(spark, results, teams, steps, **options):
    both = [r for a, b, x, d in results for r in ((a, b, x, d), (b, a, 1 - x, -d))]
    rows = spark.createDataFrame(both, "team string, opp string, result double, margin double").withColumn("s", F.lit(1))
    table = spark.createDataFrame(teams, "team string, division string, pct double, net double").withColumn("s", F.lit(1))
    group = [] if "best_of" in options else ["division"]
    if group == []:
        table = table.withColumn("at", F.row_number().over(Window.partitionBy("division").orderBy(F.desc("pct"), F.desc("net"))))
    return [r["team"] for r in X.tie_ladder(rows, table, ["s"], group, "pct", steps, **options).orderBy("place").collect()]


def test_tie_ladder(spark):
    w = lambda a, b: (a, b, 1.0, 7.0)
    four = [(x, "e", 0.5, float(n)) for n, x in enumerate("abc")] + [("d", "e", 0.2, 0.0)]
    three = [w("a", "b"), w("a", "b"), w("a", "c"), w("c", "a"), w("b", "c"), w("b", "c")]
    assert _ladder(spark, three, four, ["h2h", "net"]) == ["a", "b", "c", "d"]  # 3-1, 2-2, 1-3 among three; then b before c
    ring = [w("a", "b"), w("b", "c"), w("c", "a"), w("a", "x"), w("x", "b"), w("c", "x")]
    assert _ladder(spark, ring, four, ["h2h", "common", "net"]) == ["c", "a", "b", "d"]  # common leaves a and c, who begin at h2h anew
    assert _ladder(spark, [w("b", "x"), w("y", "a")], four, ["h2h", "common", "net"]) == ["c", "b", "a", "d"]  # neither step applies
    assert _ladder(spark, [], [(x, "e", None, 0.0) for x in "ba"], ["h2h", "net"]) == ["a", "b"]
    wild = [("a", "n", 0.5, 3.0), ("b", "n", 0.5, 2.0), ("c", "m", 0.5, 1.0), ("d", "o", 0.5, 0.0)]
    swept = [w("d", "a"), w("d", "c"), w("b", "d"), w("b", "c")]
    assert _ladder(spark, swept, wild, ["sweep", "net"], best_of=("division", "at")) == ["d", "a", "b", "c"]  # b waits for a; d beat a and c


def _seeds(results, table, div_steps, wild_steps, n):
    """Seeds by plain dictionaries: the ladder, the best of each division, one pick after another."""
    met = {}
    for a, b, x, d in results:
        for t, o, r, m in ((a, b, x, d), (b, a, 1 - x, -d)):
            met.setdefault(t, []).append((o, r, m))
    facts = {t["team"]: t for t in table}

    def step(name, tied):
        if name not in X.AMONG:
            return {t: facts[t][name] for t in tied}
        games = {t: [g for g in met.get(t, []) if g[0] in tied] if name in ("h2h", "sweep") else met.get(t, []) for t in tied}
        if name not in ("h2h", "sweep"):
            shared = set.intersection(*[{g[0] for g in games[t]} for t in tied])
            games = {t: [g for g in games[t] if g[0] in shared] for t in tied}
        if name == "common_net":
            return {t: sum(g[2] for g in games[t]) for t in tied}
        if any(len(games[t]) < (4 if name == "common4" else 1) for t in tied) and not (name == "sweep" and len(tied) > 2):
            return None
        if name == "sweep" and len(tied) > 2:
            full = {t: len({g[0] for g in games[t]}) == len(tied) - 1 for t in tied}
            beat = {t: full[t] and all(g[1] == 1 for g in games[t]) for t in tied}
            lost = {t: full[t] and all(g[1] == 0 for g in games[t]) for t in tied}
            return {t: float(beat[t]) if any(beat.values()) else float(not lost[t]) for t in tied}
        return {t: sum(g[1] for g in games[t]) / len(games[t]) for t in tied}

    def pick(tied, steps):
        tied = sorted(tied)
        while len(tied) > 1:
            for name in steps:
                v = step(name, tied)
                best = tied if v is None or any(x is None for x in v.values()) else [t for t in tied if v[t] >= max(v.values()) - 1e-9]
                if len(best) < len(tied):
                    tied = best
                    break
            else:
                return tied[0]
        return tied[0]

    def order(teams, choose):
        out, left = [], list(teams)
        while left:
            top = max(facts[t]["pct"] for t in left)
            out.append(choose([t for t in left if facts[t]["pct"] == top]))
            left.remove(out[-1])
        return out

    divisions = {}
    for t in table:
        divisions.setdefault(t["division"], []).append(t["team"])
    ladder = {d: order(ts, lambda g: pick(g, div_steps)) for d, ts in divisions.items()}

    def wild(group):
        best = [min((t for t in group if facts[t]["division"] == d), key=ladder[d].index) for d in {facts[t]["division"] for t in group}]
        return pick(best, wild_steps)

    winners = [o[0] for o in ladder.values()]
    return (order(winners, wild) + order([t for t in facts if t not in winners], wild))[:n]


def test_seed_field(spark):
    """Random small leagues, full of ties, against plain dictionaries."""
    rng = random.Random(31)
    rows, teams, want = [], [], {}
    for league in range(12):
        names = [f"{d}{k}" for d in "abc" for k in range(3)]
        results = [(*rng.sample(names, 2), rng.choice([0.0, 1.0, 1.0, 0.5]), float(rng.randrange(1, 5))) for _ in range(14)]
        results = [(a, b, x, 0.0 if x == 0.5 else d if x else -d) for a, b, x, d in results]
        sides = [r for a, b, x, d in results for r in ((a, b, x, d), (b, a, 1 - x, -d))]
        own = []
        for t in names:
            mine = [s for s in sides if s[0] == t]
            if mine:
                own.append({"team": t, "division": t[0], "conf": "z", "pct": round(sum(s[2] for s in mine) / len(mine), 9), "net": sum(s[3] for s in mine), "rank": -float(rng.randrange(3))})
        rows += [(league, *s) for s in sides]
        teams += [(league, *o.values()) for o in own]
        want[league] = _seeds(results, own, ("h2h", "common", "net"), ("sweep", "common4", "rank", "net"), 6)
    games = spark.createDataFrame(rows, "league int, team string, opp string, result double, margin double")
    table = spark.createDataFrame(teams, "league int, team string, division string, conf string, pct double, net double, rank double")
    got = X.seed_field(games, table, ["league"], "division", "conf", "pct", ("h2h", "common", "net"), ("sweep", "common4", "rank", "net"), 6).collect()
    for league, order in want.items():
        assert [r["team"] for r in sorted(got, key=lambda r: r["seed"]) if r["league"] == league] == order, league


def test_division_ladders_are_climbed_once(spark):
    """Ties are rows of a sorted partition, and the divisions' places are written for the three uses of them."""
    games = spark.createDataFrame([(1, "a", "b", 0.5, 0.0), (1, "b", "a", 0.5, 0.0)], "league int, team string, opp string, result double, margin double")
    table = spark.createDataFrame([(1, t, "x", "z", 0.5, 0.0) for t in "ab"], "league int, team string, division string, conf string, pct double, net double")
    got = X.seed_field(games, table, ["league"], "division", "conf", "pct", ("h2h", "net"), ("sweep", "net"), 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 2
    assert sorted((r["team"], r["seed"]) for r in got.collect()) == [("a", 1), ("b", 2)]


def test_combined_ranks(spark):
    df = spark.createDataFrame([("a", 30, 10), ("b", 20, 10), ("c", 30, 40)], "team string, f long, a long").withColumn("s", F.lit(1))
    assert {r["team"]: r["k"] for r in X.combined_ranks(df, ["s"], "f", "a", "k").collect()} == {"a": -2.0, "b": -4.0, "c": -4.0}


def test_isotonic_rises_between_block_centres(spark):
    rng = np.random.default_rng(14)
    x = np.round(rng.random(500), 2)
    y = (rng.random(500) < x**2).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    knots = M.fit_isotonic(df, "x", "y")
    blocks = [[a, [b]] for a, b in sorted((float(a), [b for c, b in zip(x, y) if c == a]) for a in set(x))]
    blocks = [[sum([[a] * len(b[0])], []), b[0]] for a, b in blocks]
    i = 0
    while i < len(blocks) - 1:  # pool neighbours that fall
        if np.mean(blocks[i][1]) >= np.mean(blocks[i + 1][1]):
            blocks[i : i + 2] = [[blocks[i][0] + blocks[i + 1][0], blocks[i][1] + blocks[i + 1][1]]]
            i = max(i - 1, 0)
        else:
            i += 1
    want = [(np.mean(a), np.mean(b)) for a, b in blocks]
    assert np.allclose(knots[1:-1], want) and knots[0] == (0.0, 0.0) and knots[-1] == (1.0, 1.0)
    at = [-0.5, 0.0, *np.linspace(0.001, 0.999, 300).tolist(), 1.0, 2.0]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in at], "x double").select(M.interpolated(F.col("x"), knots)).collect()]
    assert np.allclose(got, np.clip(np.interp(at, *zip(*knots)), 1e-6, 1 - 1e-6))
    inside = [g for v, g in zip(at, got) if knots[1][0] < v < knots[-2][0] and 1e-6 < g < 1 - 1e-6]
    assert len(inside) > 200 and all(a < b for a, b in zip(inside, inside[1:]))
    assert spark.range(1).select(M.interpolated(F.lit(None).cast("double"), knots)).first()[0] is None and M.fit_isotonic(df.where("x > 5"), "x", "y") == [(0.0, 0.0), (1.0, 1.0)]


def test_crossfit_sees_no_own_fold(spark):
    """Propensities and means of a fold don't change with its rows; a known effect comes out."""
    rng = np.random.default_rng(17)
    n = 3000
    x = rng.normal(size=n)
    logits = np.c_[np.zeros(n), 0.8 * x, -0.5 * x]
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    a = np.array([rng.choice(3, p=q) for q in p])
    y = x + np.array([0.0, 0.7, -0.3])[a] + rng.normal(size=n) * 0.5
    rows = [(i, 2000 + i % 4, float(x[i]), float(a[i]), float(y[i])) for i in range(n)]
    schema = "id long, season int, x double, action double, y double"
    fit = lambda r, extra=None: M.action_nuisances(spark.createDataFrame(r, schema), ["id"], "season", "action", 3, ["x"], "y", extra)
    whole = fit(rows).persist()
    got = {r["id"]: r for r in whole.collect()}
    changed = {r["id"]: r for r in fit([(i, s, v, (k + 1) % 3, -9 * w) if s == 2002 else (i, s, v, k, w) for i, s, v, k, w in rows]).collect()}
    own = [i for i in range(n) if i % 4 == 2]
    assert all(np.allclose(got[i]["e"], changed[i]["e"], atol=1e-6) and np.allclose(got[i]["mu"], changed[i]["mu"], atol=1e-6) for i in own)
    assert not np.allclose(got[0]["mu"], changed[0]["mu"], atol=1e-3)
    assert np.abs(np.array([got[i]["e"] for i in range(n)]) - p).mean() < 0.02
    g = whole.select(M.pseudo_outcomes(F.col("e"), F.col("mu"), F.col("action"), F.col("y")).alias("g")).collect()
    means = np.mean([r["g"] for r in g], axis=0)
    assert np.allclose(means - means[0], [0.0, 0.7, -0.3], atol=0.08)
    past = [r for r in rows if r[1] < 2003]
    later = spark.createDataFrame([r for r in rows if r[1] == 2003], schema)
    ahead = {r["id"]: r for r in fit(past, later).collect()}
    assert len(ahead) == n and all(np.allclose(ahead[i]["mu"], got[i]["mu"], atol=1e-6) for i in range(3, n, 4))
    with pytest.raises(ValueError, match="two folds"):
        fit([r for r in rows if r[1] == 2000])


def test_boosting_of_classes(spark):
    rng = np.random.default_rng(21)
    n, classes = 4000, 6
    x = rng.integers(0, 12, (n, 2)).astype(float)
    y = np.clip((x[:, 0] >= 6) * 3 + rng.integers(0, 2, n) + (x[:, 1] > 8), 0, classes - 1)
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 2), (3.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(5)
    cfg = B.Boost(rounds=6, depth=2, rate=0.5, penalty=1.0)
    model = B.fit_boost(df, ["a", "b"], "y", classes, cfg)
    assert len(model.losses) == 7 and all(u > v for u, v in zip(model.losses, model.losses[1:]))
    got = B.predict_boost(df.where("y IS NOT NULL AND a IS NOT NULL"), model, cfg).collect()
    assert all(abs(sum(r["shares"]) - 1) < 1e-9 for r in got)
    low = [r["shares"] for r in got if r["a"] < 6 and r["b"] <= 8]
    assert np.abs(np.mean(low, axis=0) - [0.5, 0.5, 0, 0, 0, 0]).max() < 0.1
    base = np.bincount(y, minlength=classes) / n
    own = lambda q, k: sum((sum(q[: j + 1]) - (k <= j)) ** 2 for j in range(classes))
    scored = B.predict_boost(df.where("y IS NOT NULL"), model, cfg).select("y", "shares", B.class_crps(F.col("shares"), F.col("y")).alias("c")).collect()
    assert all(math.isclose(r["c"], own(r["shares"], r["y"]), rel_tol=1e-9) for r in scored[:200])
    assert np.mean([r["c"] for r in scored]) < 0.5 * np.mean([own(base, k) for k in y])


def test_first_split_is_the_best_one(spark):
    """One stump of three classes against a search over all splits with dense sums."""
    rng = np.random.default_rng(22)
    x = rng.integers(0, 7, (300, 2)).astype(float)
    y = (x[:, 1] > 3).astype(int) + rng.integers(0, 2, 300)
    cfg = B.Boost(rounds=1, depth=1, rate=1.0, penalty=2.0, least=0.0)
    model = B.fit_boost(spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, y int"), ["a", "b"], "y", 3, cfg)
    p = softmax = np.exp(model.base) / np.exp(model.base).sum()
    g, h = np.eye(3)[y] - p, np.tile(p * (1 - p), (300, 1))
    worth = lambda m: ((g[m].sum(0)) ** 2 / (h[m].sum(0) + 2.0)).sum()
    best = max((worth(x[:, f] <= c) + worth(x[:, f] > c), f, c) for f in range(2) for c in range(6))
    (f, b), leaves = model.trees[0][0][0], model.trees[0][1]
    assert f == best[1] and model.cuts[f][b] == best[2]
    left = x[:, f] <= best[2]
    assert np.allclose(leaves[0], g[left].sum(0) / (h[left].sum(0) + 2.0)) and np.allclose(leaves[1], g[~left].sum(0) / (h[~left].sum(0) + 2.0))
    grid = {"still": B.Boost(rounds=0, depth=1), "stump": cfg}
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, y int")
    name, table = B.choose_boost(df.where("a < 5"), df.where("a >= 5"), ["a", "b"], "y", 3, grid)
    assert set(table) == set(grid) and name == min(table, key=table.get) == "stump" and softmax is p


def test_boosting_works_on_combinations_not_rows(spark, monkeypatch):
    """Predictions and trees see each combination of bins once, with the values that rows one by one give; nulls and NaN keep their bins."""
    rng = np.random.default_rng(23)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(rng.integers(0, 6, 3000), rng.integers(0, 4, 3000), rng.integers(0, 3, 3000))]
    odd = [(None, 1.0, 2), (float("nan"), 1.0, 0), (float("inf"), None, 7), (float("-inf"), 0.0, -1), (2.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(4)
    cfg = B.Boost(rounds=3, depth=2, rate=0.5)
    model = B.fit_boost(df, ["a", "b"], "y", 3, cfg)
    seen, real = spark.sparkContext.accumulator(0), B.scores

    def counted(now, bins, rate, depth):
        seen.add(len(bins))
        return real(now, bins, rate, depth)

    monkeypatch.setattr(B, "scores", counted)
    whole = df.unionByName(spark.createDataFrame(odd, df.schema))
    got = B.predict_boost(whole, model, cfg, also={"scored": B.class_scores(F.col("shares"))}).select("a", "b", "y", "shares", B.score_at(F.col("scored"), F.col("y")).alias("s"), B.class_crps(F.col("shares"), F.col("y")).alias("own")).collect()
    assert len(got) == 3005 and seen.value == math.prod(len(c) + 1 for c in model.cuts) <= 35
    monkeypatch.setattr(B, "scores", real)
    place = lambda v, cuts: 0 if v is None else len(cuts) if v != v else sum(c < v for c in cuts)
    for r in got:
        bins = np.array([[place(r["a"], model.cuts[0]), place(r["b"], model.cuts[1])]])
        assert np.allclose(r["shares"], B.softmax(real(model, bins, cfg.rate, cfg.depth))[0], atol=1e-12) and r["s"] == r["own"]
    monkeypatch.setattr(B, "BROADCAST_SHARES", 0)
    again = B.predict_boost(whole, model, cfg).select("a", "b", "y", "shares").collect()
    assert sorted((str(r["a"]), str(r["b"]), r["shares"]) for r in again) == sorted((str(r["a"]), str(r["b"]), r["shares"]) for r in got)

    from pyspark.ml.classification import GBTClassifier

    labelled = df.withColumns({"y": (F.col("y") == 0).cast("double"), "v": F.col("a") == 5})
    sizes, assembled = [], M.assembled
    monkeypatch.setattr(M, "assembled", lambda rows, features: sizes.append(rows.count()) or assembled(rows, features))
    fitted = M.fit_gbt(labelled, ["a", "b"], "y", 5, "v")
    assert sizes == [labelled.select("a", "b", "y", "v").distinct().count()]
    plain = GBTClassifier(featuresCol="features_", labelCol="y", maxIter=5, maxDepth=3, seed=7, validationIndicatorCol="v").fit(assembled(labelled, ["a", "b"]))
    at = labelled.select("a", "b").distinct()
    one, two = ({(r["a"], r["b"]): r["pred"] for r in M.probability(m, at, ["a", "b"]).collect()} for m in (fitted, plain))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_policy_value(spark):
    row = spark.createDataFrame([(1, [0.2, 0.8], [1.0, 3.0], 0.5), (0, [0.01, 0.99], [1.0, 3.0], 0.5), (None, [0.5, 0.5], [1.0, 3.0], 0.5)], "rec int, e array<double>, g array<double>, y double")
    assert [r[0] for r in row.select(M.policy_value(F.col("rec"), F.col("e"), F.col("g"), F.col("y"), 0.05)).collect()] == [2.5, 0.0, 0.0]
    trimmed = spark.range(1).select(M.pseudo_outcomes(F.array(F.lit(0.01), F.lit(0.99)), F.array(F.lit(1.0), F.lit(2.0)), F.lit(0.0), F.lit(3.0), 0.1)).first()[0]
    assert np.allclose(trimmed, [1.0 + 2.0 / 0.1, 2.0])


def test_guards(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    with pytest.raises(ValueError, match="without a match"):
        J.lookup_strict(a, a.where("k = 1"), ["k"], ["v"]).count()
    with pytest.raises(ValueError, match="not unique"):
        J.one_to_one([a, a.union(a)], ["k"])
    with pytest.raises(ValueError, match="not unique"):
        S.scan_dimension(a.union(a), ["k"])
    with pytest.raises(ValueError, match="banned"):
        S.scan_guarded(a, "^v$", wanted=["k", "v"])
    with pytest.raises(ValueError, match="dup"):
        Q.require_empty(Q.duplicates(a.union(a), ["k"]), "dup")
    path = f"file://{tmp_path}/ledger"
    run = lambda n: a.select(F.lit(n).alias("run_at"), "k")
    S.append_run(run(2), path, ["run_at", "k"])
    for bad in (run(2), run(1), run(3).union(run(4)), run(3).drop("k")):
        with pytest.raises(ValueError):
            S.append_run(bad, path, ["run_at", "k"])
    S.append_run(run(3), path, ["run_at", "k"])
    assert spark.read.parquet(path).count() == 4
    nested = spark.createDataFrame([], "a struct<spread:double,b:array<struct<line:int>>>, m map<string,struct<spread_x:int>>")
    assert Q.banned_columns(nested.schema, "spread|line") == ["a.spread", "a.b[].line", "m{}.spread_x"]


def _rated(spark, games, tmp_path, files):
    """The rating stream over games landed in some files, a batch each."""
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in files:
        games.where(F.col("game_id").isin(*rows)).repartition(1).write.mode("append").parquet(path)
    end = [F.lit(None).cast(k).alias(c) for c, k in games.dtypes if c != "kickoff"]
    games.agg((F.max("kickoff") + F.expr("INTERVAL 500 DAYS")).alias("kickoff")).select("kickoff", *end).write.mode("append").parquet(path)
    with L.with_state(spark):
        L.drain(L.rating_state(L.source(spark, path, games.schema, 1), "league", folds.Elo(edge_step=2.0), "kickoff", "300 days"), L.to_folder(out))
    assert spark.conf.get(L.STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(L.STATE_STORE)
    return {r["game_id"]: (r["p_elo"], r["home_post"], r["away_post"]) for r in spark.read.parquet(out).collect()}


def test_rating_stream_in_two_orders(spark, games, tmp_path):
    """Games of a season in two orders of arrival give the ratings of the batch fold."""
    when = games.withColumn("kickoff", F.expr("TIMESTAMP '2000-01-01 12:00:00' + make_interval(0, 0, 0, CAST(2 * game_id AS INT))")).withColumn("season", F.year("kickoff")).where("game_id < 120").drop("week", "y")
    ids = list(range(120))
    rng = random.Random(4)
    mixed = ids.copy()
    rng.shuffle(mixed)
    one = _rated(spark, when, tmp_path / "a", [ids[:60], ids[60:]])
    two = _rated(spark, when, tmp_path / "b", [mixed[k::3] for k in range(3)])
    batch = {r["game_id"]: (r["p_elo"], r["home_post"], r["away_post"]) for r in folds.elo(when.withColumn("y", F.lit(0.0)), ["league"], ["kickoff", "game_id"], {0: folds.Elo(edge_step=2.0)}).collect()}
    assert set(one) == set(two) == set(batch) and one == two
    assert all(np.allclose(one[k], batch[k]) for k in batch)


def test_guarded_sink(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    write = L.guarded(path, ["run", "k"], "run")
    run = lambda n, k: spark.createDataFrame([(n, k), (n, k + 1)], "run int, k int")
    write(run(5, 1), 0)
    write(run(7, 3), 1)
    held = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("run", "k").collect())
    want = held()
    write(run(7, 3), 1)  # the same batch again, after a failure
    write(run(6, 50), 2)  # a run that is too late
    write(run(7, 60), 3)
    assert held() == want == [(5, 1), (5, 2), (7, 3), (7, 4)]
    assert spark.read.parquet(f"{path}-refused").count() == 4
    for bad in (run(9, 1).select("k", "run"), run(9, 1).withColumn("x", F.lit(1)), run(9, 1).drop("k")):
        with pytest.raises(ValueError, match="columns"):
            write(bad, 4)
    write(run(8, 9).unionByName(run(7, 9)).unionByName(spark.createDataFrame([(None, 1)], "run int, k int")), 4)
    assert held() == [*want, (8, 9), (8, 10)]


def test_one_bad_file_is_named(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    for name, p in (("good-a", 0.2), ("bad", 1.7), ("good-b", 0.9)):
        spark.createDataFrame([(1, p), (2, 0.5)], "id long, p double").write.parquet(f"{path}/{name}")
    read = lambda: spark.read.option("recursiveFileLookup", "true").parquet(path)
    rules = {"without id": F.col("id").isNotNull(), "outside 0 to 1": F.col("p").between(0, 1)}
    with pytest.raises(ValueError, match=r"/bad/[^;]*1 of [12] rows outside 0 to 1$"):
        S.scan_validated(read(), rules)
    report = S.file_report(read(), rules).collect()
    assert sum(r["outside 0 to 1"] for r in report) == 1 and sum(r["rows"] for r in report) == 6 and all(r["bytes"] > 0 and r["modified"] for r in report)
    was = S.manifest(spark, path, "files/([^/]*)/").collect()
    assert {r["part"] for r in was} == {"good-a", "bad", "good-b"} and all(r["rows"] == 2 for r in was)
    kept = spark.createDataFrame(was)
    assert S.remove(spark, f"{path}/bad") and not S.remove(spark, f"{path}/bad")
    assert S.scan_validated(read(), rules).count() == 4
    status = {r["part"]: (r["status"], r["rows_was"], r["rows_now"]) for r in S.manifest_diff(kept, S.manifest(spark, path, "files/([^/]*)/")).collect()}
    assert status == {"good-a": ("same", 2, 2), "good-b": ("same", 2, 2), "bad": ("missing", 2, None)}


def test_week_shifts(spark):
    weeks = lambda ends: spark.createDataFrame([(s, w) for s, n in ends.items() for w in range(1, n + 1)], "season int, week int")
    plan = weeks({2000: 17, 2001: 17, 2002: 9})
    got = {r["season"]: r["shift"] for r in S.week_shifts(weeks({2000: 17, 2001: 18, 2002: 17}), plan, "season", "week", 2002).collect()}
    assert got == {2000: 0, 2001: 1, 2002: 0}
    for bad in ({2000: 19, 2001: 17, 2002: 9}, {2000: 16, 2001: 17, 2002: 9}):
        with pytest.raises(ValueError, match="2000 by (2|-1)$"):
            S.week_shifts(weeks(bad), plan, "season", "week", 2002)


def test_walk_logistic_is_a_fit_of_the_past(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 1))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    rows = [(i, 2000 + i % 4, float(x[i, 0]), float(y[i]), 1.0 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, season int, x double, y double, w double").repartition(3)
    got = {r["id"]: r["pred"] for r in M.walk_logistic(df, ["x"], "y", F.col("w"), "season", [2001, 2003]).collect()}
    assert len(got) == 200
    for season in (2001, 2003):
        past = [i for i in range(400) if 2000 + i % 4 < season]
        b = _newton(x[past], y[past], np.array([1.0 + i % 3 for i in past]))
        assert all(math.isclose(got[i], 1 / (1 + math.exp(-b[0] - b[1] * x[i, 0])), rel_tol=1e-6) for i in range(400) if 2000 + i % 4 == season)


def test_ties_and_pairs(games):
    sides = contests.unpivot_sides(games, ["game_id"], mirrored={"points": ("home_score", "away_score")}, flipped={"result": "y"})
    assert sides.count() == 600
    back = contests.pair_sides(sides, ["game_id"], ["points"]).join(games, "game_id")
    assert back.where("NOT (home_team <=> home AND away_points <=> away_score)").count() == 0


class _Held:
    """State of one key in memory, which counts the calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] = self.calls.get(name, 0) + 1
            rows = {"appendList": lambda x: self.rows + list(x), "appendValue": lambda x: [*self.rows, x], "put": list, "update": lambda x: [x], "clear": lambda: []}
            if name in rows:
                self.rows = rows[name](*args)
            return bool(self.rows) if name == "exists" else self.rows

        return call


class _Head(_Held):
    def get(self):
        return self.rows[0]


def test_rating_state_takes_few_calls():
    """A league's batch costs a few calls of state and one timer, however many its games and days."""
    calls, timers, clock = {}, [], [0]
    held = type("H", (), {"getListState": lambda s, *a: _Held(calls), "getMapState": lambda s, *a: _Held(calls), "getValueState": lambda s, *a: _Head(calls), "registerTimer": lambda s, at: timers.append(at)})()
    at = type("T", (), {"getCurrentWatermarkInMs": lambda s: clock[0]})()
    p = L._Ratings(folds.Elo(), "bigint")
    p.init(held)
    day = 86_400_000
    games = pd.DataFrame([(d * day - 1, d, 1, d % 5, (d + 1) % 5, 3.0, float(d % 7), False) for d in range(200, 0, -1)], columns=["ms", "game_id", "season", "home", "away", "home_score", "away_score", "neutral"])
    list(p.handleInputRows((1,), iter([games]), at))
    assert timers == [day] and sum(calls.values()) <= 4
    clock[0] = 150 * day
    assert [g for f in p.handleExpiredTimer((1,), at, None) for g in f["game_id"]] == list(range(1, 151))
    assert timers == [day, 151 * day] and sum(calls.values()) <= 14
    list(p.handleInputRows((1,), iter([games.assign(game_id=games["game_id"] + 1000).query("game_id > 1160")]), at))
    clock[0] = 300 * day
    assert sum(len(f) for f in p.handleExpiredTimer((1,), at, None)) == 90 and timers == [day, 151 * day]


def test_normal_grids_by_slices(spark, monkeypatch):
    """A batch's grids are made a slice at a time, and null inputs stay null."""
    plain = D._normal_grid

    def bounded(m, s, low, high):
        if len(m) > 1024:
            raise ValueError("too many grids at once")
        return plain(m, s, low, high)

    rows = spark.range(5000, numPartitions=1).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("mu"))
    monkeypatch.setattr(D, "_normal_grid", bounded)
    out = rows.select("id", "mu", D.normal_pmf(F.col("mu"), F.lit(2.0), -9, 9).alias("p"), D.on_normal_grid(F.col("mu"), F.lit(2.0), -9, 9, D.above_of).alias("a")).collect()
    want = plain(np.arange(7.0), np.full(7, 2.0), -9, 9)
    assert len(out) == 5000
    for r in out:
        assert (r["p"] is None) == (r["a"] is None) == (r["mu"] is None)
        if r["mu"] is not None:
            assert np.allclose(r["p"], want[r["mu"]], atol=1e-14) and math.isclose(r["a"], D.above_of(want[[r["mu"]]], np.arange(-9, 10))[0])


def test_gram_by_held_sums(spark, monkeypatch):
    """Sums that don't fit are sent on and begun again; keys that repeat in a row, nulls and keys of no weight count as by hand."""
    rng = random.Random(5)
    rows = [(i % 3 if i % 7 else None, [(f"k{rng.randrange(9)}", rng.choice([0.0, 1.0, -2.0, None])) for _ in range(rng.randrange(5))], rng.choice([None, 1.5, 2.0]), 1.0 + i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, terms array<struct<key:string,x:double>>, y double, w double").coalesce(2)
    want: dict = {}
    for g, terms, y, w in rows:
        for k, x in terms:
            want[g, k, None] = want.get((g, k, None), 0.0) + (x or 0.0) * (y or 0.0) * w
            for l, z in terms:
                want[g, k, l] = want.get((g, k, l), 0.0) + (x or 0.0) * (z or 0.0) * w
    for held, size in ((1 << 24, 1 << 16), (50, 20)):
        monkeypatch.setattr(M, "HELD_SUMS", held)
        monkeypatch.setattr(M, "HELD_ROWS", size)
        got = M.gram(df, ["g"], [], "y", "w").collect()
        assert len(got) == len(want) and all(math.isclose(r["s"], want[r["g"], r["i"], r["j"]], abs_tol=1e-9) for r in got)


def test_prediction_has_no_hot_key(spark):
    """A key that all rows have doesn't bring them together: few coefficients are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(50).withColumn("terms", F.array(F.struct(F.lit("mean").alias("key"), F.lit(2.0).alias("x")), F.struct(F.lit("none").alias("key"), F.lit(1.0).alias("x"))))
        coefs = spark.createDataFrame([("mean", 1.5)], "key string, coef double")
        out = M.predict_terms(rows, coefs, ["id"])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert {r["pred"] for r in out.collect()} == {3.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nuisances_read_designs_once(spark, monkeypatch):
    """Models get a row for each fold, action and features, with its weight."""
    sizes, plain = [], M._fit_actions

    def counted(train, *rest):
        sizes.append(train.count())
        return plain(train, *rest)

    monkeypatch.setattr(M, "_fit_actions", counted)
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("fold"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    out = M.action_nuisances(rows, ["id"], "fold", "a", 2, ["x"], "y").collect()
    assert len(out) == 3000 and max(sizes) <= 2 * 2 * 5
    assert all(math.isclose(sum(r["e"]), 1.0, abs_tol=1e-9) for r in out)


def test_with_members(spark):
    """Repeated and null members count, null groups match nothing, a large group takes several tasks."""
    rows = [(i, 1) for i in range(200)] + [(200, 2), (201, 3), (202, None), (203, 1)]
    members = [(1, 10), (1, 10), (1, None), (2, None), (2, None), (4, 5), (None, 6)]
    a, b = spark.createDataFrame(rows, "id long, k int"), spark.createDataFrame(members, "k int, m long")
    out = J.with_members(a, b, ["k"], "m", "id").select("id", "k", "m")
    some = lambda x: [-1 if v is None else v for v in x]
    assert sorted(some(r) for r in out.collect()) == sorted(some((i, k, m)) for i, k in rows for g, m in members if k is not None and k == g)
    assert out.where("k = 1").select(F.spark_partition_id()).distinct().count() > 2
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert J.with_members(x, y, ["k"], "m", "id").count() == 0
