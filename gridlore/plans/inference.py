"""Queries of folds, fitted models, resampling and user-defined functions."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gridlore.functions import distributions as D
from gridlore.functions import scalar as S
from gridlore.operators import aggregates as A
from gridlore.operators import asof, contests, folds, scoring
from gridlore.operators import boosting as B
from gridlore.operators import models as M
from gridlore.operators import resampling as R
from gridlore.operators import windows as X
from gridlore.registry import query
from gridlore.sources.files import scratch, table_key

ORDER = ["season", "week", "kickoff", "game_id"]
FEATURES = ["z", "spread", "site"]


def frame(t):
    """One row for each decided contest with features of it."""
    z = S.logit(F.col("p"))
    return t.games.where("y <> 0.5").select("game_id", "season", "week", "home", "away", "p", "q", "y", "spread", z.alias("z"), S.logit(F.col("q")).alias("zq"), F.when(F.col("neutral"), 0.0).otherwise(1.0).alias("site"), (F.col("home_score") - F.col("away_score")).cast("double").alias("margin"), asof.half_life(1998 - F.col("season"), 4.0).alias("w"))


def sample(t):
    """Plays with numeric features."""
    return t.plays.select("game_id", "play_id", "player", "season", F.col("down").cast("double").alias("down"), F.col("togo").cast("double").alias("togo"), F.col("yardline").cast("double").alias("yardline"), "epa", "success", "is_pass", "kind", "wp")


#: DuckDB forms of the hash, of Poisson(1) and of a multinomial draw.
def sql_uniform(seed: int | str, *key: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), 1, 13) AS BIGINT) / 4503599627370496e0)"


SQL_POISSON = "[" + ", ".join(f"{c!r}e0" for c in R.POISSON_ONE) + "]"


def sql_weights(view: str, key: str, reps: int, seed: int) -> str:
    """CTEs ending in wt(rep, key, w): how often a replicate draws a key."""
    h = f"CAST('0x' || substr(md5(concat_ws('|', 'at{seed}', {key})), 1, 13) AS BIGINT)"
    return f"""kk AS (SELECT DISTINCT {key} FROM {view}), nk AS (SELECT {key}, row_number() OVER (ORDER BY {h} % 1024, {h}, {key}) - 1 AS a FROM kk),
    dr AS (SELECT rep, CAST(floor({sql_uniform(seed, "rep", "a")} * (SELECT count(*) FROM kk)) AS BIGINT) AS a FROM nk, range(0, {reps}) AS q(rep)),
    wt AS (SELECT rep, nk.{key}, count(*) AS w FROM dr JOIN nk USING (a) GROUP BY ALL)"""


def sql_newton(rows: str, by: str, steps: int = 9) -> str:
    """CTEs ending in fit(by..., b0, b1): logistic fits of y on x with weights w, by Newton's steps one after another."""
    out = [f"c0 AS (SELECT DISTINCT {by}, 0e0 AS b0, 0e0 AS b1 FROM {rows})"]
    for k in range(steps):
        out.append(f"""g{k} AS (SELECT {by}, any_value(b0) AS b0, any_value(b1) AS b1, sum(w * (y - m)) AS u0, sum(w * (y - m) * x) AS u1, sum(w * m * (1 - m)) AS h00, sum(w * m * (1 - m) * x) AS h01, sum(w * m * (1 - m) * x * x) AS h11
        FROM (SELECT r.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM {rows} r JOIN c{k} USING ({by})) GROUP BY {by}),
        c{k + 1} AS (SELECT {by}, b0 + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01) AS b1 FROM g{k})""")
    return ", ".join([*out, f"fit AS (SELECT * FROM c{steps})"])


def sql_mean(rows: str, value: str, cluster: str, by: str, reps: int) -> str:
    """The bootstrap of a mean, whole clusters drawn, with its percentile interval."""
    pre, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""s AS (SELECT {pre}{cluster}, sum({value}) AS s, count({value}) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, len(list_filter({SQL_POISSON}, lambda c: c <= {sql_uniform(7, "rep", cluster)})) AS w FROM s, range(0, {reps}) AS q(rep)),
    d AS (SELECT {pre}rep, sum(w * s) / nullif(sum(w * n), 0) AS m FROM w WHERE w > 0 GROUP BY {pre}rep),
    p AS (SELECT {pre}CAST(sum(n) AS BIGINT) AS n, sum(s) / sum(n) AS mean FROM s {group}),
    b AS (SELECT {pre}quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, stddev_samp(m) AS se FROM d {group}) SELECT * FROM p JOIN b {on}"""


@query("fold_elo")
def fold_elo(t):
    return folds.elo(t.league_games, ["league"], ORDER)


@query("fold_elo_state")
def fold_elo_state(t):
    return folds.elo_state(folds.elo(t.league_games, ["league"], ORDER), ["league"], folds.Elo())


@query("fold_elo_grid")
def fold_elo_grid(t):
    values = itertools.product((8.0, 12.0, 16.0, 20.0, 24.0, 28.0, 32.0, 40.0), (0.0, 20.0, 35.0, 45.0, 55.0, 65.0, 80.0, 100.0), (0.0, 0.1, 0.2, 0.33, 0.5, 0.75), (1300.0, 1400.0, 1500.0, 1550.0), (False, True))
    grid = {i: folds.Elo(k=k, edge=e, regress=g, newcomer=n, absolute=a) for i, (k, e, g, n, a) in enumerate(values)}
    return folds.elo_grid(t.league_games, ["league"], ORDER, grid, (1994, 1997))


#: Settings of the filter with both measurements, and of a learned edge.
LEVELS = folds.Kalman(edge_var=4.0, edge_drift=0.01, second_var=90.0, rho=0.3, scale=12.0, second_edge=0.05)


def measured(t):
    """League games with the difference in mean value between the odd plays, the home side's, and the even ones; null if one side has none."""
    side = lambda k: F.avg(F.when(F.col("play_id") % 2 == k, F.col("epa")))
    return t.league_games.join(t.plays.groupBy("game_id").agg((side(1) - side(0)).alias("second")), "game_id", "left")


@query("fold_kalman")
def fold_kalman(t):
    return folds.kalman(measured(t), ["league"], {0: LEVELS}, "second")


@query("fold_kalman_at")
def fold_kalman_at(t):
    cut = F.lit("1997-01-01").cast("timestamp")
    hidden = measured(t).withColumns({c: F.when(F.col("kickoff") < cut, F.col(c)) for c in ("home_score", "away_score")})
    return folds.kalman(hidden, ["league"], {0: LEVELS}, "second").where("margin IS NULL").select("league", "game_id", "mean", "sd")


@query("fold_kalman_loglik")
def fold_kalman_loglik(t):
    values = list(itertools.product((0.3, 0.5, 0.7, 0.9), (6.0, 12.0), (-0.3, 0.0, 0.3), (0.1, 1.0)))
    grid = {i: replace(LEVELS, carry=c, season_var=v, rho=r, week_var=w) for i, (c, v, r, w) in enumerate(values)}
    found = folds.kalman_profile(measured(t), ["league"], grid, (1996, 2001), "second")
    names = t.spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "config int, carry double, season_var double, rho double, week_var double")
    return found.join(F.broadcast(names), "config")


def term(name, value=1.0, *parts):
    """One (key, x) of a row: the key is the name and the parts after "|"."""
    key = F.concat_ws("|", F.lit(name), *[F.col(c).cast("string") for c in parts]) if parts else F.lit(f"{name}|")
    return F.struct(key.alias("key"), (F.lit(value) if isinstance(value, float) else value).cast("double").alias("x"))


def rating_terms(t):
    """Mean value by game and sides, with a term for who is at home: 1 the offence, -1 the defence, 0 neither."""
    rows = t.plays.groupBy("game_id", "season", "off", "def").agg(F.avg("epa").alias("y"), F.count("*").cast("double").alias("w"))
    site = F.when(F.col("neutral"), 0).when(F.col("off") == F.col("home"), 1).when(F.col("def") == F.col("home"), -1).otherwise(0)
    rows = rows.join(t.games.select("game_id", "home", "neutral"), "game_id").withColumn("site", site).drop("home", "neutral")
    return rows.withColumn("terms", F.array(term("mean"), term("home", F.col("site")), term("off", 1.0, "off"), term("def", 1.0, "def")))


def last_of(df, column):
    """The greatest value of a period column."""
    return int(df.agg(F.max(column)).first()[0] or 0)


@query("fit_ridge_ratings")
def fit_ridge_ratings(t):
    """Offence, defence and home ratings as of each week up to the one after the last season, from the rows of earlier weeks, halved every eight weeks."""
    rows = rating_terms(t).join(t.games.select("game_id", "week"), "game_id").withColumn("period", F.col("season") * 53 + F.col("week"))
    rows = R.spread(rows, "period", "terms").groupBy("period", "terms").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), F.sum("w").alias("w")).withColumn("game_id", F.lit(0))  # rows of one design are one row
    asof_week = M.decayed_gram(M.gram(rows, ["period"], ["game_id"], "y", "w"), "period", 0.5 ** (1 / 8), last_of(t.plays, "season") * 53 + 54)
    solved = M.solve_ridge(asof_week, ["period"], {"mean": 1e-6, "home": 1e-6}, 50.0)
    return solved.select(F.floor((F.col("period") - 1) / 53).cast("int").alias("season"), (F.pmod(F.col("period") - 1, F.lit(53)) + 1).cast("int").alias("week"), "key", "coef", "weight")


@query("score_ratings")
def score_ratings(t):
    rows = rating_terms(t)
    coefs = M.solve_ridge(M.gram(rows, ["season"], ["game_id"], "y", "w"), ["season"], {"mean": 1e-6}, 50.0).withColumn("season", F.col("season") + 1)
    both = M.predict_terms(rows.where("season >= 1994"), coefs, ["game_id", "season", "off", "def", "y"], ["season"])
    return both.groupBy("season").agg(F.avg(F.pow(F.col("y") - F.col("pred"), 2)).alias("mse"), F.try_divide(F.covar_samp("y", "pred"), F.stddev_samp("y") * F.stddev_samp("pred")).alias("c"))


def priors_of(t, side, player, scale, strength, per):
    """(season, key, prior, penalty): a member's decayed earlier mean, scaled, as prior; its penalty grows with the evidence, by the group's strength."""
    v = asof.decayed_values(t.plays.withColumns({"one": F.lit(1.0), "player": player}), ["player"], "season", "epa", "one", 2.0, 0.0, 20.0)
    group = F.coalesce(F.substring("grp", -1, 1).cast("double"), F.lit(3.0))
    v = v.join(t.players.select("player", "grp"), "player", "left")
    return v.select("season", F.concat(F.lit(f"{side}|"), F.col("player").cast("string")).alias("key"), (scale * F.col("value")).alias("prior"), ((strength + 5 * group) * (1 + F.col("weight") * per)).alias("penalty"))


@query("fit_qb_joint_ridge")
def fit_qb_joint_ridge(t):
    """Passers and their opponents of each season together, season-ahead: earlier means as priors, rows of one play count half."""
    rows = t.plays.where("is_pass = 1").groupBy("passer", "def", "season").agg(F.avg("epa").alias("y"), F.count("*").cast("double").alias("n"))
    rows = rows.withColumn("w", F.col("n") * F.when(F.col("n") < 2, 0.5).otherwise(1.0)).withColumn("terms", F.array(term("mean"), term("qb", 1.0, "passer"), term("opp", 1.0, "def", "season")))
    ahead = M.decayed_gram(M.gram(rows, ["season"], ["passer"], "y", "w"), "season", 0.7, last_of(t.plays, "season"))
    return M.solve_ridge(ahead, ["season"], {"mean": 1e-6, "opp": 60.0}, 30.0, priors_of(t, "qb", F.col("passer"), 1.0, 25.0, 0.0))


@query("build_entity_delta_variants")
def build_entity_delta_variants(t):
    out = t.games.select("game_id", "season", "home", "away")
    for name, life in (("slow", 3.0), ("fast", 1.0)):
        v = asof.decayed_values(t.plays.withColumn("one", F.lit(1.0)), ["off"], "season", "epa", "one", life, 0.0, 50.0)
        out = contests.side_difference(out, v.select("season", F.col("off").alias("team"), "value"), ["season"], "value", f"delta_{name}", default=0.0)
    return out.select("game_id", "delta_slow", "delta_fast")


def defender():
    return F.pmod(F.col("player") * 7 + F.col("passer"), F.lit(400))


def member_terms(t):
    """Mean value by game and sides, with members of both sides and what the situation was."""
    rows = t.plays.groupBy("game_id", "season", "off", "def").agg(F.avg("epa").alias("y"), F.count("*").cast("double").alias("w"), F.collect_set("player").alias("offs"), F.collect_set(defender()).alias("defs"), F.avg("is_pass").alias("passes"), (F.avg("yardline") / 100).alias("far"))
    side = lambda name, column: F.transform(column, lambda m: F.struct(F.concat(F.lit(f"{name}|"), m.cast("string")).alias("key"), F.lit(1.0).alias("x")))
    return rows.withColumn("terms", F.concat(F.array(term("mean"), term("z|pass", F.col("passes")), term("z|far", F.col("far"))), side("off", "offs"), side("def", "defs"))).drop("offs", "defs")


@query("fit_with_without")
def fit_with_without(t):
    """Shares of the plays of a game and side, season-ahead; members are shrunk to their earlier means, harder the more of them is known."""
    per = t.plays.groupBy("game_id", "season", "off", "player").agg(F.sum("epa").alias("s"), F.count("*").cast("double").alias("n"))
    rows = per.groupBy("game_id", "season", "off").agg((F.sum("s") / F.sum("n")).alias("y"), F.sum("n").alias("w"), F.collect_list(F.struct("player", "n")).alias("members"))
    rows = rows.withColumn("terms", F.concat(F.array(term("mean")), F.transform("members", lambda m: F.struct(F.concat(F.lit("m|"), m["player"].cast("string")).alias("key"), (m["n"] / F.col("w")).alias("x")))))
    ahead = M.decayed_gram(M.gram(rows, ["season"], ["game_id"], "y", "w"), "season", 0.6, last_of(t.plays, "season"))
    return M.solve_ridge(ahead, ["season"], {"mean": 1e-6}, 40.0, priors_of(t, "m", F.col("player"), 1.0, 20.0, 0.05))


def plus_minus(t):
    """Season-ahead ratings of the members of both sides: statistics of earlier seasons halve each year, priors and strengths by group."""
    rows = member_terms(t)
    ahead = M.decayed_gram(M.gram(rows, ["season"], ["game_id"], "y", "w"), "season", 0.5, last_of(t.plays, "season"))
    priors = priors_of(t, "off", F.col("player"), 0.5, 60.0, 0.0).unionByName(priors_of(t, "def", defender(), 0.25, 80.0, 0.0))
    return rows, M.solve_ridge(ahead, ["season"], {"mean": 1e-6, "z": 1e-6}, 100.0, priors)


@query("fit_rapm")
def fit_rapm(t):
    return plus_minus(t)[1]


@query("predict_rapm")
def predict_rapm(t):
    """Predicted value of each game and side from the ratings before its season: members, those unseen at their prior, and the situation."""
    rows, coefs = plus_minus(t)
    seasons = coefs.select("season").distinct()
    return M.predict_terms(rows.join(F.broadcast(seasons), "season"), coefs, ["game_id", "season", "off", "def"], ["season"])


#: Seasons that have seasons before them.
SEASONS = list(range(1996, 2002))


def logistic_walk(t, features=FEATURES, y="y"):
    return M.walk_logistic(frame(t), features, y, F.col("w"), "season", SEASONS)


@query("fit_logistic_walk")
def fit_logistic_walk(t):
    return logistic_walk(t).select("game_id", "season", "y", "pred")


@query("fit_margin_walk")
def fit_margin_walk(t):
    def fit(train):
        m = M.fit_linear(train, FEATURES, "margin", "w")
        return m, M.residual_sd(M.mean_of(m, train, FEATURES), "margin", "pred", len(FEATURES) + 1, "w")

    return M.walk_forward(frame(t), "season", SEASONS, fit, lambda m, test: M.mean_of(m[0], test, FEATURES).withColumn("sd", F.lit(m[1]))).select("game_id", "season", "margin", "pred", "sd")


@query("fit_margin_target")
def fit_margin_target(t):
    def fit(train):
        m = M.fit_linear(train, FEATURES, "margin", "w")
        return m, M.fit_logistic(M.mean_of(m, train, FEATURES, "mu"), ["mu"], "y", "w")

    return M.walk_forward(frame(t), "season", SEASONS, fit, lambda m, test: M.probability(m[1], M.mean_of(m[0], test, FEATURES, "mu"), ["mu"])).select("game_id", "season", "mu", "pred")


@query("fit_key_numbers")
def fit_key_numbers(t):
    rows = frame(t).withColumn("pmf", D.normal_pmf(F.col("spread"), F.lit(13.0), -40, 40))
    found = M.key_number_factors(rows, "margin", "pmf", -40, 14, rounds=3)
    seen = rows.groupBy(F.abs("margin").cast("int").alias("k")).agg(F.count("*").alias("n")).where("k <= 14")
    return seen.withColumn("factor", F.get(F.array(*[F.lit(x) for x in found]), F.col("k")))


@query("fit_stack")
def fit_stack(t):
    f, bases = frame(t), ["z", "zq"]
    found = M.fit_stack(f.where("season < 1997"), bases, "y", 0.001)
    return f.where("season >= 1997").select("game_id", M.stacked(bases, found).alias("pred"))


@query("fit_gbm_binary")
def fit_gbm_binary(t):
    """Boosted trees stopped early by the last season before the test."""
    f = frame(t).withColumn("valid", F.col("season") == 1999)
    m = M.fit_gbt(f.where("season < 2000"), FEATURES, "y", 30, "valid")
    return M.probability(m, f.where("season >= 2000"), FEATURES).select("game_id", "y", "pred")


#: Settings of the boosting that the last season before the test chooses among.
BOOSTS = {"slow": B.Boost(rounds=4, depth=2, rate=0.2, penalty=5.0), "fast": B.Boost(rounds=4, depth=2, rate=0.6, penalty=5.0)}


@query("fit_gbm_bins")
def fit_gbm_bins(t):
    """Shares of 53 classes of gain, and the chance of a turnover beside them."""
    rows = t.plays.select("game_id", "play_id", "player", "season", F.col("down").cast("double").alias("down"), F.col("togo").cast("double").alias("togo"), F.col("yardline").cast("double").alias("yardline"), (F.least(F.greatest(F.col("yards"), F.lit(-12)), F.lit(40)) + 12).cast("int").alias("bin"), (F.col("status") == "F").cast("double").alias("lost"))
    x, past, last, test = ["down", "togo", "yardline"], rows.where("season < 1999"), rows.where("season = 1999"), rows.where("season >= 2000")
    best, _ = B.choose_boost(past, last, x, "bin", 53, BOOSTS)
    train = rows.where("season < 2000")
    model = B.fit_boost(train, x, "bin", 53, BOOSTS[best])
    turnover = M.fit_gbt(train.withColumn("valid", F.col("season") == 1999), x, "lost", 10, "valid")
    expected = F.aggregate(F.transform("shares", lambda p, i: p * (i - 12)), F.lit(0.0), lambda a, v: a + v)
    also = {"expected": expected, "top": F.array_max("shares"), "bins": F.size("shares"), "scores": B.class_scores(F.col("shares"))}
    shared = B.predict_boost(M.probability(turnover, test, x, "turnover"), model, BOOSTS[best], also=also)
    return shared.select("game_id", "play_id", "player", "turnover", "expected", "top", "bins", B.score_at(F.col("scores"), F.col("bin")).alias("crps"))


ISOTONIC = """WITH d AS (SELECT * FROM games WHERE y <> 5e-1), t AS (SELECT p, sum(y) AS s, count(*) AS n FROM d WHERE season < 1997 GROUP BY p),
r AS (SELECT row_number() OVER w AS i, p, s, n, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM t WINDOW w AS (ORDER BY p)),
v AS (SELECT a.i AS a, b.i AS i, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS v FROM r a JOIN r b ON b.i >= a.i),
f AS (SELECT i, max(v) AS f FROM v GROUP BY i), k AS (SELECT sum(p * n) / sum(n) AS x, round(f, 12) AS f FROM f JOIN r USING (i) GROUP BY round(f, 12)),
e AS (SELECT x, f FROM k UNION ALL SELECT 0e0, least(0e0, min(f)) FROM k UNION ALL SELECT 1e0, greatest(1e0, max(f)) FROM k),
z AS (SELECT x AS x0, f AS f0, lead(x) OVER (ORDER BY x, f) AS x1, lead(f) OVER (ORDER BY x, f) AS f1 FROM e)
SELECT game_id, least(greatest(f0 + (p - x0) / (x1 - x0) * (f1 - f0), 1e-6), 1 - 1e-6) AS pred FROM d JOIN z ON p >= x0 AND p < x1 WHERE season >= 1997"""


@query("fit_isotonic", ISOTONIC, "pred")
def fit_isotonic(t):
    f = frame(t)
    knots = M.fit_isotonic(f.where("season < 1997"), "p", "y")
    return f.where("season >= 1997").select("game_id", M.interpolated(F.col("p"), knots).alias("pred"))


@query("fit_fg_logit")
def fit_fg_logit(t):
    """Kicks by distance with two hinges and the kicker's earlier rate; how hard rates are shrunk is chosen for each season by the loss of the seasons before it."""
    k = t.plays.where("down = 4").select("game_id", "play_id", "player", "season", F.col("yardline").cast("double").alias("dist"), "success")
    rows = k.withColumns({"near": F.greatest(F.col("dist") - 35, F.lit(0.0)), "far": F.greatest(F.col("dist") - 55, F.lit(0.0)), "w": asof.half_life(2002 - F.col("season"), 3.0), "one": F.lit(1.0)})
    walked = None
    for strength in (5.0, 20.0, 80.0):
        v = asof.decayed_values(rows, ["player"], "season", "success", "one", 2.0, 0.5, strength).select("player", "season", "value")
        part = M.walk_logistic(rows.join(v, ["player", "season"]), ["dist", "near", "far", "value"], "success", F.col("w"), "season", SEASONS).withColumn("strength", F.lit(strength))
        walked = part if walked is None else walked.unionByName(part)
    loss = walked.groupBy("season", "strength").agg(F.sum(scoring.METRICS["logloss"]("success", "pred")).alias("l"), F.count("*").alias("n"))
    seasons = loss.select(F.col("season").alias("now")).distinct()
    past = seasons.join(loss, F.col("season") < F.col("now"), "left").groupBy("now", "strength").agg((F.sum("l") / F.sum("n")).alias("mean"))
    best = past.groupBy("now").agg(F.coalesce(F.min_by("strength", F.struct("mean", "strength")), F.lit(20.0)).alias("best"))
    return walked.join(F.broadcast(best), (F.col("season") == F.col("now")) & (F.col("strength") == F.col("best"))).select("game_id", "play_id", "player", "season", "strength", "pred")


@query("fit_punt_classes")
def fit_punt_classes(t):
    rows = sample(t).where("down = 3").withColumn("c", A.bucket(F.col("epa"), [-0.3, 0.3]).cast("double"))
    x = ["togo", "yardline"]
    m = M.fit_classes(rows.where("season < 1997"), x, "c", 10)
    return M.class_shares(m, rows.where("season >= 1997"), x).select("game_id", "play_id", "player", F.expr("aggregate(transform(shares, (s, i) -> s * i), 0D, (a, x) -> a + x)").alias("expected"))


@query("fit_offset_cells")
def fit_offset_cells(t):
    return M.offset_cells(sample(t).withColumn("zone", A.bucket(F.col("yardline"), [20, 60])), ["down", "zone"], "success", "wp", 0.5, 5)


@query("fit_component_set")
def fit_component_set(t):
    """Four models for each later season, from the seasons before it: kept under their version, read back and applied."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import LinearRegressionModel

    x, rows, out = ["down", "togo", "yardline"], sample(t), None
    for season in SEASONS[1:]:
        past = rows.where(F.col("season") < season)
        fitted = {"convert": M.fit_logistic(past, x[1:], "success"), "passes": M.fit_logistic(past, x, "is_pass"), "value": M.fit_linear(past, x, "epa"), "wins": M.fit_linear(past, x[1:], "wp")}
        version = table_key(past.select("game_id", "play_id", "player", "epa"), season, [round(float(c), 9) for m in fitted.values() for c in m.coefficients])
        path = scratch(t.spark, f"components-{version}")
        for name, m in fitted.items():
            m.write().overwrite().save(f"{path}/{name}")
        part = rows.where(F.col("season") == season)
        for name, m in fitted.items():
            own = x if name in ("passes", "value") else x[1:]
            again = (LogisticRegressionModel if name in ("convert", "passes") else LinearRegressionModel).load(f"{path}/{name}")
            part = M.probability(again, part, own, name) if name in ("convert", "passes") else M.mean_of(again, part, own, name)
        part = part.select("season", "game_id", "play_id", "player", *fitted, F.length(F.lit(version)).alias("version_length"))
        out = part if out is None else out.unionByName(part)
    return out


@query("fit_team_box_baselines")
def fit_team_box_baselines(t):
    rows = sample(t).groupBy("game_id", "season").agg(F.avg("epa").alias("y"), F.avg("wp").alias("box"), F.count("*").cast("double").alias("w"))
    m = M.fit_linear(rows.where("season < 1997"), ["box"], "y", "w")
    base = rows.where("season < 1997").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("intercept"))
    return M.mean_of(m, rows.where("season >= 1997"), ["box"], "pred").join(F.broadcast(base)).select("game_id", "pred", "intercept")


#: Actions of a play: the kinds A, N and R, in this order.
KINDS = ("A", "N", "R")


def nuisance(t):
    """Plays of the first two downs with propensities and means of three actions: cross-fitted by season up to 1999, later seasons by models of those."""
    action = sum((F.when(F.col("kind") == k, float(i)).otherwise(0.0) for i, k in enumerate(KINDS)), F.lit(0.0))
    rows = sample(t).where("down <= 2").withColumns({"action": action, "cell": A.bucket(F.col("togo"), [4, 8, 15])}).select("game_id", "play_id", "player", "season", "togo", "yardline", "epa", "action", "cell")
    return M.action_nuisances(rows.where("season < 2000"), ["game_id", "play_id", "player"], "season", "action", len(KINDS), ["togo", "yardline"], "epa", rows.where("season >= 2000"))


@query("fit_nuisance_crossfit")
def fit_nuisance_crossfit(t):
    return nuisance(t).select("game_id", "play_id", "player", *[F.col("e")[i].alias(f"e{i}") for i in range(3)], *[F.col("mu")[i].alias(f"mu{i}") for i in range(3)])


def doubly_robust(t, floor=1e-6):
    return nuisance(t).withColumn("g", M.pseudo_outcomes(F.col("e"), F.col("mu"), F.col("action"), F.col("epa"), floor))


@query("aipw_pseudo")
def aipw_pseudo(t):
    """Mean doubly robust value of each action by cell, plain and with propensities of a tenth at least, and the value of the observed policy."""
    g = doubly_robust(t).withColumn("trimmed", M.pseudo_outcomes(F.col("e"), F.col("mu"), F.col("action"), F.col("epa"), 0.1))
    observed = F.aggregate(F.zip_with("e", "g", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    means = [F.avg(F.col(c)[i]).alias(f"{n}{i}") for c, n in (("g", "v"), ("trimmed", "trim")) for i in range(3)]
    return g.where("season < 2000").groupBy("cell").agg(*means, F.avg(observed).alias("observed"), F.avg("epa").alias("mean"), F.count("*").alias("n"))


@query("policy_apply_ope")
def policy_apply_ope(t):
    """The action that is clearly best in a cell of the earlier seasons, applied to later ones where it is common enough, and what it gains."""
    v = doubly_robust(t)
    long = v.where("season < 2000").select("cell", F.posexplode(F.transform("g", lambda x: x - F.col("epa"))).alias("a", "gain"))
    cells = long.groupBy("cell", "a").agg(F.avg("gain").alias("gain"), (F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("se"))
    rec = cells.groupBy("cell").agg(F.max_by(F.struct("a", "gain", "se"), F.struct("gain", -F.col("a"))).alias("b")).where("b.gain > 1.645 * b.se").select("cell", F.col("b.a").alias("rec"))
    test = v.where("season >= 2000").join(F.broadcast(rec), "cell", "left")
    gain = M.policy_value(F.col("rec"), F.col("e"), F.col("g"), F.col("epa"), 0.05)
    return test.groupBy("season").agg(F.count("*").alias("n"), F.avg(gain).alias("gain"), F.avg((F.col("rec").isNotNull() & (F.col("rec") != F.col("action"))).cast("double")).alias("changed"))


@query("placebo_shuffle", "SELECT season, down, sum(is_pass) AS passes, count(*) AS n FROM plays GROUP BY ALL", "passes")
def placebo_shuffle(t):
    return R.shuffled_within(t.plays, ["season", "down"], "is_pass", ["game_id", "play_id", "player"], 5, "placebo").groupBy("season", "down").agg(F.sum("placebo").alias("passes"), F.count("*").alias("n"))


OUTCOMES = [(-5, 0.2), (0, 0.3), (5, 0.3), (15, 0.2)]


def option_rows(t):
    d = t.plays.where("down = 4").select("game_id", "play_id", "player", "yardline", "togo")
    go = F.array(*[F.struct(F.lit("go").alias("option"), F.lit(w).alias("w"), F.greatest(F.col("yardline") - y, F.lit(0)).alias("to")) for y, w in OUTCOMES])
    kick = F.array(F.struct(F.lit("kick").alias("option"), F.lit(1.0).alias("w"), F.col("yardline").alias("to")))
    return d.select("*", F.explode(F.concat(go, kick)).alias("o")).select("game_id", "play_id", "player", "yardline", "o.*")


@query("option_values", """WITH d AS (SELECT game_id, play_id, player, yardline FROM plays WHERE down = 4), o AS (SELECT *, unnest([-5, 0, 5, 15]) AS y, unnest([0.2e0, 0.3e0, 0.3e0, 0.2e0]) AS w FROM d)
SELECT game_id, play_id, player, sum(w * (6 - greatest(yardline - y, 0) / 20e0)) AS go, max(2.5e0 - yardline / 50e0) AS kick FROM o GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY game_id, play_id, player, yardline"), "go kick")
def option_values(t):
    value = F.when(F.col("option") == "go", 6 - F.col("to") / 20).otherwise(2.5 - F.col("to") / 50)
    rows = option_rows(t).withColumn("v", F.col("w") * value)
    return rows.groupBy("game_id", "play_id", "player", "yardline").agg(F.sum(F.when(F.col("option") == "go", F.col("v"))).alias("go"), F.max(F.when(F.col("option") == "kick", F.col("v"))).alias("kick")).drop("yardline")


@query("structure_samples", "SELECT kind, down, player, game_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, down ORDER BY md5(game_id || '|' || play_id || '|' || player), game_id) AS k FROM plays) WHERE k <= 5")
def structure_samples(t):
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("game_id", "play_id", "player")]))
    return X.top_per_group(t.plays.withColumn("h", h), ["kind", "down"], ["h", "game_id"], 5).select("kind", "down", "player", "game_id")


#: What a decision is worth: going for it counts its chance of success, from a model of the distance.
GO = ("12 * m - 4 - yardline / 25e0", "5e-1 - yardline / 50e0 + 1e-1 * togo")


@query("value_decisions", f"""WITH f AS MATERIALIZED (SELECT row_number() OVER () AS i, game_id, play_id, player, is_pass, success AS y, CAST(togo AS DOUBLE) AS x, togo, yardline FROM plays WHERE down = 4),
{sql_weights("f", "game_id", 20, 31)}, w0 AS (SELECT -1 AS rep, game_id, 1 AS w FROM kk UNION ALL SELECT * FROM wt), rw AS (SELECT f.*, rep, w FROM f JOIN w0 USING (game_id)), {sql_newton("rw", "rep")},
v AS (SELECT f.*, rep, {GO[0]} AS go, {GO[1]} AS kick FROM (SELECT f.*, rep, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM f, fit) f),
z AS (SELECT * FROM v WHERE rep = -1),
d AS (SELECT i, CASE WHEN z.go >= z.kick THEN v.go - v.kick ELSE v.kick - v.go END AS d FROM z JOIN v USING (i) WHERE v.rep >= 0),
q AS (SELECT i, quantile_cont(d, 0.05) AS band_low, quantile_cont(d, 0.95) AS band_high FROM d GROUP BY i)
SELECT game_id, play_id, player, CASE WHEN go >= kick THEN 'go' ELSE 'kick' END AS best, abs(go - kick) AS margin, band_low, band_high, band_low <= 0 AND band_high >= 0 AS tossup,
greatest(go, kick) - CASE WHEN is_pass = 1 THEN go ELSE kick END AS lost, (go >= kick) = (is_pass = 1) AS matched FROM z JOIN q USING (i)""", "margin band_low band_high lost")
def value_decisions(t):
    """The better option of each decision, what the choice cost, and a 90 % band of the difference from refits under drawn games."""
    f = t.plays.where("down = 4").select("game_id", "play_id", "player", "is_pass", "success", "togo", "yardline")
    drawn = R.with_weights(f, ["game_id"], 20, 31).withColumn("weights", F.concat(F.array(F.lit(1)), "weights"))
    fits = R.refit_logistic(drawn, ["togo"], "success", "weights").groupBy().agg(F.array_sort(F.collect_list(F.struct("rep", "coefs"))).alias("fits"))
    chance = F.transform("fits", lambda c: 1 / (1 + F.exp(-(c["coefs"][0] + c["coefs"][1] * F.col("togo")))))
    values = f.crossJoin(F.broadcast(fits)).withColumns({"go": F.transform(chance, lambda m: 12 * m - 4 - F.col("yardline") / 25), "kick": F.transform("fits", lambda c: 0.5 - F.col("yardline") / 50 + 0.1 * F.col("togo"))})
    went, go, kick = F.col("is_pass") == 1, F.col("go")[0], F.col("kick")[0]
    values = values.withColumns({"lost": F.greatest(go, kick) - F.when(went, go).otherwise(kick), "matched": (go >= kick) == went})
    return R.option_bands(values, ["game_id", "play_id", "player", "lost", "matched"], ["go", "kick"]).drop("second")


@query("feature_prep")
def feature_prep(t):
    f = t.games.select("game_id", "season", "p", "m")
    return M.prepared(f.where("season < 1996"), f, ["p", "m"]).select("game_id", "p_z", "m_z", "m_missing")


@query("season_model_freeze")
def season_model_freeze(t):
    from pyspark.ml.classification import LogisticRegressionModel

    f = frame(t)
    path = scratch(t.spark, "model")
    m = M.fit_logistic(f.where("season < 1997"), FEATURES, "y", "w")
    m.write().overwrite().save(path)
    again = LogisticRegressionModel.load(path)
    version = table_key(f.select("game_id", "y"), [round(float(x), 9) for x in again.coefficients])
    both = M.probability(again, M.probability(m, f.where("season >= 1997"), FEATURES, "a"), FEATURES, "b")
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("gap")).withColumn("version_length", F.length(F.lit(version)))


def losses(t):
    return t.games.withColumn("d", scoring.brier("y", "p") - scoring.brier("y", "q"))


LOSSES = "l AS (SELECT *, pow(p - y, 2) - pow(q - y, 2) AS d FROM games)"


@query("boot_paired", f"WITH {LOSSES}, {sql_mean('l', 'd', 'game_id', '', 100)}", "mean low high se")
def boot_paired(t):
    return R.bootstrap_mean(losses(t), "d", ["game_id"], reps=100)


@query("boot_cluster", f"WITH {LOSSES}, {sql_mean('l', 'd', 'season, week', 'game_type', 100)}", "mean low high se")
def boot_cluster(t):
    return R.bootstrap_mean(losses(t), "d", ["season", "week"], ["game_type"], reps=100)


@query("boot_cells", f"WITH {sql_mean('plays', 'epa', 'off, season', 'down, kind', 50)}", "mean low high se")
def boot_cells(t):
    return R.bootstrap_mean(t.plays, "epa", ["off", "season"], ["down", "kind"], reps=50)


REFIT_ROWS = "rw AS (SELECT rep, w, spread AS x, y FROM games g JOIN wt USING (game_id))"


@query("boot_weights", f"WITH {sql_weights('games', 'game_id', 20, 3)}, {REFIT_ROWS}, {sql_newton('rw', 'rep')} SELECT CAST(rep AS INTEGER) AS rep, CAST(sum(w) AS BIGINT) AS total, count(*) AS games, CAST(max(w) AS INTEGER) AS most, any_value(b0) AS intercept, any_value(b1) AS slope FROM wt JOIN fit USING (rep) GROUP BY rep", "intercept slope")
def boot_weights(t):
    """A logistic model of the outcome refitted under 20 multinomial draws of the games."""
    games = t.games.select("game_id", "spread", "y")
    weights = R.multinomial_weights(games, ["game_id"], 20, 3)
    rows = R.attach_weights(games, ["game_id"], weights)
    fits = R.refit_logistic(rows, ["spread"], "y", "weights").select("rep", F.col("coefs")[0].alias("intercept"), F.col("coefs")[1].alias("slope"))
    told = weights.select(F.posexplode("weights").alias("rep", "w")).where("w > 0").groupBy("rep").agg(F.sum("w").alias("total"), F.count("*").alias("games"), F.max("w").alias("most"))
    return told.join(F.broadcast(fits), "rep")


def null_draws(t):
    return R.null_ece(t.games, "p", ["game_id"], reps=50)


NULL_ECE = f"""u AS (SELECT rep, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, p, CASE WHEN {sql_uniform(11, "rep", "game_id")} < p THEN 1e0 ELSE 0e0 END AS v FROM games, range(0, 50) AS q(rep)),
    k AS (SELECT rep, bin, count(*) AS n, avg(p) AS mp, avg(v) AS mv FROM u GROUP BY rep, bin), e AS (SELECT rep, sum(n * abs(mv - mp)) / sum(n) AS ece FROM k GROUP BY rep)"""


@query("null_ece", f"WITH {NULL_ECE} SELECT quantile_cont(ece, 0.05) AS low, quantile_cont(ece, 0.5) AS mid, quantile_cont(ece, 0.95) AS high FROM e", "low mid high")
def null_ece(t):
    return null_draws(t).agg(F.percentile("ece", F.lit(0.05)).alias("low"), F.percentile("ece", F.lit(0.5)).alias("mid"), F.percentile("ece", F.lit(0.95)).alias("high"))


@query("calibration_rule", f"""WITH {NULL_ECE}, h AS (SELECT quantile_cont(ece, 0.95) AS high FROM e), b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM games GROUP BY 1),
o AS (SELECT sum(n * abs(my - mp)) / sum(n) AS ece FROM b) SELECT ece, high, ece <= high OR ece <= 0.01e0 AS passes FROM o, h""", "ece high")
def calibration_rule(t):
    high = null_draws(t).agg(F.percentile("ece", F.lit(0.95)).alias("high"))
    own = scoring.ece(scoring.reliability(t.games.withColumn("bin", scoring.uniform_bin(F.col("p"), 10)), "y", "p"))
    return own.join(F.broadcast(high)).withColumn("passes", (F.col("ece") <= F.col("high")) | (F.col("ece") <= 0.01))


def tau_scores(t):
    g = t.games.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    p = (1 - F.col("tau")) * F.col("p") + F.col("tau") * 0.5
    return g.withColumn("l", F.pow(p - F.col("y"), 2)).groupBy("tau").agg(F.avg("l").alias("mean"), (F.stddev_samp("l") / F.sqrt(F.count("*"))).alias("se"))


TAU = "WITH s AS (SELECT tau, avg(pow((1 - tau) * p + tau * 0.5e0 - y, 2)) AS mean, stddev_samp(pow((1 - tau) * p + tau * 0.5e0 - y, 2)) / sqrt(count(*)) AS se FROM games, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS tau) GROUP BY tau), b AS (SELECT arg_min(mean, mean) AS m, arg_min(se, mean) AS e FROM s)"


@query("one_se_rule", f"{TAU} SELECT min(tau) AS tau FROM s, b WHERE mean <= m + e", "tau")
def one_se_rule(t):
    return R.one_se(tau_scores(t), "tau", "mean", "se")


@query("one_se_model_choice", "WITH l AS (SELECT 'coin' AS model, 0 AS size, pow(0.5e0 - y, 2) AS l FROM games UNION ALL SELECT 'p', 1, pow(p - y, 2) FROM games UNION ALL SELECT 'q', 2, pow(q - y, 2) FROM games), s AS (SELECT model, size, avg(l) AS mean, stddev_samp(l) / sqrt(count(*)) AS se FROM l GROUP BY ALL), b AS (SELECT arg_min(mean + se, mean) AS top FROM s) SELECT arg_min(model, size) AS model, min(size) AS size FROM s, b WHERE mean <= top")
def one_se_model_choice(t):
    long = scoring.melt(t.games.withColumn("coin", F.lit(0.5)), ["y"], {"coin": "coin", "p": "p", "q": "q"}).withColumn("l", scoring.brier("y", "p"))
    s = long.groupBy("model").agg(F.avg("l").alias("mean"), (F.stddev_samp("l") / F.sqrt(F.count("*"))).alias("se")).withColumn("size", F.when(F.col("model") == "coin", 0).when(F.col("model") == "p", 1).otherwise(2))
    top = s.agg(F.min_by(F.col("mean") + F.col("se"), "mean").alias("top"))
    return s.join(F.broadcast(top)).where("mean <= top").agg(F.min_by("model", "size").alias("model"), F.min("size").alias("size"))


@query("boot_coef_se", f"""WITH {sql_weights("games", "game_id", 50, 9)}, rw AS (SELECT rep, w, p AS x, y, CASE WHEN week >= 20 THEN 1 ELSE 0 END AS bucket FROM games g JOIN wt USING (game_id)), {sql_newton("rw", "bucket, rep")}
SELECT bucket, avg(b1) AS slope, stddev_samp(b1) AS se FROM fit GROUP BY bucket""", "slope se")
def boot_coef_se(t):
    """The slope of a logistic model in each bucket of weeks: mean and standard deviation over refits."""
    rows = R.with_weights(t.games.select("game_id", "p", "y", A.bucket(F.col("week"), [20]).alias("bucket")), ["game_id"], 50, 9)
    slope = F.col("coefs")[1]
    return R.refit_logistic(rows, ["p"], "y", "weights", "bucket").groupBy("bucket").agg(F.avg(slope).alias("slope"), F.stddev_samp(slope).alias("se"))


@query("loso_cv", "WITH s AS (SELECT season, tau, sum(pow((1 - tau) * p + tau * 0.5e0 - y, 2)) AS l, count(*) AS n FROM games, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS tau) GROUP BY ALL), o AS (SELECT a.season, a.tau, a.l / a.n AS own, sum(b.l) / sum(b.n) AS rest FROM s a JOIN s b ON b.tau = a.tau AND b.season <> a.season GROUP BY a.season, a.tau, a.l, a.n) SELECT season, arg_min(tau, rest) AS tau, arg_min(own, rest) AS score FROM o GROUP BY season", "tau score")
def loso_cv(t):
    g = t.games.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    s = g.withColumn("l", F.pow((1 - F.col("tau")) * F.col("p") + F.col("tau") * 0.5 - F.col("y"), 2)).groupBy("season", "tau").agg(F.sum("l").alias("l"), F.count("*").alias("n"))
    total = s.groupBy("tau").agg(F.sum("l").alias("tl"), F.sum("n").alias("tn"))
    rest = (F.col("tl") - F.col("l")) / (F.col("tn") - F.col("n"))
    return s.join(F.broadcast(total), "tau").groupBy("season").agg(F.min_by("tau", rest).alias("tau"), F.min_by(F.col("l") / F.col("n"), rest).alias("score"))


@query("udf_builder_callable", "SELECT home, count(*) AS n, sum(y) AS won FROM games GROUP BY home", "won")
def udf_builder_callable(t):
    def builder(games, column="home"):
        return games.groupBy(column).agg(F.count("*").alias("n"), F.sum("y").alias("won"))

    return t.games.transform(builder, column="home")


@query("udf_fit_predict", "WITH s AS (SELECT season, sum(y) AS w, count(*) AS n FROM games GROUP BY season) SELECT g.game_id, (SELECT sum(w) / sum(n) FROM s WHERE s.season < g.season) AS pred FROM games g WHERE season BETWEEN 1996 AND 2001", "pred")
def udf_fit_predict(t):
    fit = lambda train: train.agg(F.avg("y").alias("pred"))
    return M.walk_forward(t.games, "season", SEASONS, fit, lambda m, test: test.join(F.broadcast(m)).select("game_id", "pred"))


@query("udf_extra_feature", "SELECT game_id, p * q AS pq, p - q AS gap FROM games", "pq gap")
def udf_extra_feature(t):
    return t.games.withColumns({"pq": F.col("p") * F.col("q"), "gap": F.col("p") - F.col("q")}).select("game_id", "pq", "gap")


@query("udaf_metric", "SELECT season, avg(pow(p - y, 2)) AS brier, avg(abs(y - p)) AS mae, median(abs(y - p)) AS med FROM games GROUP BY season", "brier mae med")
def udaf_metric(t):
    median_gap = F.median(F.abs(F.col("y") - F.col("p"))).alias("med")
    known = scoring.scores(t.games, "y", "p", ["season"], ["brier", "mae"]).drop("n")
    return known.join(t.games.groupBy("season").agg(median_gap), "season")


@query("udtf_explode_outcomes", "SELECT game_id, play_id, player, unnest([-5, 0, 5, 15])::BIGINT AS y, greatest(yardline - unnest([-5, 0, 5, 15]), 0) AS land FROM plays WHERE down = 4")
def udtf_explode_outcomes(t):
    @udtf(returnType="y long, land long")
    class Outcomes:
        def eval(self, yardline: int):
            for y, _ in OUTCOMES:
                yield y, max(yardline - y, 0)

    d = t.plays.where("down = 4").select("game_id", "play_id", "player", "yardline")
    return d.lateralJoin(Outcomes(F.col("yardline").outer())).select("game_id", "play_id", "player", "y", "land")
