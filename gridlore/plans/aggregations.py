"""Queries of the aggregations over contests, plays and entities."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlore.operators import aggregates as A
from gridlore.operators import asof, contests, scoring
from gridlore.registry import Tables, query

REG = "game_type = 'REG'"
#: Side rows in SQL, as `sides` makes them.
SIDES = """sides AS (SELECT season, week, game_id, home AS team, away AS opp, true AS is_home, home_score AS points, away_score AS points_opp, p AS prob, y AS result FROM games
    UNION ALL SELECT season, week, game_id, away, home, false, away_score, home_score, 1 - p, 1 - y FROM games)"""


def sides(t: Tables):
    return contests.unpivot_sides(t.games, ["season", "week", "game_id"], mirrored={"points": ("home_score", "away_score")}, flipped={"prob": "p", "result": "y"})


@query("agg_team_game", "SELECT game_id, off, def, count(*) AS n, sum(epa) AS epa_sum, count(*) FILTER (WHERE is_pass = 1) AS n_pass, coalesce(sum(epa) FILTER (WHERE is_pass = 1), 0) AS epa_pass, sum(success) AS success FROM plays GROUP BY ALL", "epa_sum epa_pass success")
def agg_team_game(t):
    p = F.col("is_pass")
    return A.rates(t.plays, ["game_id", "off", "def"], {"epa_sum": F.col("epa"), "n_pass": p.cast("long"), "epa_pass": p * F.col("epa"), "success": F.col("success")})


@query("agg_rates_pooled", """WITH s AS (SELECT off, season, count(*) AS n, sum(epa) AS e FROM plays GROUP BY ALL)
SELECT c.off, c.season, (c.e + 0.5 * coalesce(p.e, 0)) / (c.n + 0.5 * coalesce(p.n, 0)) AS rate FROM s c LEFT JOIN s p ON c.off = p.off AND p.season = c.season - 1""", "rate")
def agg_rates_pooled(t):
    s = t.plays.groupBy("off", "season").agg(F.count("*").alias("n"), F.sum("epa").alias("e"))
    prev = s.select("off", (F.col("season") + 1).alias("season"), F.col("n").alias("pn"), F.col("e").alias("pe"))
    return s.join(prev, ["off", "season"], "left").select("off", "season", A.pooled_rate("e", "pe", "n", "pn", 0.5).alias("rate"))


@query("agg_rating_table", """WITH w AS (SELECT season, week, row_number() OVER (ORDER BY season, week) - 1 AS ord FROM (SELECT DISTINCT season, week FROM games)),
a AS (SELECT game_id, off, count(*) AS n, sum(epa) AS s FROM plays GROUP BY ALL)
SELECT a.game_id, a.off, a.n, a.s, g.home = a.off AND NOT g.neutral AS at_home, w.ord FROM a JOIN games g USING (game_id) JOIN w ON g.season = w.season AND g.week = w.week""", "s")
def agg_rating_table(t):
    acc = t.plays.groupBy("game_id", "off").agg(F.count("*").alias("n"), F.sum("epa").alias("s"))
    weeks = t.games.select("season", "week").distinct().withColumn("ord", F.row_number().over(W.orderBy("season", "week")) - 1)
    g = t.games.join(F.broadcast(weeks), ["season", "week"]).select("game_id", "home", "neutral", "ord")  # a few hundred weeks
    return acc.join(g, "game_id").select("game_id", "off", "n", "s", ((F.col("home") == F.col("off")) & ~F.col("neutral")).alias("at_home"), F.col("ord").cast("long"))


@query("agg_qb_game", """SELECT game_id, off, passer, count(*) AS n, avg(epa) AS value, avg(success) AS second, count(*) / sum(count(*)) OVER (PARTITION BY game_id, off) AS share,
count(*) FILTER (WHERE down = 1) < count(*) / 2e0 AS left_early FROM plays WHERE is_pass = 1 GROUP BY game_id, off, passer""", "value second share")
def agg_qb_game(t):
    g = t.plays.where("is_pass = 1").groupBy("game_id", "off", "passer").agg(F.count("*").alias("n"), F.avg("epa").alias("value"), F.avg("success").alias("second"), F.count_if(F.col("down") == 1).alias("first"))
    return A.share_of_total(g, "n", ["game_id", "off"]).select("game_id", "off", "passer", "n", "value", "second", "share", (F.col("first") < F.col("n") / 2).alias("left_early"))


@query("agg_contest_margins", """WITH a AS (SELECT game_id, off, avg(epa) AS r FROM plays GROUP BY ALL)
SELECT g.game_id, g.home_score - g.away_score AS margin, h.r - w.r AS value_margin FROM games g LEFT JOIN a h ON h.game_id = g.game_id AND h.off = g.home LEFT JOIN a w ON w.game_id = g.game_id AND w.off = g.away""", "value_margin")
def agg_contest_margins(t):
    r = t.plays.groupBy("game_id", F.col("off").alias("team")).agg(F.avg("epa").alias("r"))
    return contests.side_difference(t.games, r, ["game_id"], "r", "value_margin").select("game_id", (F.col("home_score") - F.col("away_score")).alias("margin"), "value_margin")


@query("agg_epa_targets", """WITH a AS (SELECT off AS team, season, avg(epa) AS r FROM plays GROUP BY ALL)
SELECT g.game_id, h.r - w.r AS target FROM games g LEFT JOIN a h ON h.team = g.home AND h.season = g.season LEFT JOIN a w ON w.team = g.away AND w.season = g.season WHERE g.season BETWEEN 1993 AND 1996 AND g.game_type = 'REG'""", "target")
def agg_epa_targets(t):
    r = t.plays.groupBy("season", F.col("off").alias("team")).agg(F.avg("epa").alias("r"))
    return contests.side_difference(t.games.where(f"season BETWEEN 1993 AND 1996 AND {REG}"), r, ["season"], "r", "target").select("game_id", "target")


@query("agg_home_edge", "SELECT avg(home_score - away_score) AS edge, count(*) AS n FROM games WHERE NOT neutral AND season BETWEEN 1993 AND 1996", "edge")
def agg_home_edge(t):
    return t.games.where("NOT neutral AND season BETWEEN 1993 AND 1996").agg(F.avg(F.col("home_score") - F.col("away_score")).alias("edge"), F.count("*").alias("n"))


DECAY = """s AS (SELECT {k} AS k, season, sum({num}) AS num, {den} AS den FROM plays GROUP BY ALL),
d AS (SELECT c.k, c.season, coalesce(sum(pow(0.5e0, (c.season - p.season) / {life}) * p.num), 0) AS num, coalesce(sum(pow(0.5e0, (c.season - p.season) / {life}) * p.den), 0) AS den
FROM s c LEFT JOIN s p ON p.k = c.k AND p.season < c.season GROUP BY c.k, c.season)"""


@query("agg_decay_values", f"WITH {DECAY.format(k='passer', num='epa', den='count(*)', life='2e0')} SELECT k AS passer, season, (num + 50 * -0.1e0) / (den + 50) AS value, den AS weight FROM d", "value weight")
def agg_decay_values(t):
    return asof.decayed_values(t.plays.withColumn("one", F.lit(1.0)), ["passer"], "season", "epa", "one", life=2.0, prior=-0.1, strength=50.0)


@query("agg_decay_values_ext", f"""WITH {DECAY.format(k='passer', num='epa + 0.2e0 * success', den='count(*)', life='2e0')}, f AS (SELECT passer AS k, min(season) AS debut FROM plays GROUP BY ALL)
SELECT k AS passer, season, (num + 50 * CASE WHEN season - debut >= 2 THEN 0.05e0 ELSE -0.05e0 END) / (den + 50) + 0.01e0 * least(season - debut, 3) AS value FROM d JOIN f USING (k)""", "value")
def agg_decay_values_ext(t):
    rows = t.plays.withColumns({"one": F.lit(1.0), "both": F.col("epa") + 0.2 * F.col("success")})
    sums = asof.decayed_values(rows, ["passer"], "season", "both", "one", 2.0, 0.0, 0.0).withColumn("num", F.coalesce("value", F.lit(0.0)) * F.col("weight"))
    debut = t.plays.groupBy("passer").agg(F.min("season").alias("debut"))
    years = F.col("season") - F.col("debut")
    prior = F.when(years >= 2, 0.05).otherwise(-0.05)
    return sums.join(debut, "passer").select("passer", "season", (A.shrunk(F.col("num"), F.col("weight"), 50.0, prior) + 0.01 * F.least(years, F.lit(3))).alias("value"))


@query("agg_remembered_mix", """WITH q AS (SELECT passer, season, sum(epa) AS s, count(*) AS n FROM plays GROUP BY ALL), m AS (SELECT off, season, passer, count(*) AS w FROM plays GROUP BY ALL),
v AS (SELECT y.season, passer, sum(s) / sum(n) AS v FROM (SELECT DISTINCT season FROM plays) y JOIN q ON q.season < y.season GROUP BY ALL),
x AS (SELECT season, off, sum(w * v) / sum(w) AS mix FROM m JOIN v USING (season, passer) GROUP BY ALL) SELECT season, off, mix, mix - avg(mix) OVER (PARTITION BY season) AS delta FROM x""", "mix delta")
def agg_remembered_mix(t):
    """Each season's mix of what its passers were worth before it, and its distance from the season's mean."""
    past = t.plays.groupBy("passer", "season").agg(F.sum("epa").alias("s"), F.count("*").alias("n"))
    seasons = t.plays.select(F.col("season").alias("now")).distinct()
    v = past.join(F.broadcast(seasons), F.col("season") < F.col("now")).groupBy(F.struct(F.col("now").alias("season"), "passer").alias("who")).agg((F.sum("s") / F.sum("n")).alias("v"))
    m = t.plays.groupBy("off", "season", "passer").agg(F.count("*").alias("w")).withColumn("who", F.struct("season", "passer"))
    mix = asof.decayed_mix(m, v, ["season", "off"], "who", "w", "v")
    return mix.withColumn("delta", F.col("mix") - F.avg("mix").over(W.partitionBy("season")))


@query("agg_replacement_prior", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, game_id, play_id) AS k, min(season) OVER (PARTITION BY player) AS debut FROM plays),
f AS (SELECT season, epa FROM r WHERE k <= 10 AND debut > 1992), s AS (SELECT DISTINCT season FROM plays)
SELECT s.season, coalesce(avg(f.epa), (SELECT avg(epa) FROM f)) AS prior FROM s LEFT JOIN f ON f.season < s.season GROUP BY s.season""", "prior")
def agg_replacement_prior(t):
    w = W.partitionBy("player")
    first = t.plays.withColumns({"k": F.row_number().over(w.orderBy("ts", "game_id", "play_id")), "debut": F.min("season").over(w)}).where("k <= 10 AND debut > 1992")
    by = first.groupBy("season").agg(F.sum("epa").alias("s"), F.count("*").alias("n"))
    seasons = t.plays.select("season").distinct().join(by, "season", "left")
    past = W.orderBy("season").rowsBetween(W.unboundedPreceding, -1)  # over seasons
    every = W.partitionBy()
    return seasons.select("season", F.coalesce(F.sum("s").over(past) / F.sum("n").over(past), F.sum("s").over(every) / F.sum("n").over(every)).alias("prior"))


@query("agg_replacement_levels", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, game_id, play_id) AS k FROM plays), s AS (SELECT DISTINCT season FROM plays)
SELECT s.season, r.kind, avg(r.epa) AS level, count(*) AS n FROM s JOIN r ON r.season < s.season AND k <= 20 GROUP BY s.season, r.kind""", "level")
def agg_replacement_levels(t):
    early = t.plays.withColumn("k", F.row_number().over(W.partitionBy("player").orderBy("ts", "game_id", "play_id"))).where("k <= 20")
    sums = early.groupBy("kind", "season").agg(F.sum("epa").alias("s"), F.count("*").alias("n"))
    grid = t.plays.select("season").distinct().join(F.broadcast(t.plays.select("kind").distinct()))
    before = W.partitionBy("kind").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    out = grid.join(sums, ["kind", "season"], "left").select("season", "kind", (F.sum("s").over(before) / F.sum("n").over(before)).alias("level"), F.sum("n").over(before).alias("n"))
    return out.where("n > 0")


@query("agg_box_values", f"""WITH {DECAY.format(k="player || '|' || kind", num='epa', den='count(*)', life='1e0')}, v AS (SELECT CAST(split_part(k, '|', 1) AS BIGINT) AS player, season, (num + 5 * -0.2e0) / (den + 5) + 0.2e0 AS v FROM d)
SELECT player, season, sum(v) AS value FROM v GROUP BY ALL""", "value")
def agg_box_values(t):
    parts = asof.decayed_values(t.plays.withColumn("one", F.lit(1.0)), ["player", "kind"], "season", "epa", "one", 1.0, -0.2, 5.0)
    return parts.groupBy("player", "season").agg(F.sum(F.col("value") + 0.2).alias("value"))


@query("agg_league_mean", """WITH s AS (SELECT kind, season, sum(epa) AS e, count(*) AS n FROM plays GROUP BY ALL)
SELECT kind, season, coalesce(sum(e) OVER w / sum(n) OVER w, e / n) AS mean FROM s WINDOW w AS (PARTITION BY kind ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)""", "mean")
def agg_league_mean(t):
    return A.lookback_mean(t.plays.withColumn("one", F.lit(1)), ["kind"], "season", "epa", "one", 3)


@query("agg_credit_player_game", """WITH c AS (SELECT game_id, off AS team, player AS entity, kind, epa * 0.6e0 AS v FROM plays UNION ALL SELECT game_id, off, passer, kind, epa * 0.4e0 FROM plays)
SELECT game_id, team, entity, sum(v) FILTER (WHERE kind = 'A') AS a, sum(v) FILTER (WHERE kind = 'N') AS n, sum(v) FILTER (WHERE kind = 'R') AS r FROM c GROUP BY ALL""", "a n r")
def agg_credit_player_game(t):
    c = A.explode_credit(t.plays, ["player", "passer"], "epa", [0.6, 0.4])
    out = c.groupBy("game_id", F.col("off").alias("team"), "entity").pivot("kind", ["A", "N", "R"]).agg(F.sum("credit"))
    return out.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("agg_leave_one_out", """WITH s AS (SELECT off, player, sum(epa) AS e, CAST(count(*) AS DOUBLE) AS n FROM plays GROUP BY ALL)
SELECT off, player, e / n - (sum(e) OVER w - e + 10 * 0.0e0) / (sum(n) OVER w - n + 10) AS vs_others FROM s WINDOW w AS (PARTITION BY off)""", "vs_others")
def agg_leave_one_out(t):
    s = t.plays.groupBy("off", "player").agg(F.sum("epa").alias("e"), F.count("*").cast("double").alias("n"))
    return A.leave_one_out(s, ["off"], "e", "n", 10.0, 0.0).select("off", "player", "vs_others")


@query("agg_prior_other_baseline", """WITH s AS (SELECT passer, player, season, sum(epa) AS e, count(*) AS n FROM plays GROUP BY ALL),
q AS (SELECT passer, season, sum(e) AS e, sum(n) AS n FROM s GROUP BY ALL)
SELECT s.passer, s.player, s.season, (SELECT sum(e) FROM q WHERE q.passer = s.passer AND q.season < s.season) - coalesce((SELECT sum(e) FROM s x WHERE x.passer = s.passer AND x.player = s.player AND x.season < s.season), 0) AS other_sum,
CAST((SELECT sum(n) FROM q WHERE q.passer = s.passer AND q.season < s.season) - coalesce((SELECT sum(n) FROM s x WHERE x.passer = s.passer AND x.player = s.player AND x.season < s.season), 0) AS BIGINT) AS other_n FROM s WHERE s.season > (SELECT min(season) FROM s x WHERE x.passer = s.passer)""", "other_sum")
def agg_prior_other_baseline(t):
    rows = t.plays.withColumn("one", F.lit(1))
    pair = asof.period_sums_before(rows, ["passer", "player"], "season", ["epa", "one"])
    alone = asof.period_sums_before(rows, ["passer"], "season", ["epa", "one"]).select("passer", "season", F.col("epa_before").alias("e"), F.col("one_before").alias("n"))
    out = pair.join(alone, ["passer", "season"]).where("n > 0")
    return out.select("passer", "player", "season", (F.col("e") - F.col("epa_before")).alias("other_sum"), (F.col("n") - F.col("one_before")).alias("other_n"))


BAND = "CASE WHEN yardline >= 60 THEN 3 WHEN yardline >= 40 THEN 2 WHEN yardline >= 20 THEN 1 ELSE 0 END"


@query("agg_kicker_expected", f"""WITH r AS (SELECT *, {BAND} AS band FROM plays), s AS (SELECT band, season, sum(success) AS e, count(*) AS n FROM r GROUP BY ALL),
l AS (SELECT band, season, coalesce(sum(e) OVER w / sum(n) OVER w, e / n) AS rate FROM s WINDOW w AS (PARTITION BY band ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT player, r.season, sum(3 * (success - rate)) AS over_expected, count(*) AS n FROM r JOIN l ON l.band = r.band AND l.season = r.season GROUP BY ALL""", "over_expected")
def agg_kicker_expected(t):
    r = t.plays.withColumn("band", A.bucket(F.col("yardline"), [20, 40, 60])).withColumn("one", F.lit(1))
    league = A.lookback_mean(r, ["band"], "season", "success", "one", 3, "rate")
    return r.join(F.broadcast(league), ["band", "season"]).groupBy("player", "season").agg(F.sum(3 * (F.col("success") - F.col("rate"))).alias("over_expected"), F.count("*").alias("n"))


@query("agg_explode_credit", """SELECT game_id, play_id, unnest([player, passer]) AS entity, epa / 2 AS credit FROM plays""", "credit")
def agg_explode_credit(t):
    return A.explode_credit(t.plays, ["player", "passer"], "epa").select("game_id", "play_id", "entity", "credit")


@query("agg_mode", "SELECT off, kind, n FROM (SELECT off, kind, count(*) AS n, row_number() OVER (PARTITION BY off ORDER BY count(*) DESC, min(ts), kind) AS k FROM plays GROUP BY off, kind) WHERE k = 1")
def agg_mode(t):
    return A.mode(t.plays, ["off"], "kind", F.col("ts"))


@query("agg_slots", "SELECT season, week, off, count(*) AS slots FROM (SELECT DISTINCT season, week, off, player FROM plays WHERE down = 1) GROUP BY ALL")
def agg_slots(t):
    return t.plays.where("down = 1").dropDuplicates(["season", "week", "off", "player"]).groupBy("season", "week", "off").agg(F.count("*").alias("slots"))


@query("agg_status_probability", """WITH c AS (SELECT status, kind, avg(success) AS a, count(*) AS n FROM plays GROUP BY ALL), h AS (SELECT kind, a AS healthy FROM c WHERE status = 'O'),
p AS (SELECT status, sum(success) / count(*) / (SELECT avg(success) FROM plays WHERE status = 'O') AS pooled FROM plays GROUP BY status)
SELECT status, kind, (least(1, a / healthy) * n + 100 * least(1, pooled)) / (n + 100) AS prob FROM c JOIN h USING (kind) JOIN p USING (status)""", "prob")
def agg_status_probability(t):
    cube = t.plays.cube("status", "kind").agg(F.avg("success").alias("a"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    cell, both = cube.where("g = 0").drop("g"), cube.where("g = 1").select("status", F.col("a").alias("pooled"))
    healthy = cell.where("status = 'O'").select("kind", F.col("a").alias("healthy"))
    base = both.where("status = 'O'").select(F.col("pooled").alias("base"))
    out = cell.join(F.broadcast(healthy), "kind").join(F.broadcast(both), "status").join(F.broadcast(base))  # a row for each status and kind
    one = F.lit(1.0)
    return out.select("status", "kind", A.shrunk(F.least(one, F.col("a") / F.col("healthy")) * F.col("n"), F.col("n"), 100.0, F.least(one, F.col("pooled") / F.col("base"))).alias("prob"))


@query("agg_default_share", """WITH g AS (SELECT season, game_id, off, player, kind, count(*) AS n FROM plays GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY game_id, off) AS share FROM g), y AS (SELECT DISTINCT season FROM plays)
SELECT y.season, kind, avg(share) AS share FROM y JOIN s ON s.season < y.season GROUP BY ALL""", "share")
def agg_default_share(t):
    g = A.share_of_total(t.plays.groupBy("season", "game_id", "off", "player", "kind").agg(F.count("*").alias("n")), "n", ["game_id", "off"])
    sums = g.groupBy("kind", "season").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    grid = t.plays.select("season").distinct().join(F.broadcast(t.plays.select("kind").distinct()))
    w = W.partitionBy("kind").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    return grid.join(sums, ["kind", "season"], "left").select("season", "kind", (F.sum("s").over(w) / F.sum("n").over(w)).alias("share")).where("share IS NOT NULL")


@query("agg_expected_share", f"WITH {DECAY.format(k='player', num='success', den='count(*)', life='15e-1')} SELECT k AS player, season, (num + 8 * 0.3e0) / (den + 8) AS share FROM d", "share")
def agg_expected_share(t):
    return asof.decayed_values(t.plays.withColumn("one", F.lit(1.0)), ["player"], "season", "success", "one", 1.5, 0.3, 8.0, "share").drop("weight")


@query("agg_starters_out", "SELECT season, week, off, count(*) FILTER (WHERE success = 0) AS n_out FROM plays WHERE down = 1 GROUP BY ALL")
def agg_starters_out(t):
    return t.plays.where("down = 1").groupBy("season", "week", "off").agg(F.count_if(F.col("success") == 0).alias("n_out"))


#: What the members of a side's units are worth as of each of its weeks: x(team, unit, season, week, expected, remembered, last) and g, the sides of games.
LINEUPS = """r AS (SELECT off AS team, 'off' AS unit, season, week, player AS member, epa FROM plays UNION ALL SELECT def, 'def', season, week, passer, epa FROM plays),
n AS (SELECT team, unit, season, week, member, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY team, unit, season, week) AS share FROM n),
q AS (SELECT unit, member, season, sum(epa) AS s, count(*) AS n FROM r GROUP BY ALL), v AS (SELECT y.season, unit, member, sum(s) / (sum(n) + 20) AS v FROM (SELECT DISTINCT season FROM plays) y JOIN q ON q.season < y.season GROUP BY ALL),
d AS (SELECT s.*, s.season + k AS at_ FROM s, (SELECT unnest([0, 1]) AS k)),
c AS (SELECT team, d.unit, at_, d.season AS t, week AS w, sum(share * coalesce(v, 0)) AS c FROM d LEFT JOIN v ON v.unit = d.unit AND v.member = d.member AND v.season = at_ GROUP BY ALL),
g AS (SELECT game_id, 'home' AS side, home AS team, season, week FROM games UNION ALL SELECT game_id, 'away', away, season, week FROM games),
k AS (SELECT DISTINCT team, unit, season, week FROM g, (SELECT unnest(['off', 'def']) AS unit)),
p AS (SELECT k.*, t, c, (season - t) * 53 + week - w AS age, pow(0.5e0, ((season - t) * 53 + week - w) / 8e0) * CASE WHEN t < season THEN 0.6e0 ELSE 1e0 END AS wt FROM k JOIN c ON c.team = k.team AND c.unit = k.unit AND at_ = season WHERE (season - t) * 53 + week - w > 0),
o AS (SELECT team, unit, season, week, arg_min(c, age) AS e, sum(wt * c) / sum(wt) AS m, avg(c) FILTER (WHERE t < season) AS l FROM p GROUP BY ALL),
x AS (SELECT k.*, coalesce(e, 0) AS expected, coalesce(m, e, 0) AS remembered, coalesce(l, e, 0) AS last FROM k LEFT JOIN o USING (team, unit, season, week))"""


def lineups(t):
    """Expected, remembered and last-season worth of both units of every side that has a game in a week."""
    r = t.plays.select(F.col("off").alias("team"), F.lit("off").alias("unit"), "season", "week", F.col("player").alias("member"), "epa").unionByName(t.plays.select(F.col("def").alias("team"), F.lit("def").alias("unit"), "season", "week", F.col("passer").alias("member"), "epa"))
    n = r.groupBy("team", "unit", "season", "week", "member").agg(F.count("*").alias("n"))
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("team", "unit", "season", "week")))
    past = r.groupBy("unit", "member", "season").agg(F.sum("epa").alias("s"), F.count("*").alias("c"))
    seasons = t.plays.select(F.col("season").alias("now")).distinct()
    values = past.join(F.broadcast(seasons), F.col("season") < F.col("now")).groupBy("unit", "member", F.col("now").alias("season")).agg(A.shrunk(F.sum("s"), F.sum("c"), 20.0, 0.0).alias("value"))
    g = t.games.select("season", "week", F.explode(F.array("home", "away")).alias("team")).withColumn("unit", F.explode(F.array(F.lit("off"), F.lit("def"))))
    return asof.lineup_terms(shares, values, g, ["team", "unit"], 8.0, 0.6)


@query("agg_lineup_terms", f"WITH {LINEUPS} SELECT game_id, side, unit, expected, remembered, last FROM g JOIN x USING (team, season, week)", "expected remembered last")
def agg_lineup_terms(t):
    sides = t.games.select("game_id", "season", "week", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("team")), F.struct(F.lit("away").alias("side"), F.col("away").alias("team")))).alias("s")).select("game_id", "season", "week", "s.*")
    return sides.join(lineups(t), ["team", "season", "week"]).select("game_id", "side", "unit", "expected", "remembered", "last")


@query("agg_snaps_shares", """WITH s AS (SELECT game_id, off, season, unnest([player, passer]) AS member FROM plays), g AS (SELECT season, game_id, off, member, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT game_id, off, count(*) AS total FROM plays GROUP BY ALL)
SELECT season, member, sum(n)::BIGINT AS snaps, avg(n / total) AS share FROM g JOIN p USING (game_id, off) GROUP BY ALL""", "share")
def agg_snaps_shares(t):
    g = t.plays.select("season", "game_id", "off", F.explode(F.array("player", "passer")).alias("member")).groupBy("season", "game_id", "off", "member").agg(F.count("*").alias("n"))
    total = t.plays.groupBy("game_id", "off").agg(F.count("*").alias("total"))
    return g.join(total, ["game_id", "off"]).groupBy("season", "member").agg(F.sum("n").alias("snaps"), F.avg(F.col("n") / F.col("total")).alias("share"))


LOSS = "-(y * ln(greatest(1e-6, least(1 - 1e-6, {p}))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, {p}))))"
ACC = "CASE WHEN y = 0.5 OR {p} = 0.5 THEN NULL WHEN ({p} > 0.5) = (y > 0.5) THEN 1e0 ELSE 0e0 END"
SCORES = f"count(*) AS n, avg(pow({{p}} - y, 2)) AS brier, avg({LOSS}) AS logloss, avg({ACC}) AS accuracy"


@query("agg_scores", f"SELECT {SCORES.format(p='p')} FROM games", "brier logloss accuracy")
def agg_scores(t):
    return scoring.scores(t.games, "y", "p")


@query("agg_compare_models", """WITH g AS (SELECT * FROM games WHERE m IS NOT NULL), l AS (SELECT 'p' AS model, y, p AS v, m FROM g UNION ALL SELECT 'q', y, q, m FROM g UNION ALL SELECT 'm', y, m, m FROM g)
SELECT model, count(*) AS n, avg(pow(v - y, 2)) AS brier, avg(pow(v - y, 2) - pow(m - y, 2)) AS diff, stddev_samp(pow(v - y, 2) - pow(m - y, 2)) / sqrt(count(*)) AS se FROM l GROUP BY model""", "brier diff se")
def agg_compare_models(t):
    long = scoring.melt(t.games.where("m IS NOT NULL"), ["y", "m"], {"p": "p", "q": "q", "m": "m"}, "v")
    return scoring.paired_difference(long, "y", "v", "m", by=["model"]).join(scoring.scores(long, "y", "v", ["model"], ["brier"]).drop("n"), "model")


@query("agg_home_rate", """WITH s AS (SELECT season, sum(y) AS w, count(*) AS n FROM games WHERE NOT neutral GROUP BY season)
SELECT season, coalesce(sum(w) OVER x / sum(n) OVER x, w / n) AS rate FROM s WINDOW x AS (ORDER BY season RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)""", "rate")
def agg_home_rate(t):
    return A.lookback_mean(t.games.where("NOT neutral").withColumns({"one": F.lit(1), "all": F.lit(0)}), ["all"], "season", "y", "one", 10, "rate").drop("all")


@query("agg_baseline_frame", """WITH s AS (SELECT season, avg(y) AS r FROM games GROUP BY season) SELECT game_id, 0.5e0 AS coin, r AS home_rate, p AS rating, m AS market FROM games LEFT JOIN (SELECT season + 1 AS season, r FROM s) USING (season) WHERE season >= 1994""", "coin home_rate rating market")
def agg_baseline_frame(t):
    r = t.games.groupBy((F.col("season") + 1).alias("season")).agg(F.avg("y").alias("home_rate"))
    return t.games.where("season >= 1994").join(F.broadcast(r), "season", "left").select("game_id", F.lit(0.5).alias("coin"), "home_rate", F.col("p").alias("rating"), F.col("m").alias("market"))


BIN = "least(CAST(floor(p * 10) AS INT), 9)"


@query("agg_reliability", f"SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y, avg(y) - avg(p) AS gap FROM games GROUP BY 1", "mean_p mean_y gap")
def agg_reliability(t):
    return scoring.reliability(t.games.withColumn("bin", scoring.uniform_bin(F.col("p"), 10)), "y", "p")


@query("agg_ece", f"SELECT sum(n * abs(gap)) / sum(n) AS ece FROM (SELECT {BIN} AS bin, count(*) AS n, avg(y) - avg(p) AS gap FROM games GROUP BY 1)", "ece")
def agg_ece(t):
    return scoring.ece(scoring.reliability(t.games.withColumn("bin", scoring.uniform_bin(F.col("p"), 10)), "y", "p"))


@query("agg_calibration_segments", """WITH b AS (SELECT *, ntile(5) OVER (PARTITION BY season ORDER BY p, game_id) - 1 AS bin FROM games)
SELECT season, CAST(bin AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y, avg(y) - avg(p) AS gap FROM b GROUP BY season, bin HAVING count(*) >= 20""", "mean_p mean_y gap")
def agg_calibration_segments(t):
    b = scoring.quantile_bin(t.games, "p", 5, ["game_id"], ["season"])
    return scoring.reliability(b, "y", "p", by=["season"]).where("n >= 20")


@query("agg_brier_decomposition", """WITH b AS (SELECT *, ntile(10) OVER (PARTITION BY season ORDER BY p, game_id) AS bin FROM games), r AS (SELECT season, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY ALL),
t AS (SELECT season, sum(n) AS total, sum(n * my) / sum(n) AS base FROM r GROUP BY season)
SELECT season, sum(n / total * pow(my - mp, 2)) AS reliability, sum(n / total * pow(my - base, 2)) AS resolution, max(base * (1 - base)) AS uncertainty FROM r JOIN t USING (season) GROUP BY season""", "reliability resolution uncertainty")
def agg_brier_decomposition(t):
    return scoring.decomposition(scoring.reliability(scoring.quantile_bin(t.games, "p", 10, ["game_id"], ["season"]), "y", "p", by=["season"]), ["season"])


@query("agg_sharpness", "SELECT season, stddev_samp(p) AS sd, avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS entropy FROM games GROUP BY season", "sd entropy")
def agg_sharpness(t):
    return scoring.sharpness(t.games, "p", ["season"])


@query("agg_season_scorecard", """SELECT season, count(*) AS n, CASE WHEN count(*) >= 100 THEN avg(pow(p - y, 2)) END AS brier, CASE WHEN count(m) >= 100 THEN avg(CASE WHEN m IS NOT NULL THEN pow(m - y, 2) END) END AS bench, avg(y) AS base, avg(home_score - away_score) AS edge FROM games GROUP BY season""", "brier bench base edge")
def agg_season_scorecard(t):
    g = t.games.groupBy("season").agg(F.count("*").alias("n"), F.avg(scoring.brier("y", "p")).alias("b"), F.count("m").alias("nm"), F.avg(scoring.brier("y", "m")).alias("k"), F.avg("y").alias("base"), F.avg(F.col("home_score") - F.col("away_score")).alias("edge"))
    return g.select("season", "n", F.when(F.col("n") >= 100, F.col("b")).alias("brier"), F.when(F.col("nm") >= 100, F.col("k")).alias("bench"), "base", "edge")


@query("agg_decade_edge", "SELECT CAST(floor(season / 10) * 10 AS INT) AS decade, count(*) AS n, avg(y) AS home_rate, avg(home_score - away_score) AS edge FROM games WHERE NOT neutral GROUP BY 1", "home_rate edge")
def agg_decade_edge(t):
    return t.games.where("NOT neutral").groupBy((F.floor(F.col("season") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.avg("y").alias("home_rate"), F.avg(F.col("home_score") - F.col("away_score")).alias("edge"))


@query("agg_luck", f"WITH {SIDES} SELECT team, season, sum(result) AS won, sum(prob) AS expected, sum(result) - sum(prob) AS luck FROM sides GROUP BY ALL", "won expected luck")
def agg_luck(t):
    s = sides(t).groupBy("team", "season").agg(F.sum("result").alias("won"), F.sum("prob").alias("expected"))
    return s.withColumn("luck", F.col("won") - F.col("expected"))


@query("agg_luck_index", f"""WITH {SIDES}, s AS (SELECT team, season, count(*) AS n, sum(result) - sum(prob) AS luck, coalesce(avg(result) FILTER (WHERE abs(points - points_opp) <= 7), 0.5e0) - 0.5e0 AS close_luck, sum(points) AS pf, sum(points_opp) AS pa FROM sides GROUP BY ALL)
SELECT team, avg(luck) AS luck, avg(close_luck) AS close_luck, avg(pow(pf, 2.37e0) / (pow(pf, 2.37e0) + pow(pa, 2.37e0)) * n) AS pythagorean FROM s GROUP BY team""", "luck close_luck pythagorean")
def agg_luck_index(t):
    near = F.abs(F.col("points") - F.col("points_opp")) <= 7
    s = sides(t).groupBy("team", "season").agg(F.count("*").alias("n"), (F.sum("result") - F.sum("prob")).alias("luck"), (F.coalesce(F.avg(F.when(near, F.col("result"))), F.lit(0.5)) - 0.5).alias("close_luck"), F.sum("points").cast("double").alias("pf"), F.sum("points_opp").cast("double").alias("pa"))
    x, y = F.pow("pf", F.lit(2.37)), F.pow("pa", F.lit(2.37))
    return s.groupBy("team").agg(F.avg("luck").alias("luck"), F.avg("close_luck").alias("close_luck"), F.avg(x / (x + y) * F.col("n")).alias("pythagorean"))


@query("agg_parity", f"WITH {SIDES} SELECT season, stddev_pop(pct) AS sd, count(*) AS teams FROM (SELECT season, team, avg(result) AS pct FROM sides GROUP BY ALL) GROUP BY season", "sd")
def agg_parity(t):
    return sides(t).groupBy("season", "team").agg(F.avg("result").alias("pct")).groupBy("season").agg(F.stddev_pop("pct").alias("sd"), F.count("*").alias("teams"))


@query("agg_parity_index", f"""WITH {SIDES}, s AS (SELECT season, team, avg(result) AS pct FROM sides GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY pct) AS k FROM s),
d AS (SELECT season, stddev_pop(pct) AS sd FROM s GROUP BY season), c AS (SELECT a.season, corr(a.k, b.k) AS stable FROM r a JOIN r b ON b.team = a.team AND b.season = a.season - 1 GROUP BY a.season),
j AS (SELECT * FROM d JOIN c USING (season)), z AS (SELECT season, (sd - avg(sd) OVER ()) / stddev_samp(sd) OVER () AS zd, (stable - avg(stable) OVER ()) / stddev_samp(stable) OVER () AS zs FROM j)
SELECT season, 50 - 10 * (0.6e0 * zd + 0.4e0 * zs) AS parity FROM z""", "parity")
def agg_parity_index(t):
    s = sides(t).groupBy("season", "team").agg(F.avg("result").alias("pct")).withColumn("k", F.rank().over(W.partitionBy("season").orderBy("pct")))
    last = s.select((F.col("season") + 1).alias("season"), "team", F.col("k").alias("k0"))
    j = s.groupBy("season").agg(F.stddev_pop("pct").alias("sd")).join(s.join(last, ["season", "team"]).groupBy("season").agg(F.corr("k", "k0").alias("stable")), "season")
    w = W.partitionBy()  # over seasons
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)
    return j.select("season", (50 - 10 * (0.6 * z("sd") + 0.4 * z("stable"))).alias("parity"))


@query("agg_upset_map", """SELECT season, CASE WHEN abs(p - 0.5e0) >= 0.3e0 THEN 3 WHEN abs(p - 0.5e0) >= 0.2e0 THEN 2 WHEN abs(p - 0.5e0) >= 0.1e0 THEN 1 ELSE 0 END AS gap_bin, count(*) AS n,
avg(CASE WHEN (p > 0.5) <> (y > 0.5) THEN 1e0 ELSE 0e0 END) AS upset_rate, avg(least(p, 1 - p)) AS expected FROM games WHERE y <> 0.5 GROUP BY 1, 2 HAVING count(*) >= 20""", "upset_rate expected")
def agg_upset_map(t):
    g = t.games.where("y <> 0.5").withColumn("gap_bin", A.bucket(F.abs(F.col("p") - 0.5), [0.1, 0.2, 0.3]))
    upset = ((F.col("p") > 0.5) != (F.col("y") > 0.5)).cast("double")
    return g.groupBy("season", "gap_bin").agg(F.count("*").alias("n"), F.avg(upset).alias("upset_rate"), F.avg(F.least(F.col("p"), 1 - F.col("p"))).alias("expected")).where("n >= 20")


@query("agg_volatility_dynasty", f"WITH {SIDES} SELECT team, season, stddev_samp(points - points_opp) AS volatility, CAST(sum(greatest(points - points_opp - 14, 0)) AS BIGINT) AS dominance, max(points) - min(points) AS spread FROM sides GROUP BY ALL", "volatility")
def agg_volatility_dynasty(t):
    d = F.col("points") - F.col("points_opp")
    return sides(t).groupBy("team", "season").agg(F.stddev_samp(d).alias("volatility"), F.sum(F.greatest(d - 14, F.lit(0))).alias("dominance"), (F.max("points") - F.min("points")).alias("spread"))


@query("agg_division_summary", f"""WITH {SIDES}, s AS (SELECT season, team, avg(result) AS pct FROM sides GROUP BY ALL), d AS (SELECT season, division, avg(pct) AS mean, stddev_samp(pct) AS sd, max(pct) - min(pct) AS spread, max_by(team, {{'a': pct, 'b': -team}}) AS best, min_by(team, {{'a': pct, 'b': team}}) AS worst FROM s JOIN teams USING (team) GROUP BY ALL)
SELECT *, dense_rank() OVER (PARTITION BY season ORDER BY mean DESC)::INT AS place FROM d""", "mean sd spread")
def agg_division_summary(t):
    s = sides(t).groupBy("season", "team").agg(F.avg("result").alias("pct")).join(F.broadcast(t.teams), "team")  # one row a team
    d = s.groupBy("season", "division").agg(F.avg("pct").alias("mean"), F.stddev_samp("pct").alias("sd"), (F.max("pct") - F.min("pct")).alias("spread"), F.max_by("team", F.struct("pct", -F.col("team"))).alias("best"), F.min_by("team", F.struct("pct", "team")).alias("worst"))
    return d.withColumn("place", F.dense_rank().over(W.partitionBy("season").orderBy(F.desc("mean"))))


@query("agg_season_team_summary", f"""WITH {SIDES}, a AS (SELECT season, team, min_by(prob, {{'w': week, 'g': game_id}}) AS first, max_by(prob, {{'w': week, 'g': game_id}}) AS last, count_if(result = 1)::BIGINT AS wins, count_if(result = 0)::BIGINT AS losses, count_if(result = 0.5)::BIGINT AS ties FROM sides GROUP BY ALL)
SELECT *, dense_rank() OVER (PARTITION BY season ORDER BY first DESC)::INT AS first_rank, dense_rank() OVER (PARTITION BY season ORDER BY last DESC)::INT AS last_rank FROM a""", "first last")
def agg_season_team_summary(t):
    at = F.struct("week", "game_id")
    a = sides(t).groupBy("season", "team").agg(F.min_by("prob", at).alias("first"), F.max_by("prob", at).alias("last"), F.count_if(F.col("result") == 1).alias("wins"), F.count_if(F.col("result") == 0).alias("losses"), F.count_if(F.col("result") == 0.5).alias("ties"))
    w = W.partitionBy("season")
    return a.withColumns({f"{c}_rank": F.dense_rank().over(w.orderBy(F.desc(c))) for c in ("first", "last")})


@query("agg_team_summary", f"""WITH {SIDES} SELECT team, max_by(prob, {{'s': season, 'w': week, 'g': game_id}}) AS latest, max(prob) AS peak, min(prob) AS low, avg(prob) AS mean, count_if(result = 1)::BIGINT AS wins, max(points - points_opp) AS best, min(points - points_opp) AS worst, min(season) AS since, max(season) AS until FROM sides GROUP BY team""", "latest peak low mean")
def agg_team_summary(t):
    d = F.col("points") - F.col("points_opp")
    return sides(t).groupBy("team").agg(F.max_by("prob", F.struct("season", "week", "game_id")).alias("latest"), F.max("prob").alias("peak"), F.min("prob").alias("low"), F.avg("prob").alias("mean"), F.count_if(F.col("result") == 1).alias("wins"), F.max(d).alias("best"), F.min(d).alias("worst"), F.min("season").alias("since"), F.max("season").alias("until"))


@query("agg_team_history", f"""WITH {SIDES}, s AS (SELECT team, season, avg(result) AS pct FROM sides GROUP BY ALL)
SELECT team, max_by(season, {{'a': pct, 'b': -season}}) AS best_season, min_by(season, {{'a': pct, 'b': season}}) AS worst_season, array_to_string(list(season || ':' || CAST(round(pct * 1000) AS BIGINT) ORDER BY season), ',') AS series FROM s GROUP BY team""")
def agg_team_history(t):
    s = sides(t).groupBy("team", "season").agg(F.avg("result").alias("pct"))
    one = F.concat_ws(":", F.col("season").cast("string"), F.round(F.col("pct") * 1000).cast("long").cast("string"))
    return s.groupBy("team").agg(F.max_by("season", F.struct("pct", -F.col("season"))).alias("best_season"), F.min_by("season", F.struct("pct", "season")).alias("worst_season"), F.array_join(F.array_sort(F.collect_list(one)), ",").alias("series"))


@query("agg_dashboard_tables", f"""WITH {SIDES}, s AS (SELECT team, season, avg(result) AS pct FROM sides GROUP BY ALL)
SELECT team, max(pct) AS peak, min_by(season, {{'a': -pct, 'b': season}}) AS peak_season, min(pct) AS low, min_by(season, {{'a': pct, 'b': season}}) AS low_season, avg(pct) AS mean FROM s GROUP BY team ORDER BY max(pct) - min(pct) DESC, team LIMIT 10""", "peak low mean")
def agg_dashboard_tables(t):
    s = sides(t).groupBy("team", "season").agg(F.avg("result").alias("pct"))
    return A.extremes(s, ["team"], "pct", ["season"]).orderBy(F.desc(F.col("peak") - F.col("low")), "team").limit(10)


@query("agg_monthly", "SELECT home AS team, strftime(game_date, '%Y-%m') AS month, max_by(p, {'a': kickoff, 'b': game_id}) AS last, avg(p) AS mean FROM games GROUP BY ALL", "last mean")
def agg_monthly(t):
    return t.games.groupBy(F.col("home").alias("team"), F.date_format(F.date_trunc("month", "kickoff"), "yyyy-MM").alias("month")).agg(F.max_by("p", F.struct("kickoff", "game_id")).alias("last"), F.avg("p").alias("mean"))


@query("agg_ladder", f"""WITH {SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY season DESC, week DESC, game_id DESC) AS k FROM sides), l AS (SELECT team, max(prob) FILTER (WHERE k = 1) AS rating, max(prob) FILTER (WHERE k = 2) AS before, array_to_string(list(points ORDER BY k DESC) FILTER (WHERE k <= 5), ',') AS spark FROM r WHERE k <= 5 GROUP BY team)
SELECT team, rating, rating - before AS change, spark, rank() OVER (ORDER BY rating DESC)::INT AS place FROM l""", "rating change")
def agg_ladder(t):
    r = sides(t).withColumn("k", F.row_number().over(W.partitionBy("team").orderBy(F.desc("season"), F.desc("week"), F.desc("game_id")))).where("k <= 5")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("prob")))
    spark = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "points"))), lambda x: x["points"].cast("string")), ",")
    out = r.groupBy("team").agg(at(1).alias("rating"), at(2).alias("before"), spark.alias("spark"))
    return out.select("team", "rating", (F.col("rating") - F.col("before")).alias("change"), "spark", F.rank().over(W.orderBy(F.desc("rating"))).alias("place"))  # ranks the teams


@query("agg_projected_wins", f"""WITH {SIDES} SELECT season, team, sum(CASE WHEN week <= 26 THEN result ELSE 0 END) AS so_far, sum(CASE WHEN week <= 26 THEN result ELSE prob END) AS projected, count_if(week > 26)::BIGINT AS remaining FROM sides GROUP BY season, team""", "so_far projected")
def agg_projected_wins(t):
    done = F.col("week") <= 26
    return sides(t).groupBy("season", "team").agg(F.sum(F.when(done, F.col("result")).otherwise(0.0)).alias("so_far"), F.sum(F.when(done, F.col("result")).otherwise(F.col("prob"))).alias("projected"), F.count_if(~done).alias("remaining"))


@query("agg_live_score", "SELECT count(*) AS n, avg(pow(p - y, 2)) AS brier, count(m) AS n_market, avg(pow(m - y, 2)) AS market_brier FROM games WHERE season = 1996 AND week >= 10", "brier market_brier")
def agg_live_score(t):
    return t.games.where("season = 1996 AND week >= 10").agg(F.count("*").alias("n"), F.avg(scoring.brier("y", "p")).alias("brier"), F.count("m").alias("n_market"), F.avg(scoring.brier("y", "m")).alias("market_brier"))


@query("agg_ats", """WITH r AS (SELECT season, home_score - away_score - spread AS cover, p * 28 - 14 - spread AS pick FROM games)
SELECT season, count_if(sign(cover) * sign(pick) = 1)::BIGINT AS won, count_if(sign(cover) * sign(pick) = -1)::BIGINT AS lost, count_if(cover = 0 AND pick <> 0)::BIGINT AS push, count_if(pick = 0)::BIGINT AS no_pick FROM r GROUP BY season""")
def agg_ats(t):
    r = t.games.select("season", (F.col("home_score") - F.col("away_score") - F.col("spread")).alias("cover"), (F.col("p") * 28 - 14 - F.col("spread")).alias("pick"))
    s = F.signum("cover") * F.signum("pick")
    return r.groupBy("season").agg(F.count_if(s == 1).alias("won"), F.count_if(s == -1).alias("lost"), F.count_if((F.col("cover") == 0) & (F.col("pick") != 0)).alias("push"), F.count_if(F.col("pick") == 0).alias("no_pick"))


@query("agg_leaderboard", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_at DESC, run_id DESC) AS k FROM ledger) SELECT key, run_id, p, rank() OVER (ORDER BY p, run_id)::INT AS place FROM l WHERE k = 1 ORDER BY p, run_id LIMIT 50""", "p")
def agg_leaderboard(t):
    latest = t.ledger.groupBy("key").agg(F.max_by(F.struct("run_id", "p"), F.struct("run_at", "run_id")).alias("s")).select("key", "s.run_id", "s.p")
    return latest.orderBy("p", "run_id").limit(50).withColumn("place", F.rank().over(W.orderBy("p", "run_id")))  # ranks the 50 reported


@query("agg_decision_audit", """SELECT kind, count(*) AS n, count_if(yards > 10 AND is_pass = 1)::BIGINT AS agree_pass, count_if(yards <= 10 AND is_pass = 0)::BIGINT AS agree_run, sum(CASE WHEN (yards > 10) <> (is_pass = 1) THEN abs(epa) ELSE 0 END) AS lost FROM plays GROUP BY kind""", "lost")
def agg_decision_audit(t):
    deep, passed = F.col("yards") > 10, F.col("is_pass") == 1
    return t.plays.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(deep & passed).alias("agree_pass"), F.count_if(~deep & ~passed).alias("agree_run"), F.sum(F.when(deep != passed, F.abs("epa")).otherwise(0.0)).alias("lost"))


@query("agg_decision_team_table", """WITH g AS (SELECT off, count(DISTINCT game_id) AS games FROM plays GROUP BY off) SELECT off, count(*) AS decisions, avg(CASE WHEN (yards > 10) = (is_pass = 1) THEN 1e0 ELSE 0e0 END) AS agree, sum(CASE WHEN (yards > 10) <> (is_pass = 1) THEN abs(epa) ELSE 0 END) / max(games) AS lost_per_game FROM plays JOIN g USING (off) WHERE down = 4 GROUP BY off""", "agree lost_per_game")
def agg_decision_team_table(t):
    games = t.plays.groupBy("off").agg(F.count_distinct("game_id").alias("games"))
    same = (F.col("yards") > 10) == (F.col("is_pass") == 1)
    d = t.plays.where("down = 4").groupBy("off").agg(F.count("*").alias("decisions"), F.avg(same.cast("double")).alias("agree"), F.sum(F.when(~same, F.abs("epa")).otherwise(0.0)).alias("lost"))
    return d.join(games, "off").select("off", "decisions", "agree", (F.col("lost") / F.col("games")).alias("lost_per_game"))


TOGO = "CASE WHEN togo >= 15 THEN 3 WHEN togo >= 8 THEN 2 WHEN togo >= 4 THEN 1 ELSE 0 END"


@query("agg_run_share", f"SELECT b.bucket, coalesce(avg(1 - is_pass), 0.5e0) AS share FROM (SELECT unnest(range(0, 6))::INT AS bucket) b LEFT JOIN plays ON {TOGO} = b.bucket GROUP BY b.bucket", "share")
def agg_run_share(t):
    rows = t.plays.groupBy(A.bucket(F.col("togo"), [4, 8, 15]).alias("bucket")).agg(F.avg(1 - F.col("is_pass")).alias("share"))
    return t.spark.range(6).select(F.col("id").cast("int").alias("bucket")).join(rows, "bucket", "left").select("bucket", F.coalesce("share", F.lit(0.5)).alias("share"))


@query("agg_hier_share", f"""WITH r AS (SELECT {TOGO} AS bucket, {BAND} AS zone, success AS v FROM plays), o AS (SELECT avg(v) AS m FROM r), b AS (SELECT bucket, (sum(v) + 50 * max(m)) / (count(*) + 50) AS rate FROM r, o GROUP BY bucket)
SELECT r.bucket, r.zone, count(*) AS n, (sum(v) + 50 * max(rate)) / (count(*) + 50) AS rate FROM r JOIN b USING (bucket) GROUP BY r.bucket, r.zone""", "rate")
def agg_hier_share(t):
    r = t.plays.withColumns({"bucket": A.bucket(F.col("togo"), [4, 8, 15]), "zone": A.bucket(F.col("yardline"), [20, 40, 60])})
    return A.hierarchical_rate(r, ["bucket", "zone"], "success", 50.0)


@query("agg_hier_distribution", f"""WITH r AS (SELECT {TOGO} AS bucket, down, kind FROM plays), k AS (SELECT DISTINCT kind FROM r), o AS (SELECT kind, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY kind),
b AS (SELECT c.bucket, k.kind, (coalesce(x.n, 0) + 30 * o.share) / (c.n + 30) AS share FROM (SELECT bucket, count(*) AS n FROM r GROUP BY 1) c CROSS JOIN k JOIN o USING (kind) LEFT JOIN (SELECT bucket, kind, count(*) AS n FROM r GROUP BY ALL) x ON x.bucket = c.bucket AND x.kind = k.kind)
SELECT c.bucket, c.down, k.kind, (coalesce(x.n, 0) + 30 * b.share) / (c.n + 30) AS share FROM (SELECT bucket, down, count(*) AS n FROM r GROUP BY ALL) c CROSS JOIN k JOIN b ON b.bucket = c.bucket AND b.kind = k.kind LEFT JOIN (SELECT bucket, down, kind, count(*) AS n FROM r GROUP BY ALL) x ON x.bucket = c.bucket AND x.down = c.down AND x.kind = k.kind""", "share")
def agg_hier_distribution(t):
    return A.hierarchical_distribution(t.plays.withColumn("bucket", A.bucket(F.col("togo"), [4, 8, 15])), ["bucket", "down"], "kind", 30.0)


@query("agg_spot_distribution", """WITH r AS (SELECT CAST(floor(yardline / 5) AS INT) AS spot, kind FROM plays), k AS (SELECT kind, count(*) / (SELECT count(*) FROM r) AS o FROM r GROUP BY kind), s AS (SELECT spot, count(*) AS n FROM r GROUP BY spot)
SELECT s.spot, k.kind, (coalesce(x.n, 0) + 25 * o) / (s.n + 25) AS share FROM s CROSS JOIN k LEFT JOIN (SELECT spot, kind, count(*) AS n FROM r GROUP BY ALL) x ON x.spot = s.spot AND x.kind = k.kind""", "share")
def agg_spot_distribution(t):
    return A.hierarchical_distribution(t.plays.withColumn("spot", F.floor(F.col("yardline") / 5).cast("int")), ["spot"], "kind", 25.0)


@query("agg_expected_by_spot", """WITH b AS (SELECT CAST(floor(yardline / 2) AS INT) AS x, CASE WHEN floor(yardline / 2) % 5 <> 3 THEN avg(yards) END AS v FROM plays GROUP BY floor(yardline / 2)),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER a AS x0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER z AS x1, first_value(v IGNORE NULLS) OVER z AS v1 FROM b
WINDOW a AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT x, coalesce(v, v0 + (x - x0) / CAST(x1 - x0 AS DOUBLE) * (v1 - v0), v0, v1) AS v FROM w""", "v")
def agg_expected_by_spot(t):
    b = t.plays.groupBy(F.floor(F.col("yardline") / 2).cast("int").alias("x")).agg(F.avg("yards").alias("v"))
    return A.interpolate(b.withColumn("v", F.when(F.col("x") % 5 != 3, F.col("v"))), "x", "v")


@query("agg_class_values", "SELECT k.c, coalesce(avg(yards), k.c * 10 + 5e0) AS value FROM (SELECT unnest(range(-2, 6))::INT AS c) k LEFT JOIN plays ON CAST(floor(yards / 10) AS INT) = k.c GROUP BY k.c", "value")
def agg_class_values(t):
    v = t.plays.groupBy(F.floor(F.col("yards") / 10).cast("int").alias("c")).agg(F.avg("yards").alias("v"))
    return t.spark.range(-2, 6).select(F.col("id").cast("int").alias("c")).join(v, "c", "left").select("c", F.coalesce("v", F.col("c") * 10 + 5.0).alias("value"))


@query("agg_median_durations", "WITH o AS (SELECT median(secs) AS m FROM plays) SELECT kind, down, CASE WHEN count(*) >= 50 THEN median(secs) ELSE max(m) END AS seconds FROM plays, o GROUP BY ALL", "seconds")
def agg_median_durations(t):
    overall = t.plays.agg(F.median("secs").alias("m"))
    by = t.plays.groupBy("kind", "down").agg(F.count("*").alias("n"), F.median("secs").alias("v"))
    return by.join(F.broadcast(overall)).select("kind", "down", F.when(F.col("n") >= 50, F.col("v")).otherwise(F.col("m")).alias("seconds"))


@query("agg_kickoff_running_mean", """WITH w AS (SELECT season, week, sum(yards) AS s, count(*) AS n FROM plays GROUP BY ALL), r AS (SELECT season, week, sum(s) OVER x AS s, coalesce(sum(n) OVER x, 0) AS n FROM w WINDOW x AS (PARTITION BY season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), l AS (SELECT season + 1 AS season, avg(yards) AS last FROM plays GROUP BY season)
SELECT r.season, week, CASE WHEN n >= 200 THEN s / n ELSE last END AS mean FROM r LEFT JOIN l ON l.season = r.season""", "mean")
def agg_kickoff_running_mean(t):
    b = asof.period_sums_before(t.plays.withColumn("one", F.lit(1)), ["season"], "week", ["yards", "one"])
    last = t.plays.groupBy((F.col("season") + 1).alias("season")).agg(F.avg("yards").alias("last"))
    return b.join(F.broadcast(last), "season", "left").select("season", "week", F.when(F.col("one_before") >= 200, F.col("yards_before") / F.col("one_before")).otherwise(F.col("last")).alias("mean"))


@query("agg_tendencies", """WITH l AS (SELECT avg(is_pass) AS league FROM plays), s AS (SELECT off, season, sum(is_pass) AS p, count(*) AS n FROM plays GROUP BY ALL), w AS (SELECT off, season, week, sum(is_pass) AS p, count(*) AS n FROM plays GROUP BY ALL),
c AS (SELECT off, season, week, coalesce(sum(p) OVER x, 0) AS p, coalesce(sum(n) OVER x, 0) AS n FROM w WINDOW x AS (PARTITION BY off, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT c.off, c.season, week, (c.p + 20 * (coalesce(s.p, 0) + 40 * league) / (coalesce(s.n, 0) + 40)) / (c.n + 20) AS share FROM c CROSS JOIN l LEFT JOIN s ON s.off = c.off AND s.season = c.season - 1""", "share")
def agg_tendencies(t):
    rows = t.plays.withColumn("one", F.lit(1))
    cur = asof.period_sums_before(rows, ["off", "season"], "week", ["is_pass", "one"])
    last = rows.groupBy("off", (F.col("season") + 1).alias("season")).agg(F.sum("is_pass").alias("p"), F.sum("one").alias("n"))
    league = rows.agg(F.avg("is_pass").alias("league"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = cur.join(last, ["off", "season"], "left").join(F.broadcast(league))
    return out.select("off", "season", "week", A.shrunk(F.col("is_pass_before"), F.col("one_before"), 20.0, A.shrunk(zero("p"), zero("n"), 40.0, F.col("league"))).alias("share"))


@query("agg_policy_cells", f"""WITH r AS (SELECT {TOGO} AS cell, down, is_pass, epa FROM plays WHERE down <= 2), a AS (SELECT cell, unnest([0e0, 1e0]) AS act, is_pass, epa FROM r), m AS (SELECT cell, is_pass AS act, avg(epa) AS mu FROM r GROUP BY ALL), e AS (SELECT cell, avg(is_pass) AS e FROM r GROUP BY cell)
SELECT a.cell, a.act, count(*) AS n, avg(mu + CASE WHEN is_pass = a.act THEN (epa - mu) / CASE WHEN a.act = 1 THEN e ELSE 1 - e END ELSE 0 END) AS dr, avg(epa) AS observed, avg(mu + CASE WHEN is_pass = a.act THEN (epa - mu) / CASE WHEN a.act = 1 THEN e ELSE 1 - e END ELSE 0 END) - avg(epa) AS gain FROM a JOIN m ON m.cell = a.cell AND m.act = a.act JOIN e ON e.cell = a.cell GROUP BY ALL""", "act dr observed gain")
def agg_policy_cells(t):
    r = t.plays.where("down <= 2").withColumn("cell", A.bucket(F.col("togo"), [4, 8, 15])).select("cell", "is_pass", "epa")
    mu = r.groupBy("cell", F.col("is_pass").alias("act")).agg(F.avg("epa").alias("mu"))
    e = r.groupBy("cell").agg(F.avg("is_pass").alias("e"))
    a = r.withColumn("act", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).join(F.broadcast(mu), ["cell", "act"]).join(F.broadcast(e), "cell")  # a row for each cell
    prop = F.when(F.col("act") == 1, F.col("e")).otherwise(1 - F.col("e"))
    dr = F.col("mu") + F.when(F.col("is_pass") == F.col("act"), (F.col("epa") - F.col("mu")) / prop).otherwise(0.0)
    return a.groupBy("cell", "act").agg(F.count("*").alias("n"), F.avg(dr).alias("dr"), F.avg("epa").alias("observed")).withColumn("gain", F.col("dr") - F.col("observed"))


@query("agg_overlap", "SELECT avg(CASE WHEN (wp >= 0.2)::INT + (1 - wp >= 0.2)::INT + (tax >= 0.02)::INT >= 2 THEN 1e0 ELSE 0e0 END) AS overlap, avg((wp >= 0.2)::INT + (1 - wp >= 0.2)::INT + (tax >= 0.02)::INT) AS eligible FROM plays", "overlap eligible")
def agg_overlap(t):
    n = F.size(F.filter(F.array(F.col("wp") >= 0.2, 1 - F.col("wp") >= 0.2, F.col("tax") >= 0.02), lambda x: x))
    return t.plays.agg(F.avg((n >= 2).cast("double")).alias("overlap"), F.avg(n).alias("eligible"))


@query("agg_standings", f"""WITH {SIDES}, r AS (SELECT s.*, a.division AS d, b.division AS d_opp FROM sides s JOIN teams a ON a.team = s.team JOIN teams b ON b.team = s.opp),
b AS (SELECT season, team, count(*) AS games, sum(result) AS points_won, avg(result) AS pct, avg(result) FILTER (WHERE d = d_opp) AS group_pct, sum(points)::BIGINT AS scored, sum(points_opp)::BIGINT AS allowed FROM r GROUP BY ALL),
x AS (SELECT r.season, r.team, sum(o.points_won) / sum(o.games) AS sos, sum(o.points_won) FILTER (WHERE result = 1) / sum(o.games) FILTER (WHERE result = 1) AS sov FROM r JOIN b o ON o.season = r.season AND o.team = r.opp GROUP BY ALL)
SELECT b.*, sos, sov, scored - allowed AS net FROM b JOIN x USING (season, team)""", "points_won pct group_pct sos sov")
def agg_standings(t):
    return contests.standings(sides(t), ["season"], t.teams)


TIED = "g AS (SELECT season, team, division AS tie_group FROM teams CROSS JOIN (SELECT DISTINCT season FROM games))"


def tied(t: Tables):
    return t.games.select("season").distinct().join(F.broadcast(t.teams.select("team", F.col("division").alias("tie_group"))))


@query("agg_head_to_head", f"""WITH {SIDES}, {TIED}, n AS (SELECT season, tie_group, count(*) AS size FROM g GROUP BY ALL), h AS (SELECT s.season, a.tie_group, s.team, count(*) AS h2h_games, avg(result) AS h2h_pct, count(DISTINCT s.opp) AS met, min(result) AS lo, max(result) AS hi FROM sides s JOIN g a ON a.season = s.season AND a.team = s.team JOIN g b ON b.season = s.season AND b.team = s.opp WHERE a.tie_group = b.tie_group GROUP BY ALL)
SELECT season, tie_group, team, h2h_games, h2h_pct, CASE WHEN met = size - 1 AND lo = 1 THEN 1 WHEN met = size - 1 AND hi = 0 THEN -1 ELSE 0 END AS sweep FROM h JOIN n USING (season, tie_group)""", "h2h_pct")
def agg_head_to_head(t):
    return contests.head_to_head(sides(t), tied(t), ["season"])


@query("agg_season_outcomes", f"""WITH {SIDES}, s AS (SELECT season, team, avg(result) AS pct, sum(points - points_opp) AS net FROM sides GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY pct DESC, net DESC) AS k FROM s JOIN teams USING (team)), d AS (SELECT *, row_number() OVER (PARTITION BY season, division ORDER BY pct DESC, net DESC, team) AS g FROM r)
SELECT season, team, k <= 8 AS qualified, g = 1 AS won_group, k = 1 AS top FROM d""")
def agg_season_outcomes(t):
    s = sides(t).groupBy("season", "team").agg(F.avg("result").alias("pct"), F.sum(F.col("points") - F.col("points_opp")).alias("net")).join(F.broadcast(t.teams), "team")
    k = F.rank().over(W.partitionBy("season").orderBy(F.desc("pct"), F.desc("net")))
    g = F.row_number().over(W.partitionBy("season", "division").orderBy(F.desc("pct"), F.desc("net"), "team"))
    return s.select("season", "team", (k <= 8).alias("qualified"), (g == 1).alias("won_group"), (k == 1).alias("top"))


@query("agg_current_ratings", f"""WITH {SIDES}, r AS (SELECT s.team, s.prob, g.kickoff, s.game_id FROM sides s JOIN games g USING (game_id)), n AS (SELECT max(kickoff) AS t FROM r), x AS (SELECT team, max_by(prob, {{'a': kickoff, 'b': game_id}}) AS now, max_by(prob, {{'a': kickoff, 'b': game_id}}) FILTER (WHERE kickoff <= t - INTERVAL 7 DAY) AS before FROM r, n GROUP BY team)
SELECT team, now, before, rank() OVER (ORDER BY now DESC)::INT AS place, rank() OVER (ORDER BY before DESC)::INT AS place_before FROM x""", "now before")
def agg_current_ratings(t):
    r = contests.unpivot_sides(t.games, ["game_id", "kickoff"], flipped={"prob": "p"})
    last = t.games.agg(F.max("kickoff").alias("t"))
    at = F.struct("kickoff", "game_id")
    old = F.col("kickoff") <= F.col("t") - F.expr("INTERVAL 7 DAYS")
    x = r.join(F.broadcast(last)).groupBy("team").agg(F.max_by("prob", at).alias("now"), F.max_by(F.when(old, F.col("prob")), F.when(old, at)).alias("before"))
    return x.withColumns({"place": F.rank().over(W.orderBy(F.desc("now"))), "place_before": F.rank().over(W.orderBy(F.desc("before")))})  # ranks the teams


@query("agg_year_to_year", "WITH s AS (SELECT passer, season, avg(epa) AS r, count(*) AS n FROM plays GROUP BY ALL) SELECT a.season, corr(a.r, b.r) AS c, count(*) AS n FROM s a JOIN s b ON b.passer = a.passer AND b.season = a.season + 1 WHERE a.n >= 20 AND b.n >= 20 GROUP BY a.season", "c")
def agg_year_to_year(t):
    s = t.plays.groupBy("passer", "season").agg(F.avg("epa").alias("r"), F.count("*").alias("n")).where("n >= 20")
    nxt = s.select("passer", (F.col("season") - 1).alias("season"), F.col("r").alias("r1"))
    return s.join(nxt, ["passer", "season"]).groupBy("season").agg(F.corr("r", "r1").alias("c"), F.count("*").alias("n"))


@query("agg_prior_movement", """WITH l AS (SELECT kind, avg(epa) AS prior FROM plays GROUP BY kind), p AS (SELECT kind, player, (sum(epa) + 5 * max(prior)) / (count(*) + 5) AS v, max(prior) AS prior FROM plays JOIN l USING (kind) GROUP BY ALL)
SELECT kind, avg(abs(v - prior)) AS moved, stddev_samp(v) AS sd FROM p GROUP BY kind""", "moved sd")
def agg_prior_movement(t):
    prior = t.plays.groupBy("kind").agg(F.avg("epa").alias("prior"))
    p = t.plays.groupBy("kind", "player").agg(F.sum("epa").alias("s"), F.count("*").alias("n")).join(F.broadcast(prior), "kind").withColumn("v", A.shrunk(F.col("s"), F.col("n"), 5.0, F.col("prior")))
    return p.groupBy("kind").agg(F.avg(F.abs(F.col("v") - F.col("prior"))).alias("moved"), F.stddev_samp("v").alias("sd"))


@query("agg_game_excitement", """WITH d AS (SELECT game_id, play_id, wp, wp - lag(wp) OVER (PARTITION BY game_id ORDER BY play_id, wp) AS d FROM plays) SELECT game_id, coalesce(sum(abs(d)), 0) AS excitement, max_by(play_id, {'a': round(coalesce(abs(d), 0), 9), 'b': -play_id}) AS swing, min(wp) AS low FROM d GROUP BY game_id""", "excitement low")
def agg_game_excitement(t):
    d = t.plays.withColumn("d", F.abs(F.col("wp") - F.lag("wp").over(W.partitionBy("game_id").orderBy("play_id", "wp"))))
    return d.groupBy("game_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("excitement"), F.max_by("play_id", F.struct(F.round(F.coalesce("d", F.lit(0.0)), 9), -F.col("play_id"))).alias("swing"), F.min("wp").alias("low"))


@query("agg_bucket_coefs", "SELECT CASE WHEN week >= 40 THEN 3 WHEN week >= 20 THEN 2 WHEN week >= 10 THEN 1 ELSE 0 END AS phase, count(*) AS n, regr_slope(y, p) AS slope, regr_intercept(y, p) AS intercept FROM games GROUP BY 1", "slope intercept")
def agg_bucket_coefs(t):
    return t.games.groupBy(A.bucket(F.col("week"), [10, 20, 40]).alias("phase")).agg(F.count("*").alias("n"), F.regr_slope("y", "p").alias("slope"), F.regr_intercept("y", "p").alias("intercept"))


@query("agg_forecast_panel", """WITH l AS (SELECT 'p' AS model, game_type, y, p AS v FROM games UNION ALL SELECT 'q', game_type, y, q FROM games UNION ALL SELECT 'm', game_type, y, m FROM games)
SELECT model, coalesce(game_type, 'ALL') AS part, count(v) AS n, avg(pow(v - y, 2)) AS brier, avg(y - v) AS bias FROM l GROUP BY GROUPING SETS ((model), (model, game_type))""", "brier bias")
def agg_forecast_panel(t):
    long = scoring.melt(t.games, ["game_type", "y"], {"p": "p", "q": "q", "m": "m"}, "v")
    parts = long.withColumn("part", F.explode(F.array(F.lit("ALL"), F.col("game_type"))))
    return parts.groupBy("model", "part").agg(F.count("v").alias("n"), F.avg(scoring.brier("y", "v")).alias("brier"), F.avg(F.col("y") - F.col("v")).alias("bias"))


@query("agg_rate_by_band", f"SELECT {BAND} AS band, count(*) AS n, avg(wp) AS predicted, avg(success) AS observed FROM plays GROUP BY 1", "predicted observed")
def agg_rate_by_band(t):
    return t.plays.groupBy(A.bucket(F.col("yardline"), [20, 40, 60]).alias("band")).agg(F.count("*").alias("n"), F.avg("wp").alias("predicted"), F.avg("success").alias("observed"))


@query("agg_distribution_panel", f"""WITH l AS (SELECT 'p' AS model, season, y, p AS v FROM games UNION ALL SELECT 'q', season, y, q FROM games), s AS (SELECT model, season, avg({LOSS.format(p='v')}) AS loss, count(*) AS n FROM l GROUP BY ALL)
SELECT season, min_by(model, {{'a': loss, 'b': model}}) AS best, min(loss) AS loss FROM s GROUP BY season""", "loss")
def agg_distribution_panel(t):
    long = scoring.melt(t.games, ["season", "y"], {"p": "p", "q": "q"}, "v")
    s = scoring.scores(long, "y", "v", ["model", "season"], ["logloss"]).withColumnRenamed("logloss", "loss")
    return scoring.best_of(s, "loss", ["model"], ["season"]).withColumnRenamed("model", "best")


@query("agg_margin_panel", """SELECT CASE WHEN spread >= 3 THEN 2 WHEN spread >= -3 THEN 1 ELSE 0 END AS bin, count(*) AS n, avg(abs(home_score - away_score - spread)) AS mae_spread, avg(abs(home_score - away_score - (p * 28 - 14))) AS mae_model, avg(CASE WHEN home_score - away_score > spread THEN 1e0 ELSE 0e0 END) AS cover, 1.96e0 * sqrt(0.25e0 / count(*)) AS band FROM games GROUP BY 1""", "mae_spread mae_model cover band")
def agg_margin_panel(t):
    m = F.col("home_score") - F.col("away_score")
    return t.games.groupBy(A.bucket(F.col("spread"), [-3, 3]).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.abs(m - F.col("spread"))).alias("mae_spread"), F.avg(F.abs(m - (F.col("p") * 28 - 14))).alias("mae_model"), F.avg((m > F.col("spread")).cast("double")).alias("cover"), (1.96 * F.sqrt(0.25 / F.count("*"))).alias("band"))


@query("agg_mix_diagnosis", f"SELECT coalesce(CAST({TOGO} AS VARCHAR), 'ALL') AS dist, coalesce(CAST({BAND} AS VARCHAR), 'ALL') AS zone, count(*) AS n, avg(is_pass) AS actual, avg(wp) AS engine FROM plays GROUP BY CUBE ({TOGO}, {BAND})", "actual engine")
def agg_mix_diagnosis(t):
    r = t.plays.select(A.bucket(F.col("togo"), [4, 8, 15]).cast("string").alias("dist"), A.bucket(F.col("yardline"), [20, 40, 60]).cast("string").alias("zone"), "is_pass", "wp")
    return r.cube("dist", "zone").agg(F.count("*").alias("n"), F.avg("is_pass").alias("actual"), F.avg("wp").alias("engine")).select(F.coalesce("dist", F.lit("ALL")).alias("dist"), F.coalesce("zone", F.lit("ALL")).alias("zone"), "n", "actual", "engine")


@query("agg_action_share_baseline", f"WITH c AS (SELECT {TOGO} AS cell, count_if(kind = 'A')::BIGINT AS a, count_if(kind = 'N')::BIGINT AS n, count_if(kind = 'R')::BIGINT AS r FROM plays GROUP BY 1) SELECT cell, (a + 0.5e0) / (a + n + r + 1.5e0) AS a, (n + 0.5e0) / (a + n + r + 1.5e0) AS n, (r + 0.5e0) / (a + n + r + 1.5e0) AS r FROM c", "a n r")
def agg_action_share_baseline(t):
    c = t.plays.groupBy(A.bucket(F.col("togo"), [4, 8, 15]).alias("cell")).pivot("kind", ["A", "N", "R"]).count().na.fill(0)
    total = F.col("A") + F.col("N") + F.col("R") + 1.5
    return c.select("cell", *[((F.col(k) + 0.5) / total).alias(k.lower()) for k in ("A", "N", "R")])


@query("agg_policy_summary", "SELECT avg(CASE WHEN wp > 0.4 THEN 1e0 ELSE 0e0 END) AS applies, avg(CASE WHEN wp > 0.4 AND is_pass = 0 THEN 1e0 ELSE 0e0 END) AS changes, sum(CASE WHEN wp > 0.4 AND is_pass = 0 THEN 0.1e0 - epa ELSE 0 END) / count(*) AS gain, avg(CASE WHEN wp > 0.4 AND is_pass = 0 THEN 0.1e0 - epa END) AS gain_affected FROM plays", "applies changes gain gain_affected")
def agg_policy_summary(t):
    on = F.col("wp") > 0.4
    change, gain = on & (F.col("is_pass") == 0), 0.1 - F.col("epa")
    return t.plays.agg(F.avg(on.cast("double")).alias("applies"), F.avg(change.cast("double")).alias("changes"), F.avg(F.when(change, gain).otherwise(0.0)).alias("gain"), F.avg(F.when(change, gain)).alias("gain_affected"))


@query("agg_entity_vs_league", f"SELECT {TOGO} AS cell, avg(is_pass) FILTER (WHERE off = 3) AS own, avg(is_pass) AS league, avg(epa) FILTER (WHERE off = 3) AS own_value, avg(epa) AS league_value FROM plays GROUP BY 1", "own league own_value league_value")
def agg_entity_vs_league(t):
    mine = lambda c: F.avg(F.when(F.col("off") == 3, F.col(c)))
    return t.plays.groupBy(A.bucket(F.col("togo"), [4, 8, 15]).alias("cell")).agg(mine("is_pass").alias("own"), F.avg("is_pass").alias("league"), mine("epa").alias("own_value"), F.avg("epa").alias("league_value"))


@query("agg_snap_bins", """WITH s AS (SELECT player, count(*) AS n, avg(epa) AS v FROM plays GROUP BY player) SELECT CASE WHEN n >= 170 THEN 3 WHEN n >= 150 THEN 2 WHEN n >= 20 THEN 1 ELSE 0 END AS bin, count(*) AS players, avg(v) AS value, stddev_samp(v) AS sd FROM s GROUP BY 1""", "value sd")
def agg_snap_bins(t):
    s = t.plays.groupBy("player").agg(F.count("*").alias("n"), F.avg("epa").alias("v"))
    return s.groupBy(A.bucket(F.col("n"), [20, 150, 170]).alias("bin")).agg(F.count("*").alias("players"), F.avg("v").alias("value"), F.stddev_samp("v").alias("sd"))


@query("agg_coverage_scale", "WITH g AS (SELECT game_id, off, sum(wp) AS s, avg(success) AS c FROM plays GROUP BY ALL) SELECT game_id, off, CASE WHEN c > 0 THEN s / c * 5 / 11 ELSE s END AS scaled FROM g", "scaled")
def agg_coverage_scale(t):
    g = t.plays.groupBy("game_id", "off").agg(F.sum("wp").alias("s"), F.avg("success").alias("c"))
    return g.select("game_id", "off", F.when(F.col("c") > 0, F.col("s") / F.col("c") * 5 / 11).otherwise(F.col("s")).alias("scaled"))


@query("agg_grid_search", """WITH k AS (SELECT unnest([1, 5, 25, 125]) AS k), l AS (SELECT avg(epa) AS m FROM plays), p AS (SELECT kind, player, sum(epa) FILTER (WHERE game_id % 2 = 0) AS s, count(*) FILTER (WHERE game_id % 2 = 0) AS n, avg(epa) FILTER (WHERE game_id % 2 = 1) AS t FROM plays GROUP BY ALL),
e AS (SELECT kind, k, avg(pow(t - (coalesce(s, 0) + k * m) / (n + k), 2)) AS mse FROM p, k, l WHERE t IS NOT NULL GROUP BY ALL)
SELECT kind, min_by(k, {'a': mse, 'b': k}) AS k, min(mse) AS mse FROM e GROUP BY kind""", "mse")
def agg_grid_search(t):
    early = F.col("game_id") % 2 == 0
    p = t.plays.groupBy("kind", "player").agg(F.coalesce(F.sum(F.when(early, F.col("epa"))), F.lit(0.0)).alias("s"), F.count_if(early).alias("n"), F.avg(F.when(~early, F.col("epa"))).alias("t")).where("t IS NOT NULL")
    grid = p.join(F.broadcast(t.plays.agg(F.avg("epa").alias("m")))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 25, 125)])))
    err = F.pow(F.col("t") - (F.col("s") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k")), 2)
    return scoring.best_of(grid.groupBy("kind", "k").agg(F.avg(err).alias("mse")), "mse", ["k"], ["kind"])


@query("agg_decision_chart", f"""WITH v AS (SELECT {TOGO} AS bucket, avg(success) AS s, avg(epa) AS e FROM plays GROUP BY 1), g AS (SELECT yl, tg FROM (SELECT unnest(range(10, 100, 10)) AS yl), (SELECT unnest(range(1, 16)) AS tg))
SELECT yl, tg, s * (100 - yl) / 10e0 + e - 0.1e0 * tg AS go, 3 * (1 - yl / 100e0) AS kick FROM g JOIN v ON v.bucket = CASE WHEN tg >= 15 THEN 3 WHEN tg >= 8 THEN 2 WHEN tg >= 4 THEN 1 ELSE 0 END""", "go kick")
def agg_decision_chart(t):
    v = t.plays.groupBy(A.bucket(F.col("togo"), [4, 8, 15]).alias("bucket")).agg(F.avg("success").alias("s"), F.avg("epa").alias("e"))
    grid = t.spark.range(10, 100, 10).select(F.col("id").alias("yl"), F.explode(F.sequence(F.lit(1), F.lit(15))).alias("tg"))
    g = grid.withColumn("bucket", A.bucket(F.col("tg"), [4, 8, 15])).join(F.broadcast(v), "bucket")
    return g.select("yl", F.col("tg").cast("long").alias("tg"), (F.col("s") * (100 - F.col("yl")) / 10 + F.col("e") - 0.1 * F.col("tg")).alias("go"), (3 * (1 - F.col("yl") / 100)).alias("kick"))


@query("agg_partial_season", "SELECT season, bool_or(m IS NULL) AS partial FROM games GROUP BY season")
def agg_partial_season(t):
    return t.games.groupBy("season").agg(F.bool_or(F.col("m").isNull()).alias("partial"))


@query("agg_first_per_entity", "SELECT home AS team, min_by(p, {'a': kickoff, 'b': game_id}) AS first FROM games WHERE kickoff >= TIMESTAMP '1996-06-01' GROUP BY home", "first")
def agg_first_per_entity(t):
    return t.games.where("kickoff >= TIMESTAMP '1996-06-01'").groupBy(F.col("home").alias("team")).agg(F.min_by("p", F.struct("kickoff", "game_id")).alias("first"))


@query("agg_strength", "WITH a AS (SELECT off AS team, avg(epa) AS o FROM plays GROUP BY 1), b AS (SELECT def AS team, avg(epa) AS d FROM plays GROUP BY 1) SELECT team, 10 * o - 8 * d + 0.5e0 * division AS strength FROM a JOIN b USING (team) JOIN teams USING (team)", "strength")
def agg_strength(t):
    o, d = (t.plays.groupBy(F.col(c).alias("team")).agg(F.avg("epa").alias(n)) for c, n in (("off", "o"), ("def", "d")))
    return o.join(d, "team").join(t.teams, "team").select("team", (10 * F.col("o") - 8 * F.col("d") + 0.5 * F.col("division")).alias("strength"))


@query("agg_split_scores", """WITH s AS (SELECT y, p, unnest(list_filter(['all', CASE WHEN week <= 8 THEN 'early' END, CASE WHEN neutral THEN 'neutral' END, CASE WHEN season = 1996 THEN 's1996' END], lambda x: x IS NOT NULL)) AS split FROM games) SELECT split, count(*) AS n, avg(pow(p - y, 2)) AS brier FROM s GROUP BY split""", "brier")
def agg_split_scores(t):
    masks = {"all": F.lit(True), "early": F.col("week") <= 8, "neutral": F.col("neutral"), "s1996": F.col("season") == 1996}
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))
    return scoring.scores(t.games.select("y", "p", F.explode(names).alias("split")), "y", "p", ["split"], ["brier"])


@query("agg_blend_target", "SELECT game_id, CASE WHEN m IS NOT NULL THEN 0.7e0 * p + 0.3e0 * m END AS target FROM games", "target")
def agg_blend_target(t):
    return t.games.select("game_id", (0.7 * F.col("p") + 0.3 * F.col("m")).alias("target"))


@query("agg_expected_vs_actual_share", "SELECT kind, avg(wp) AS predicted, avg(success) AS actual, corr(wp, success) AS c FROM plays WHERE down = 1 GROUP BY kind", "predicted actual c")
def agg_expected_vs_actual_share(t):
    return t.plays.where("down = 1").groupBy("kind").agg(F.avg("wp").alias("predicted"), F.avg("success").alias("actual"), F.corr("wp", "success").alias("c"))


@query("agg_per_season_window", "SELECT coalesce(CAST(season AS VARCHAR), 'ALL') AS season, count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(y - p) AS bias FROM games GROUP BY ROLLUP (season)", "brier bias")
def agg_per_season_window(t):
    return A.with_total(t.games, ["season"], [F.count("*").alias("n"), F.avg(scoring.brier("y", "p")).alias("brier"), F.avg(F.col("y") - F.col("p")).alias("bias")])
