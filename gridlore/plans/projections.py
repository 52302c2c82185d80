"""Queries of projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import aggregates as A
from gridlore.operators import asof, contests
from gridlore.operators import quality as Q
from gridlore.plans.aggregations import SIDES, sides
from gridlore.plans.joins import TS, stamp
from gridlore.registry import query


@query("drop_banned_columns", "SELECT game_id, season, week, home, away, home_score, away_score, neutral, game_type, y, p, q FROM games", "y p q")
def drop_banned_columns(t):
    return Q.drop_banned(t.games, r"^m$|spread|moneyline|kickoff|game_date")


@query("clean_events", "SELECT game_id, play_id, player, epa FROM plays WHERE kind IN ('A', 'R') AND epa IS NOT NULL AND NOT coalesce(wp < 0.1 OR wp > 0.9, false)", "epa")
def clean_events(t):
    garbage = F.coalesce((F.col("wp") < 0.1) | (F.col("wp") > 0.9), F.lit(False))
    return t.plays.where(F.col("kind").isin("A", "R") & F.col("epa").isNotNull() & ~garbage).select("game_id", "play_id", "player", "epa")


@query("select_window", "SELECT game_id FROM games WHERE season BETWEEN 1993 AND 1995 AND game_type = 'REG'")
def select_window(t):
    return window(t.games, 1993, 1995, ["REG"], locked=1998).select("game_id")


def window(df, first, last, types, locked, allow=False):
    """Rows of the seasons and types; a range that reaches the locked seasons is an error unless allowed."""
    if last >= locked and not allow:
        raise ValueError(f"seasons from {locked} on are locked")
    return df.where(F.col("season").between(first, last) & F.col("game_type").isin(*types))


@query("before_cutoff", "SELECT game_id FROM games WHERE kickoff < TIMESTAMP '1995-06-17'")
def before_cutoff(t):
    return t.games.where(F.col("kickoff") < F.lit("1995-06-17").cast("timestamp")).select("game_id")


@query("as_of_view", "SELECT game_id, CASE WHEN kickoff < TIMESTAMP '1996-06-01' THEN y END AS y, CASE WHEN kickoff < TIMESTAMP '1996-06-08' THEN spread END AS spread FROM games", "y spread")
def as_of_view(t):
    return asof.as_of_view(t.games, "kickoff", F.lit("1996-06-01").cast("timestamp"), ["y"], ["spread"]).select("game_id", "y", "spread")


@query("season_splits", "SELECT fold, CASE WHEN season < fold THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM games, (SELECT unnest([1995, 1996, 1997]) AS fold) WHERE season <= fold GROUP BY ALL")
def season_splits(t):
    folds = F.explode(F.filter(F.array(*[F.lit(s) for s in (1995, 1996, 1997)]), lambda f: f >= F.col("season")))
    rows = t.games.withColumn("fold", folds).withColumn("role", F.when(F.col("season") < F.col("fold"), "train").otherwise("test"))
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("sample_filter", "SELECT game_id, play_id, player FROM plays WHERE down IN (1, 2) AND secs > 120")
def sample_filter(t):
    return t.plays.where(F.col("down").isin(1, 2) & (F.col("secs") > 120)).select("game_id", "play_id", "player")


@query("state_rows", "SELECT l.game_id, l.play_id, l.player, CASE WHEN off % 2 = 0 THEN wp ELSE 1 - wp END AS own_wp, CASE WHEN off % 2 = 0 THEN 1 ELSE -1 END * (home_score - away_score) AS lead, CASE WHEN (home_score > away_score) = (off % 2 = 0) THEN 1 ELSE 0 END AS label FROM plays l JOIN games USING (game_id) WHERE home_score <> away_score", "own_wp")
def state_rows(t):
    mine = F.col("off") % 2 == 0
    j = t.plays.join(t.games.where("home_score <> away_score").select("game_id", "home_score", "away_score"), "game_id")
    return j.select("game_id", "play_id", "player", F.when(mine, F.col("wp")).otherwise(1 - F.col("wp")).alias("own_wp"), (F.when(mine, 1).otherwise(-1) * (F.col("home_score") - F.col("away_score"))).alias("lead"), ((F.col("home_score") > F.col("away_score")) == mine).cast("int").alias("label"))


CHOICE = "CASE WHEN is_pass = 1 AND yards >= 0 THEN 'go' WHEN yardline < 40 THEN 'kick' ELSE 'punt' END"


@query("decision_rows", f"SELECT game_id, play_id, player, {CHOICE} AS choice, yardline, togo, success FROM plays WHERE down = 4", "success")
def decision_rows(t):
    choice = F.when((F.col("is_pass") == 1) & (F.col("yards") >= 0), "go").when(F.col("yardline") < 40, "kick").otherwise("punt")
    return t.plays.where("down = 4").select("game_id", "play_id", "player", choice.alias("choice"), "yardline", "togo", "success")


@query("attempt_rows", "SELECT game_id, play_id, player, CASE WHEN togo >= 8 THEN 2 WHEN togo >= 4 THEN 1 ELSE 0 END AS bucket, success FROM plays WHERE down = 4 AND is_pass = 1 AND yards >= 0", "success")
def attempt_rows(t):
    return t.plays.where("down = 4 AND is_pass = 1 AND yards >= 0").select("game_id", "play_id", "player", A.bucket(F.col("togo"), [4, 8]).alias("bucket"), "success")


@query("kick_rows", "SELECT event_id, next_type FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) WHERE event_type = 'click'")
def kick_rows(t):
    from pyspark.sql import Window as W

    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("next_type", nxt).where("event_type = 'click'").select("event_id", "next_type")


@query("unplayed_rows", "SELECT game_id, week FROM games WHERE m IS NULL AND season = 1996 AND week = (SELECT min(week) FROM games WHERE m IS NULL AND season = 1996)")
def unplayed_rows(t):
    left = t.games.where("m IS NULL AND season = 1996")
    return left.join(F.broadcast(left.agg(F.min("week").alias("week"))), "week", "left_semi").select("game_id", "week")


@query("recent_results", f"WITH n AS (SELECT max(kickoff) AS t FROM games), l AS (SELECT home, max_by(p, {{'k': kickoff, 'g': game_id}}) AS last FROM games, n WHERE kickoff < t - INTERVAL 8 DAY GROUP BY home) SELECT game_id, strftime(kickoff, {TS}) AS at, last FROM games LEFT JOIN l USING (home), n WHERE kickoff >= t - INTERVAL 8 DAY", "last")
def recent_results(t):
    g = t.games.join(F.broadcast(t.games.agg(F.max("kickoff").alias("t"))))
    since = F.col("t") - F.expr("INTERVAL 8 DAYS")
    last = g.where(F.col("kickoff") < since).groupBy("home").agg(F.max_by("p", F.struct("kickoff", "game_id")).alias("last"))
    return g.where(F.col("kickoff") >= since).join(last, "home", "left").select("game_id", stamp("kickoff").alias("at"), "last")


@query("team_game_unpivot", f"WITH {SIDES} SELECT * FROM sides", "prob result")
def team_game_unpivot(t):
    return sides(t).select("season", "week", "game_id", "team", "opp", "is_home", "points", "points_opp", "prob", "result")


@query("timeline_to_games", "SELECT game_id, home AS home_team, away AS away_team, home_score AS home_points, away_score AS away_points FROM games")
def timeline_to_games(t):
    return contests.pair_sides(sides(t), ["game_id"], ["points"])


@query("outcome_label", "SELECT game_id, y AS result, home_score - away_score AS margin FROM games", "result")
def outcome_label(t):
    return t.games.select("game_id", contests.outcome("home_score", "away_score").alias("result"), (F.col("home_score") - F.col("away_score")).alias("margin"))


@query("expand_ties", "SELECT game_id, y, 1e0 AS weight FROM games WHERE y <> 0.5 UNION ALL SELECT game_id, unnest([0e0, 1e0]), 5e-1 FROM games WHERE y = 0.5", "y weight")
def expand_ties(t):
    return contests.expand_ties(t.games.select("game_id", "y"), "y")


@query("home_away_diff", "WITH r AS (SELECT game_id, off AS team, sum(success) AS v FROM plays GROUP BY ALL) SELECT g.game_id, coalesce(h.v, 0) - coalesce(a.v, 0) AS diff FROM games g LEFT JOIN r h ON h.game_id = g.game_id AND h.team = home LEFT JOIN r a ON a.game_id = g.game_id AND a.team = away", "diff")
def home_away_diff(t):
    r = t.plays.groupBy("game_id", F.col("off").alias("team")).agg(F.sum("success").alias("v"))
    return contests.side_difference(t.games, r, ["game_id"], "v", "diff", default=0.0).select("game_id", "diff")


@query("rest_and_neutral", "WITH s AS (SELECT game_id, home AS team, game_date FROM games UNION ALL SELECT game_id, away, game_date FROM games), r AS (SELECT game_id, team, coalesce(least(game_date - lag(game_date) OVER (PARTITION BY team ORDER BY game_date, game_id), 14), 7) AS rest FROM s) SELECT g.game_id, greatest(-7, least(7, h.rest - a.rest))::INT AS rest_diff, neutral::INT AS neutral FROM games g JOIN r h ON h.game_id = g.game_id AND h.team = home JOIN r a ON a.game_id = g.game_id AND a.team = away")
def rest_and_neutral(t):
    from pyspark.sql import Window as W

    s = contests.unpivot_sides(t.games, ["game_id", "game_date"])
    gap = F.datediff("game_date", F.lag("game_date").over(W.partitionBy("team").orderBy("game_date", "game_id")))
    rest = s.select("game_id", "team", F.coalesce(F.least(gap, F.lit(14)), F.lit(7)).alias("rest"))
    g = contests.side_difference(t.games, rest, ["game_id"], "rest", "d")
    return g.select("game_id", F.greatest(F.lit(-7), F.least(F.lit(7), F.col("d"))).alias("rest_diff"), F.col("neutral").cast("int").alias("neutral"))


@query("config_grid", "SELECT k, h, count(*) AS n, avg(pow(least(0.99e0, greatest(0.01e0, p + h / 100e0)) - y, 2)) * k AS score FROM games, (SELECT unnest([10, 20, 40]) AS k), (SELECT unnest([0, 1, 2, 3]) AS h) WHERE NOT (k = 40 AND h = 3) GROUP BY k, h", "score")
def config_grid(t):
    ks, hs = (F.explode(F.array(*[F.lit(x) for x in v])) for v in ((10, 20, 40), (0, 1, 2, 3)))
    grid = t.games.withColumn("k", ks).withColumn("h", hs).where("NOT (k = 40 AND h = 3)")
    q = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("p") + F.col("h") / 100.0))
    return grid.groupBy("k", "h").agg(F.count("*").alias("n"), (F.avg(F.pow(q - F.col("y"), 2)) * F.col("k")).alias("score"))
