"""Queries of the data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import aggregates as A
from gridlore.operators import asof, contests
from gridlore.operators import quality as Q
from gridlore.plans.aggregations import SIDES, sides
from gridlore.registry import query


@query("dq_required_columns", """SELECT * FROM (SELECT unnest([{'column': 'game_id', 'present': true, 'fits': true, 'filled': avg((game_id IS NOT NULL)::INT)}, {'column': 'm', 'present': true, 'fits': true, 'filled': avg((m IS NOT NULL)::INT)}, {'column': 'qb', 'present': false, 'fits': false, 'filled': NULL}], recursive := true) FROM games)""", "filled")
def dq_required_columns(t):
    return Q.column_report(t.games, {"game_id": "bigint", "m": "numeric", "qb": "string"})


@query("dq_events", """WITH k AS (SELECT season, game_id, count(*) AS n FROM plays GROUP BY ALL), c AS (SELECT season, off AS code FROM plays UNION SELECT season, def FROM plays)
SELECT season, unnest(['type:epa', 'type:kind', 'week', 'epa of plays', 'id prefix']) AS "check", unnest([0, count(*), count_if(NOT coalesce(week BETWEEN 1 AND 52, false)), count_if(NOT coalesce(kind = 'N' OR epa > 0, false)), count_if(NOT coalesce(starts_with(CAST(game_id AS VARCHAR), left(CAST(season AS VARCHAR), 1)), false))]) AS bad FROM plays GROUP BY season
UNION ALL SELECT season, 'rows', count_if(n NOT BETWEEN 2 AND 6) FROM k GROUP BY season UNION ALL SELECT season, 'codes', count_if(code NOT IN (SELECT team FROM teams WHERE division <> 0)) FROM c WHERE code IS NOT NULL GROUP BY season""")
def dq_events(t):
    checks = {"week": F.col("week").between(1, 52), "epa of plays": (F.col("kind") == "N") | (F.col("epa") > 0), "id prefix": F.col("game_id").cast("string").startswith(F.substring(F.col("season").cast("string"), 1, 1))}
    return Q.dataset_report(t.plays, ["season"], ["game_id"], (2, 6), ["epa", "kind"], checks, ["off", "def"], t.teams.where("division <> 0"), "team")


@query("dq_schedule", """WITH k AS (SELECT season, home, away, week, count(*) AS n FROM games GROUP BY ALL), c AS (SELECT season, home AS code FROM games UNION SELECT season, away FROM games)
SELECT season, unnest(['type:home_score', 'type:stadium', 'kickoff', 'two sides', 'price']) AS "check", unnest([0, count(*), count_if(kickoff IS NULL), count_if(NOT coalesce(home <> away, false)), count_if(m IS NULL)]) AS bad FROM games GROUP BY season
UNION ALL SELECT season, 'rows', count_if(n > 1) FROM k GROUP BY season UNION ALL SELECT season, 'codes', count_if(code NOT IN (SELECT team FROM teams WHERE division <> 1)) FROM c WHERE code IS NOT NULL GROUP BY season""")
def dq_schedule(t):
    checks = {"kickoff": F.col("kickoff").isNotNull(), "two sides": F.col("home") != F.col("away"), "price": F.col("m").isNotNull()}
    return Q.dataset_report(t.games, ["season"], ["home", "away", "week"], (1, 1), ["home_score", "stadium"], checks, ["home", "away"], t.teams.where("division <> 1"), "team")


@query("dq_depth_format", "SELECT 'weekly' AS format, count(*) AS n, count(*) FILTER (WHERE l_shipdate IS NULL) AS bad FROM lineitem UNION ALL SELECT 'snapshot', count(*), count(*) FILTER (WHERE ts IS NULL) FROM events")
def dq_depth_format(t):
    def one(df):
        kind, time = ("weekly", "l_shipdate") if "l_shipdate" in df.columns else ("snapshot", "ts")
        return df.agg(F.count("*").alias("n"), F.count_if(F.col(time).isNull()).alias("bad")).select(F.lit(kind).alias("format"), "n", "bad")

    return one(t.lineitem).union(one(t.events))


@query("dq_unmapped_codes", "SELECT o_custkey AS code, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1")
def dq_unmapped_codes(t):
    return Q.unmapped(t.orders, "o_custkey", t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("dq_source_diff", """WITH a AS (SELECT season, least(home, away) AS side_a, greatest(home, away) AS side_b, game_id, home_score, week FROM games WHERE game_id % 10 <> 0), b AS (SELECT season, least(home, away) AS side_a, greatest(home, away) AS side_b, game_id, CASE WHEN game_id % 7 = 0 THEN away_score ELSE home_score END AS home_score, week FROM games WHERE game_id % 9 <> 0)
SELECT coalesce(a.season, b.season) AS season, count(*) FILTER (WHERE a.game_id IS NOT NULL AND b.game_id IS NOT NULL) AS matched, count(*) FILTER (WHERE b.game_id IS NULL) AS only_a, count(*) FILTER (WHERE a.game_id IS NULL) AS only_b, avg((a.home_score = b.home_score)::INT) AS home_score_agree, avg((a.week = b.week)::INT) AS week_agree
FROM a FULL JOIN b ON a.season = b.season AND a.side_a = b.side_a AND a.side_b = b.side_b AND a.game_id = b.game_id GROUP BY 1""", "home_score_agree week_agree")
def dq_source_diff(t):
    g = t.games.select("season", *contests.pair_key("home", "away"), "game_id", "home_score", "away_score", "week")
    b = g.where("game_id % 9 <> 0").withColumn("home_score", F.when(F.col("game_id") % 7 == 0, F.col("away_score")).otherwise(F.col("home_score")))
    return Q.source_diff(g.where("game_id % 10 <> 0"), b, ["season", "side_a", "side_b", "game_id"], ["home_score", "week"], ["season"])


@query("dq_entity_counts", f"WITH {SIDES}, c AS (SELECT season, team, count(*) AS n FROM sides GROUP BY ALL) SELECT season, count(*) AS entities, min(n) AS least, max(n) AS most FROM c GROUP BY season")
def dq_entity_counts(t):
    return Q.entity_counts(sides(t), ["season"], "team")


@query("dq_status_reliability", "WITH a AS (SELECT season, player, status, avg(success) AS active FROM plays GROUP BY ALL) SELECT season, avg((active < 0.6)::INT) AS consistent, count(*) AS n FROM a WHERE status = 'F' GROUP BY season HAVING count(*) >= 50", "consistent")
def dq_status_reliability(t):
    a = t.plays.groupBy("season", "player", "status").agg(F.avg("success").alias("active")).where("status = 'F'")
    return a.groupBy("season").agg(F.avg((F.col("active") < 0.6).cast("double")).alias("consistent"), F.count("*").alias("n")).where("n >= 50")


@query("dq_component_availability", "SELECT season, avg((m IS NOT NULL)::INT) > 0.5 AS has_market, avg((spread <> 0)::INT) > 0.9 AS has_spread, count(*) / count(DISTINCT week) > 20 AS has_volume FROM games GROUP BY season")
def dq_component_availability(t):
    return t.games.groupBy("season").agg((F.avg(F.col("m").isNotNull().cast("double")) > 0.5).alias("has_market"), (F.avg((F.col("spread") != 0).cast("double")) > 0.9).alias("has_spread"), (F.count("*") / F.count_distinct("week") > 20).alias("has_volume"))


@query("dq_cleaning_report", "SELECT season, count(*) AS input, count_if(epa > -1)::BIGINT AS valid, count_if(epa > -1 AND yards >= 0)::BIGINT AS repaired, count_if(epa > -1 AND yards >= 0 AND down <= 3)::BIGINT AS kept FROM plays GROUP BY season")
def dq_cleaning_report(t):
    return Q.funnel(t.plays, ["season"], {"valid": F.col("epa") > -1, "repaired": F.col("yards") >= 0, "kept": F.col("down") <= 3})


@query("dq_field_report", "SELECT season, avg((kind = 'A')::INT) AS share_a, avg((kind = 'R')::INT) AS share_r, avg(yards) AS mean, stddev_samp(yards) AS sd, avg((epa IS NULL)::INT) AS missing FROM plays GROUP BY season", "share_a share_r mean sd missing")
def dq_field_report(t):
    is_ = lambda k: F.avg((F.col("kind") == k).cast("double"))
    return t.plays.groupBy("season").agg(is_("A").alias("share_a"), is_("R").alias("share_r"), F.avg("yards").alias("mean"), F.stddev_samp("yards").alias("sd"), F.avg(F.col("epa").isNull().cast("double")).alias("missing"))


@query("dq_share_error", """WITH e AS (SELECT player, kind, avg(wp) AS e FROM plays WHERE player % 7 <> 0 GROUP BY ALL), a AS (SELECT player, kind, avg(success) AS a FROM plays WHERE player % 5 <> 0 GROUP BY ALL), j AS (SELECT kind, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM e FULL JOIN a USING (player, kind))
SELECT kind, count(*) AS n, avg(abs(e - a)) AS mae, avg(e - a) AS bias, corr(e, a) AS c, avg((e = 0 AND a > 0)::INT) AS zero_but_present FROM j GROUP BY kind""", "mae bias c zero_but_present")
def dq_share_error(t):
    e = t.plays.where("player % 7 <> 0").groupBy("player", "kind").agg(F.avg("wp").alias("e"))
    a = t.plays.where("player % 5 <> 0").groupBy("player", "kind").agg(F.avg("success").alias("a"))
    j = e.join(a, ["player", "kind"], "full_outer").na.fill(0.0, ["e", "a"])
    d = F.col("e") - F.col("a")
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.corr("e", "a").alias("c"), F.avg(((F.col("e") == 0) & (F.col("a") > 0)).cast("double")).alias("zero_but_present"))


@query("dq_flag_accuracy", "SELECT coalesce(kind, 'ALL') AS kind, count(*) AS n, avg((wp < 0.4)::INT) FILTER (WHERE success = 0) AS caught, avg((wp < 0.4)::INT) FILTER (WHERE success = 1) AS false_alarm FROM plays GROUP BY ROLLUP (kind)", "caught false_alarm")
def dq_flag_accuracy(t):
    flag = (F.col("wp") < 0.4).cast("double")
    rate = lambda s: F.avg(F.when(F.col("success") == s, flag))
    return A.with_total(t.plays, ["kind"], [F.count("*").alias("n"), rate(0).alias("caught"), rate(1).alias("false_alarm")])


@query("dq_ledger_rules", """SELECT run_id, unnest(list_filter([CASE WHEN NOT run_at < deadline THEN 'before_deadline' END, CASE WHEN NOT p BETWEEN 0.1 AND 0.9 THEN 'probability' END, CASE WHEN source NOT IN ('F', 'O') THEN 'source' END, CASE WHEN count(*) OVER (PARTITION BY key, run_at) > 1 THEN 'unique' END], lambda x: x IS NOT NULL)) AS rule FROM ledger""")
def dq_ledger_rules(t):
    from pyspark.sql import Window as W

    rows = t.ledger.withColumn("n", F.count("*").over(W.partitionBy("key", "run_at")))
    return Q.rules(rows, ["run_id"], {"before_deadline": F.col("run_at") < F.col("deadline"), "probability": F.col("p").between(0.1, 0.9), "source": F.col("source").isin("F", "O"), "unique": F.col("n") == 1})


@query("dq_banned_columns", "SELECT 'm' AS path, count(m) AS filled FROM games UNION ALL SELECT 'moneyline', count(moneyline) FROM games UNION ALL SELECT 'spread', count(spread) FROM games")
def dq_banned_columns(t):
    paths = Q.banned_columns(t.games.schema, r"^(m|spread)$|money")
    found = F.array(*[F.struct(F.lit(c).alias("path"), F.count(c).alias("filled")) for c in sorted(paths)])
    return t.games.agg(found.alias("a")).select(F.explode("a").alias("s")).select("s.*")


@query("dq_corrupt_after", "SELECT game_id, CASE WHEN kickoff < TIMESTAMP '1996-01-01' THEN y END AS kept, kickoff >= TIMESTAMP '1996-01-01' AS scrambled FROM games", "kept")
def dq_corrupt_after(t):
    cut = F.lit("1996-01-01").cast("timestamp")
    dirty = asof.corrupt_after(t.games.withColumn("y0", F.col("y")), "kickoff", cut, ["y"], ["game_id"])
    late = F.col("kickoff") >= cut
    return dirty.select("game_id", F.when(~late, F.col("y")).alias("kept"), (F.col("y") != F.col("y0")).alias("scrambled"))


def _form(rows):
    return asof.period_sums_before(rows, ["home"], "season", ["y"])


@query("dq_leakage_check", "SELECT count(*) AS n_keys, 0::BIGINT AS y_before_changed FROM (SELECT DISTINCT home, season FROM games WHERE season <= 1996)")
def dq_leakage_check(t):
    dirty = asof.corrupt_after(t.games, "kickoff", F.lit("1996-01-01").cast("timestamp"), ["y"], ["game_id"])
    return Q.leakage(lambda g: _form(g).where("season <= 1996"), t.games, dirty, ["home", "season"], ["y_before"])


@query("positive_control_leaky", "SELECT game_id, avg(y) OVER (PARTITION BY home, season) AS leaky FROM games", "leaky")
def positive_control_leaky(t):
    mean = t.games.groupBy("home", "season").agg(F.avg("y").alias("leaky"))
    return t.games.select("game_id", "home", "season").join(mean, ["home", "season"]).select("game_id", "leaky")


@query("dq_consistency_gap", "SELECT CAST(0 AS DOUBLE) AS gap, count(*) AS n FROM (SELECT DISTINCT home FROM games)", "gap")
def dq_consistency_gap(t):
    a = t.games.groupBy("home").agg(F.sum("y").alias("a"))
    b = t.games.groupBy("home", "season").agg(F.sum("y").alias("s")).groupBy("home").agg(F.sum("s").alias("b"))
    return a.join(b, "home").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"), F.count("*").alias("n"))
