"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlore.operators import aggregates as A
from gridlore.operators import asof, contests, scoring
from gridlore.operators import joins as J
from gridlore.operators import windows as X
from gridlore.plans.aggregations import LINEUPS, SIDES, lineups, sides, tied
from gridlore.registry import query

TS = "'%Y-%m-%d %H:%M:%S'"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("join_lookup_strict", f"SELECT l_orderkey, l_linenumber, l_partkey, strftime(o_orderdate, {TS}) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_lookup_strict(t):
    dim = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return J.lookup_strict(t.lineitem, dim, ["l_orderkey"], ["o_orderdate"]).select("l_orderkey", "l_linenumber", "l_partkey", stamp("o_orderdate").alias("at"))


@query("join_dated_dimension", """WITH d AS (SELECT team, name || '-' || e AS code, 1992 + 3 * e AS first, 1994 + 3 * e AS last FROM teams, (SELECT unnest([0, 1, 2]) AS e)) SELECT game_id, code FROM games LEFT JOIN d ON home = team AND season BETWEEN first AND last""")
def join_dated_dimension(t):
    d = t.teams.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(F.col("team").alias("home"), F.concat_ws("-", "name", F.col("e").cast("string")).alias("code"), (1992 + 3 * F.col("e")).alias("first"), (1994 + 3 * F.col("e")).alias("last"))
    return J.dated(t.games, d, "home", "season", "first", "last").select("game_id", "code")


@query("join_attribute_dim", "SELECT game_id, h.name AS home_name, h.division = a.division AS same_division FROM games JOIN teams h ON h.team = home JOIN teams a ON a.team = away")
def join_attribute_dim(t):
    a, b = (t.teams.select(F.col("team").alias(s), F.col("name").alias(f"{s}_name"), F.col("division").alias(f"{s}_division")) for s in ("home", "away"))
    return J.checked(J.checked(t.games, a, "home"), b, "away").select("game_id", "home_name", (F.col("home_division") == F.col("away_division")).alias("same_division"))


@query("join_asof_week_sums", """WITH s AS (SELECT off, season, week, sum(epa) AS e, count(*) AS n FROM plays GROUP BY ALL) SELECT q.off, q.season, q.week, coalesce(sum(s.e), 0) AS e_before, coalesce(sum(s.n), 0)::BIGINT AS n_before FROM s q LEFT JOIN s ON s.off = q.off AND s.season = q.season AND s.week < q.week GROUP BY ALL""", "e_before")
def join_asof_week_sums(t):
    return asof.period_sums_before(t.plays.select("off", "season", "week", F.col("epa").alias("e"), F.lit(1).alias("n")), ["off", "season"], "week", ["e", "n"])


@query("join_asof_backward", """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT c.event_id, p.value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts > p.ts""", "value")
def join_asof_backward(t):
    p = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value")
    return asof.backward(t.events.where("event_type = 'click'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "at", ["value"], tie=["value"]).select("event_id", "value")


@query("join_asof_last_entity", """WITH d AS (SELECT off, ts, max(player) AS last_player FROM plays WHERE down = 4 GROUP BY ALL), q AS (SELECT DISTINCT off, ts FROM plays WHERE down = 1) SELECT q.off, strftime(q.ts, '%Y-%m-%d') AS day, d.last_player FROM q ASOF LEFT JOIN d ON q.off = d.off AND q.ts > d.ts""")
def join_asof_last_entity(t):
    d = t.plays.where("down = 4").select("off", F.col("ts").alias("at"), F.col("player").alias("last_player"))
    q = t.plays.where("down = 1").select("off", "ts").distinct()
    return asof.backward(q, d, ["off"], "ts", "at", ["last_player"], tie=["last_player"]).select("off", F.date_format("ts", "yyyy-MM-dd").alias("day"), "last_player")


@query("join_asof_now_fallback", """WITH l AS (SELECT home AS team, max_by(game_id, {'k': kickoff, 'g': game_id}) AS last_game FROM games WHERE kickoff < TIMESTAMP '1996-01-01' GROUP BY home), x AS (SELECT home AS team, max(game_id) AS listed FROM games WHERE season = 1996 AND week = 2 GROUP BY home)
SELECT team, coalesce(listed, last_game) AS game_id, CASE WHEN listed IS NOT NULL THEN 'listed' ELSE 'last' END AS source FROM l LEFT JOIN x USING (team)""")
def join_asof_now_fallback(t):
    last = X.last_per_key(t.games.select(F.col("home").alias("team"), "kickoff", "game_id"), ["team"], ["kickoff", "game_id"], ["game_id"], F.col("kickoff") < F.lit("1996-01-01").cast("timestamp"))
    listed = t.games.where("season = 1996 AND week = 2").groupBy(F.col("home").alias("team")).agg(F.max("game_id").alias("listed"))
    return last.join(listed, "team", "left").select("team", F.coalesce("listed", "game_id").alias("game_id"), F.when(F.col("listed").isNotNull(), "listed").otherwise("last").alias("source"))


@query("join_asof_forward", """WITH c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT c.event_id, coalesce(p.v, c.value) AS v FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts < p.ts""", "v")
def join_asof_forward(t):
    p = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), (-F.col("value")).alias("neg"))
    out = asof.forward(t.events.where("event_type = 'click'").select("event_id", "user_id", "ts", "value"), p, ["user_id"], "ts", "at", ["neg"], tie=["neg"])
    return out.select("event_id", F.coalesce(-F.col("neg"), "value").alias("v"))


@query("join_asof_snapshot", """WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view'), q AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'), m AS (SELECT q.event_id, q.user_id, max(s.d) AS d FROM q JOIN s ON s.user_id = q.user_id AND s.d < q.d GROUP BY ALL)
SELECT m.event_id, e.event_id AS seen FROM m JOIN events e ON e.user_id = m.user_id AND CAST(e.ts AS DATE) = m.d AND e.event_type = 'view'""")
def join_asof_snapshot(t):
    day = F.to_date("ts")
    q = t.events.where("event_type = 'purchase'").select("event_id", "user_id", day.alias("d"))
    rows = t.events.where("event_type = 'view'").select("user_id", day.alias("snap"), F.col("event_id").alias("seen"))
    return asof.snapshot(q, rows, ["user_id"], "d", "snap").select("event_id", "seen")


@query("join_nearest_earlier", """WITH b AS (SELECT passer, season, count(*) AS n FROM plays WHERE season % 2 = 0 GROUP BY ALL), q AS (SELECT DISTINCT passer, season FROM plays) SELECT q.passer, q.season, coalesce((SELECT max_by(n, season) FROM b WHERE b.passer = q.passer AND b.season <= q.season), -1) AS base FROM q""")
def join_nearest_earlier(t):
    b = t.plays.where("season % 2 = 0").groupBy("passer", "season").agg(F.count("*").alias("base"))
    return asof.nearest_earlier(t.plays.select("passer", "season").distinct(), b, ["passer"], "season", "base", F.lit(-1))


@query("join_band_count", """WITH q AS (SELECT DISTINCT kind, togo FROM plays), r AS (SELECT kind, togo FROM plays) SELECT q.kind, q.togo, count(*) AS n_similar FROM q JOIN r ON r.kind = q.kind AND abs(r.togo - q.togo) <= 2 GROUP BY ALL""")
def join_band_count(t):
    return J.band_count(t.plays.select("kind", "togo").distinct(), t.plays.select("kind", "togo"), ["kind"], "togo", 2.0)


@query("join_backoff_pool", """WITH a AS (SELECT kind, down, togo, count(*) AS n0 FROM plays GROUP BY ALL), b AS (SELECT kind, down, count(*) AS n1 FROM plays GROUP BY ALL), c AS (SELECT kind, count(*) AS n2 FROM plays GROUP BY ALL)
SELECT kind, down, togo, CASE WHEN n0 >= 400 THEN 0 WHEN n1 >= 2000 THEN 1 WHEN n2 >= 400 THEN 2 ELSE 3 END AS level FROM a JOIN b USING (kind, down) JOIN c USING (kind)""".replace("2000", "400"))
def join_backoff_pool(t):
    cells = A.backoff_level(t.plays.select("kind", "down", "togo"), [["kind", "down", "togo"], ["kind", "down"], ["kind"]], 400)
    return cells.select("kind", "down", "togo", "level").distinct()


@query("join_full_outer_values", "WITH a AS (SELECT player, avg(epa) AS v FROM plays WHERE kind = 'A' GROUP BY 1), b AS (SELECT player, avg(epa) AS v FROM plays WHERE kind = 'R' AND player % 3 = 0 GROUP BY 1) SELECT player, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (player)", "v")
def join_full_outer_values(t):
    a, b = (t.plays.where(w).groupBy("player").agg(F.avg("epa").alias("v")) for w in ("kind = 'A'", "kind = 'R' AND player % 3 = 0"))
    return J.outer_fill(b, a, ["player"], ["v"])


@query("join_multi_left", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment, coalesce(n_name, 'none') AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_multi_left(t):
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    out = J.checked(t.orders.join(c, "o_custkey", "left"), t.nation, "n_nationkey", "left")
    return out.na.fill("none", ["c_mktsegment", "n_name"]).select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


@query("join_one_to_one", "WITH a AS (SELECT game_id, count(*) AS n FROM plays GROUP BY 1), b AS (SELECT game_id, sum(epa) AS e FROM plays WHERE kind = 'A' GROUP BY 1) SELECT g.game_id, n, e FROM games g LEFT JOIN a USING (game_id) LEFT JOIN b USING (game_id)", "e")
def join_one_to_one(t):
    a = t.plays.groupBy("game_id").agg(F.count("*").alias("n"))
    b = t.plays.where("kind = 'A'").groupBy("game_id").agg(F.sum("epa").alias("e"))
    return J.one_to_one([t.games.select("game_id"), a, b], ["game_id"])


@query("join_side_keys", "WITH r AS (SELECT off AS team, season, avg(epa) AS v FROM plays GROUP BY ALL) SELECT game_id, coalesce(h.v, 0) - coalesce(a.v, 0) AS matchup FROM games g LEFT JOIN r h ON h.team = home AND h.season = g.season LEFT JOIN r a ON a.team = away AND a.season = g.season", "matchup")
def join_side_keys(t):
    r = t.plays.groupBy("season", F.col("off").alias("team")).agg(F.avg("epa").alias("v"))
    return J.sides_lookup(t.games, r, ["season"], "v").select("game_id", (F.col("v_home") - F.col("v_away")).alias("matchup"))


@query("join_residuals", "WITH o AS (SELECT off, season + 1 AS season, avg(epa) AS v FROM plays GROUP BY ALL), d AS (SELECT def, season + 1 AS season, avg(epa) AS v FROM plays GROUP BY ALL), g AS (SELECT game_id, season, off, def, avg(epa) AS e FROM plays GROUP BY ALL), r AS (SELECT game_id, off, def, e - coalesce(o.v, 0) AS x, e - coalesce(d.v, 0) AS z FROM g LEFT JOIN o USING (off, season) LEFT JOIN d USING (def, season)) SELECT game_id, off AS team, 'off' AS side, x AS residual FROM r UNION ALL SELECT game_id, def, 'def', z FROM r", "residual")
def join_residuals(t):
    g = t.plays.groupBy("game_id", "season", "off", "def").agg(F.avg("epa").alias("e"))
    for k in ("off", "def"):
        prior = t.plays.groupBy(k, (F.col("season") + 1).alias("season")).agg(F.avg("epa").alias(f"v_{k}"))
        g = g.join(prior, [k, "season"], "left")
    stacked = F.explode(F.array(*[F.struct(F.col(k).alias("team"), F.lit(k).alias("side"), (F.col("e") - F.coalesce(f"v_{k}", F.lit(0.0))).alias("residual")) for k in ("off", "def")]))
    return g.select("game_id", stacked.alias("s")).select("game_id", "s.*")


@query("join_anti_override", "WITH a AS (SELECT player, avg(epa) AS v FROM plays GROUP BY 1), b AS (SELECT player, avg(tax) AS v FROM plays WHERE player % 4 = 0 GROUP BY 1) SELECT player, v FROM b UNION ALL SELECT player, v FROM a WHERE player NOT IN (SELECT player FROM b)", "v")
def join_anti_override(t):
    a = t.plays.groupBy("player").agg(F.avg("epa").alias("v"))
    return J.override(a, t.plays.where("player % 4 = 0").groupBy("player").agg(F.avg("tax").alias("v")), ["player"])


@query("join_semi_filter", "SELECT game_id, play_id, player FROM plays WHERE game_id IN (SELECT game_id FROM games WHERE game_type = 'POST')")
def join_semi_filter(t):
    return t.plays.join(t.games.where("game_type = 'POST'").select("game_id"), "game_id", "left_semi").select("game_id", "play_id", "player")


@query("join_left_indicator", "SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders) AS matched FROM customer")
def join_left_indicator(t):
    return J.with_indicator(t.customer.select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key")), ["key"])


@query("join_status_override", "WITH p AS (SELECT status, kind, avg(success) AS prob FROM plays GROUP BY ALL) SELECT game_id, play_id, l.player, CASE WHEN yards < -8 THEN 0 WHEN down = 4 THEN round(prob) ELSE prob END AS prob FROM plays l LEFT JOIN p USING (status, kind)", "prob")
def join_status_override(t):
    p = t.plays.groupBy("status", "kind").agg(F.avg("success").alias("prob"))
    value = J.ordered_override(F.col("prob"), [(F.col("yards") < -8, F.lit(0.0)), (F.col("down") == 4, F.round("prob"))])
    return J.checked(t.plays, p, ["status", "kind"], "left").select("game_id", "play_id", "player", value.alias("prob"))


@query("join_lineup_games", f"WITH {SIDES}, r AS (SELECT DISTINCT season, week, off AS team, player FROM plays WHERE down = 1) SELECT s.game_id, r.team, player, is_home FROM sides s JOIN r USING (season, week, team)")
def join_lineup_games(t):
    r = t.plays.where("down = 1").select("season", "week", F.col("off").alias("team"), "player").distinct()
    rows = contests.unpivot_sides(t.games, ["season", "week", "game_id"]).select("season", "week", "team", "game_id", "is_home")
    return J.with_members(rows, r, ["season", "week", "team"], "player", "game_id").select("game_id", "team", "player", "is_home")


@query("join_prev_season_fact", """WITH m AS (SELECT off AS team, season, passer FROM (SELECT off, season, passer, row_number() OVER (PARTITION BY off, season ORDER BY count(*) DESC, passer) AS k FROM plays GROUP BY off, season, passer) WHERE k = 1), d AS (SELECT a.team, a.season, CASE WHEN b.passer IS NULL THEN NULL WHEN a.passer <> b.passer THEN 1 ELSE 0 END AS new FROM m a LEFT JOIN m b ON b.team = a.team AND b.season = a.season - 1)
SELECT game_id, h.new - a.new AS diff FROM games g LEFT JOIN d h ON h.team = home AND h.season = g.season LEFT JOIN d a ON a.team = away AND a.season = g.season""")
def join_prev_season_fact(t):
    m = A.mode(t.plays, ["off", "season"], "passer", F.col("passer")).select(F.col("off").alias("team"), "season", "passer")
    prev = m.select("team", (F.col("season") + 1).alias("season"), F.col("passer").alias("before"))
    d = m.join(prev, ["team", "season"], "left").select("team", "season", F.when(F.col("before").isNotNull(), (F.col("passer") != F.col("before")).cast("int")).alias("new"))
    return contests.side_difference(t.games, d, ["season"], "new", "diff").select("game_id", "diff")


@query("join_feature_week", """WITH s AS (SELECT season, week, max(kickoff) AS ends FROM games GROUP BY ALL), n AS (SELECT min(week) AS wk FROM s WHERE season = 1996 AND ends >= TIMESTAMP '1996-07-03') SELECT game_id, greatest(week, wk) AS feature_week FROM games, n WHERE season = 1996 AND kickoff >= TIMESTAMP '1996-07-03'""".replace("greatest(week, wk)", "CASE WHEN week < wk THEN week ELSE wk END"))
def join_feature_week(t):
    cut = F.lit("1996-07-03").cast("timestamp")
    weeks = t.games.where("season = 1996").groupBy("week").agg(F.max("kickoff").alias("ends")).where(F.col("ends") >= cut).agg(F.min("week").alias("wk"))
    return t.games.where(F.col("kickoff") >= cut).where("season = 1996").join(F.broadcast(weeks)).select("game_id", F.when(F.col("week") < F.col("wk"), F.col("week")).otherwise(F.col("wk")).alias("feature_week"))


@query("join_roster_pipeline", f"""WITH {LINEUPS}, e AS (SELECT game_id, sum(CASE WHEN side = 'home' THEN expected - remembered ELSE remembered - expected END) FILTER (WHERE unit = 'off') AS off_change,
sum(CASE WHEN side = 'home' THEN expected - remembered ELSE remembered - expected END) FILTER (WHERE unit = 'def') AS def_change, sum(CASE WHEN side = 'home' THEN remembered - last ELSE last - remembered END) AS turnover FROM g JOIN x USING (team, season, week) GROUP BY game_id)
SELECT * FROM e""", "off_change def_change turnover")
def join_roster_pipeline(t):
    """Credits to shares, values, worth of units as of each week, and differences of the sides of every game: who is expected against who is remembered, and against the last season."""
    x = lineups(t)
    at = lambda unit, c: F.sum(F.when(F.col("unit") == unit, F.col(c)))
    change = x.withColumns({"change": F.col("expected") - F.col("remembered"), "moved": F.col("remembered") - F.col("last")})
    wide = change.groupBy("team", "season", "week").agg(at("off", "change").alias("off_change"), at("def", "change").alias("def_change"), F.sum("moved").alias("turnover"))
    out = t.games.select("game_id", "season", "week", "home", "away")
    for c in ("off_change", "def_change", "turnover"):
        out = contests.side_difference(out, wide, ["season", "week"], c, c, default=0.0)
    return out.select("game_id", "off_change", "def_change", "turnover")


@query("join_birthdate_age", "SELECT l.game_id, l.play_id, l.player, date_diff('day', CAST('1970-01-01' AS DATE) + CAST(size * 30 AS INT), CAST(ts AS DATE)) / 365.2425e0 AS age FROM plays l LEFT JOIN players USING (player)".replace("AS age FROM", "AS age FROM"), "age")
def join_birthdate_age(t):
    births = t.players.select("player", F.date_add(F.lit("1970-01-01").cast("date"), F.col("size") * 30).alias("born"))
    return t.plays.join(births, "player", "left").select("game_id", "play_id", "player", (F.datediff(F.to_date("ts"), "born") / 365.2425).alias("age"))


@query("join_changed_flag", "WITH a AS (SELECT off, season, max(passer) AS x, count(*) AS n FROM plays GROUP BY ALL), b AS (SELECT off, season + 1 AS season, max(passer) AS x, count(*) AS n FROM plays GROUP BY ALL) SELECT a.off, a.season, (a.x IS DISTINCT FROM b.x)::INT AS new_x, (a.n IS DISTINCT FROM b.n)::INT AS new_n FROM a LEFT JOIN b USING (off, season)")
def join_changed_flag(t):
    a = t.plays.groupBy("off", "season").agg(F.max("passer").alias("x"), F.count("*").alias("n"))
    return J.changed(a, a.withColumn("season", F.col("season") + 1), ["off", "season"], {"new_x": "x", "new_n": "n"})


@query("join_state_structures", """WITH x AS (SELECT kind, down, player, row_number() OVER (PARTITION BY kind, down ORDER BY md5(game_id || '|' || play_id || '|' || player), game_id) AS k FROM plays WHERE season < 1996), q AS (SELECT DISTINCT kind, down, togo FROM plays WHERE season >= 1996) SELECT q.kind, q.down, q.togo, k::INT AS pick, player FROM q JOIN x ON x.kind = q.kind AND x.down = q.down AND k <= 3""")
def join_state_structures(t):
    x = t.plays.where("season < 1996").withColumn("h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("game_id", "play_id", "player")])))
    x = x.withColumn("pick", F.row_number().over(W.partitionBy("kind", "down").orderBy("h", "game_id"))).where("pick <= 3").select("kind", "down", "pick", "player")
    return t.plays.where("season >= 1996").select("kind", "down", "togo").distinct().join(x, ["kind", "down"])


@query("join_opponent_target", "SELECT l.game_id, l.play_id, l.player, CASE WHEN l.off = home THEN away WHEN l.off = away THEN home END AS opponent, l.off = home AS at_home FROM plays l LEFT JOIN games g USING (game_id)")
def join_opponent_target(t):
    g = t.games.select("game_id", "home", "away")
    opp = F.when(F.col("off") == F.col("home"), F.col("away")).when(F.col("off") == F.col("away"), F.col("home"))
    return t.plays.join(g, "game_id", "left").select("game_id", "play_id", "player", opp.alias("opponent"), (F.col("off") == F.col("home")).alias("at_home"))


@query("join_common_opponents", f"""WITH {SIDES}, g AS (SELECT season, team, division AS tie_group FROM teams CROSS JOIN (SELECT DISTINCT season FROM games)), m AS (SELECT s.*, tie_group FROM sides s JOIN g USING (season, team)), z AS (SELECT season, tie_group, count(*) AS size FROM g GROUP BY ALL),
k AS (SELECT season, tie_group, opp FROM m JOIN z USING (season, tie_group) GROUP BY ALL HAVING count(DISTINCT team) = max(size)) SELECT season, tie_group, team, count(*) AS common_games, avg(result) AS common_pct FROM m JOIN k USING (season, tie_group, opp) GROUP BY ALL""", "common_pct")
def join_common_opponents(t):
    return contests.common_opponents(sides(t), tied(t), ["season"])


@query("join_benchmark", "SELECT game_id, p, m AS bench_m FROM games LEFT JOIN (SELECT game_id AS g, m AS mm FROM games WHERE m IS NOT NULL) ON g = game_id", "p bench_m")
def join_benchmark(t):
    bench = t.games.where("m IS NOT NULL").select("game_id", F.col("m").alias("bench_m"))
    return t.games.select("game_id", "p").join(bench, "game_id", "left")


@query("join_paired_forecasts", """WITH a AS (SELECT key, max_by(p, {'a': run_at, 'b': run_id}) AS pa FROM ledger WHERE source = 'F' AND run_at < deadline GROUP BY key), b AS (SELECT key, max_by(p, {'a': run_at, 'b': run_id}) AS pb FROM ledger WHERE source = 'O' AND run_at < deadline GROUP BY key) SELECT key, pa, pb, pa - pb AS diff FROM a JOIN b USING (key)""", "pa pb diff")
def join_paired_forecasts(t):
    on_time = F.col("run_at") < F.col("deadline")
    a, b = (X.last_per_key(t.ledger.where(F.col("source") == s), ["key"], ["run_at", "run_id"], ["p"], on_time).withColumnRenamed("p", n) for s, n in (("F", "pa"), ("O", "pb")))
    return a.join(b, "key").withColumn("diff", F.col("pa") - F.col("pb"))


@query("join_baseline_delta", "WITH w AS (SELECT off, avg(wp) FILTER (WHERE season = 1996) AS now, avg(wp) FILTER (WHERE season = 1995) AS base FROM plays GROUP BY off) SELECT off, now, base, now - base AS delta FROM w", "now base delta")
def join_baseline_delta(t):
    now, base = (t.plays.where(f"season = {s}").groupBy("off").agg(F.avg("wp").alias(n)) for s, n in ((1996, "now"), (1995, "base")))
    return now.join(base, "off", "full_outer").withColumn("delta", F.col("now") - F.col("base"))


@query("join_sos", f"WITH {SIDES}, e AS (SELECT season, team, avg(prob) AS r FROM sides GROUP BY ALL) SELECT s.season, s.team, avg(1 - prob) AS pre, avg(e.r) AS final, sum(e.r * CASE WHEN is_home THEN 1e0 ELSE 1.15e0 END) / sum(CASE WHEN is_home THEN 1e0 ELSE 1.15e0 END) AS weighted FROM sides s JOIN e ON e.season = s.season AND e.team = s.opp GROUP BY ALL", "pre final weighted")
def join_sos(t):
    s = sides(t)
    e = s.groupBy("season", F.col("team").alias("opp")).agg(F.avg("prob").alias("r"))
    w = F.when(F.col("is_home"), 1.0).otherwise(1.15)
    return s.join(e, ["season", "opp"]).groupBy("season", "team").agg(F.avg(1 - F.col("prob")).alias("pre"), F.avg("r").alias("final"), (F.sum(F.col("r") * w) / F.sum(w)).alias("weighted"))


@query("join_comprehensive", f"""WITH {SIDES}, l AS (SELECT season, team, sum(result) - sum(prob) AS luck, avg(result) AS pct FROM sides GROUP BY ALL)
SELECT s.game_id, s.team, name, division, pct, luck, sum(result) OVER (PARTITION BY s.season, s.team ORDER BY s.week, s.game_id ROWS UNBOUNDED PRECEDING) AS won, neutral FROM sides s LEFT JOIN l USING (season, team) LEFT JOIN teams USING (team) LEFT JOIN (SELECT game_id, neutral FROM games) g USING (game_id)""", "pct luck won")
def join_comprehensive(t):
    s = X.running(sides(t), ["season", "team"], ["week", "game_id"], won=F.sum("result"))
    season = s.groupBy("season", "team").agg((F.sum("result") - F.sum("prob")).alias("luck"), F.avg("result").alias("pct"))
    out = J.checked(J.checked(s, season, ["season", "team"], "left"), t.teams, "team", "left").join(t.games.select("game_id", "neutral"), "game_id", "left")
    return out.select("game_id", "team", "name", "division", "pct", "luck", "won", "neutral")


@query("join_feature_frame", """WITH r AS (SELECT off AS team, season + 1 AS season, avg(epa) AS v FROM plays GROUP BY ALL), s AS (SELECT home AS team, season + 1 AS season, avg(y) AS w FROM games GROUP BY ALL)
SELECT game_id, p, h.v - a.v AS rating, coalesce(x.w, 0.5) AS home_form, CASE WHEN neutral THEN 0 ELSE 1 END AS site FROM games g LEFT JOIN r h ON h.team = home AND h.season = g.season LEFT JOIN r a ON a.team = away AND a.season = g.season LEFT JOIN s x ON x.team = home AND x.season = g.season""".replace("coalesce(x.w, 0.5)", "coalesce(x.w, 0.5e0)"), "p rating home_form")
def join_feature_frame(t):
    r = t.plays.groupBy(F.col("off").alias("team"), (F.col("season") + 1).alias("season")).agg(F.avg("epa").alias("v"))
    form = t.games.groupBy("home", (F.col("season") + 1).alias("season")).agg(F.avg("y").alias("w"))
    g = contests.side_difference(t.games, r, ["season"], "v", "rating")
    return J.checked(g, form, ["home", "season"], "left").select("game_id", "p", "rating", F.coalesce("w", F.lit(0.5)).alias("home_form"), F.when(F.col("neutral"), 0).otherwise(1).alias("site"))


@query("join_prior_vectors", "WITH g AS (SELECT status AS side, avg(epa) AS mean FROM plays GROUP BY 1), e AS (SELECT DISTINCT player, CASE WHEN player % 2 = 0 THEN 'F' ELSE 'O' END AS side FROM plays) SELECT player, e.side, coalesce(mean, 0) AS prior, CASE WHEN mean IS NULL THEN 1e0 ELSE 20e0 END AS strength FROM e LEFT JOIN g ON g.side = e.side", "prior strength")
def join_prior_vectors(t):
    g = t.plays.groupBy(F.col("status").alias("side")).agg(F.avg("epa").alias("mean"))
    e = t.plays.select("player", F.when(F.col("player") % 2 == 0, "F").otherwise("O").alias("side")).distinct()
    return J.checked(e, g, "side", "left").select("player", "side", F.coalesce("mean", F.lit(0.0)).alias("prior"), F.when(F.col("mean").isNull(), 1.0).otherwise(20.0).alias("strength"))
