"""Queries of windows, top-k, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlore.operators import contests
from gridlore.operators import windows as X
from gridlore.plans.aggregations import SIDES, sides
from gridlore.registry import query


@query("win_week_ordinal", "WITH w AS (SELECT season, week, row_number() OVER (ORDER BY season, week) - 1 AS ord FROM (SELECT DISTINCT season, week FROM games)) SELECT game_id, ord FROM games JOIN w USING (season, week)")
def win_week_ordinal(t):
    return t.games.join(F.broadcast(X.week_ordinals(t.games)), ["season", "week"]).select("game_id", F.col("ord").cast("long"))


@query("win_week_asof", "SELECT game_id, strftime(least(kickoff, min(kickoff) FILTER (WHERE game_type = 'REG') OVER (PARTITION BY season, week)), '%Y-%m-%d %H:%M:%S') AS as_of FROM games")
def win_week_asof(t):
    return X.period_start(t.games, ["season", "week"], "kickoff", F.col("game_type") == "REG").select("game_id", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"))


@query("win_calendar_week", """WITH f AS (SELECT *, min(game_date) OVER (PARTITION BY season) AS first FROM games)
SELECT game_id, CAST(floor((game_date - (first - CAST((dayofweek(first) + 5) % 7 AS INT))) / 7) + 1 AS INT) AS wk FROM f""")
def win_calendar_week(t):
    first = F.min("game_date").over(W.partitionBy("season"))
    return t.games.withColumn("first", first).select("game_id", X.calendar_week(F.col("game_date"), F.col("first")).alias("wk"))


@query("win_nth_meeting", "SELECT game_id, row_number() OVER (PARTITION BY season, game_type, least(home, away), greatest(home, away) ORDER BY game_date, game_id)::INT - 1 AS meeting FROM games")
def win_nth_meeting(t):
    return contests.nth_meeting(t.games, ["season", "game_type"], "home", "away", ["game_date", "game_id"]).select("game_id", "meeting")


@query("win_career_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS career FROM events")
def win_career_count(t):
    return X.running(t.events, ["user_id"], ["ts", "event_id"], career=F.count("*")).select("event_id", "career")


@query("win_prior_cumsum", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events", "before")
def win_prior_cumsum(t):
    return X.before(t.events, ["user_id"], ["ts", "event_id"], before=F.sum("value")).select("event_id", "before")


@query("win_first_in_week", "SELECT game_id, first_value(p) OVER (PARTITION BY season, week ORDER BY kickoff, game_id) AS first FROM games", "first")
def win_first_in_week(t):
    return t.games.select("game_id", F.first("p").over(W.partitionBy("season", "week").orderBy("kickoff", "game_id")).alias("first"))


@query("win_running_level", "SELECT game_id, 50 + coalesce(sum(y - p) OVER (PARTITION BY home ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM games", "level")
def win_running_level(t):
    return X.before(t.games, ["home"], ["kickoff", "game_id"], step=F.sum(F.col("y") - F.col("p"))).select("game_id", (50 + F.coalesce("step", F.lit(0.0))).alias("level"))


@query("win_next_nonnull", """WITH b AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events) SELECT event_id, nxt FROM b""")
def win_next_nonnull(t):
    return X.next_where(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "nxt").select("event_id", "nxt")


@query("win_next_n_sum", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM events", "ahead")
def win_next_n_sum(t):
    return X.rolling(t.events, ["user_id"], ["ts", "event_id"], 0, 4, ahead=F.sum("value")).select("event_id", "ahead")


@query("win_rolling_stats", "SELECT event_id, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd, median(value) OVER w AS med FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "mean sd med")
def win_rolling_stats(t):
    return X.rolling(t.events, ["user_id"], ["ts", "event_id"], 4, mean=F.avg("value"), sd=F.stddev_samp("value"), all=F.collect_list("value")).select("event_id", "mean", "sd", _median("all").alias("med"))


def _median(c):
    s, n = F.array_sort(c), F.size(c)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


@query("win_centered_mean", "SELECT event_id, CASE WHEN count(*) OVER w >= 3 THEN avg(value) OVER w END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "mean")
def win_centered_mean(t):
    return X.rolling(t.events, ["user_id"], ["ts", "event_id"], 2, 2, m=F.avg("value"), n=F.count("*")).select("event_id", F.when(F.col("n") >= 3, F.col("m")).alias("mean"))


@query("win_rating_matrix", "SELECT season, max_by(p, {'k': kickoff, 'g': game_id}) FILTER (WHERE home = 0) AS t0, max_by(p, {'k': kickoff, 'g': game_id}) FILTER (WHERE home = 1) AS t1, max_by(p, {'k': kickoff, 'g': game_id}) FILTER (WHERE home = 2) AS t2 FROM games GROUP BY season", "t0 t1 t2")
def win_rating_matrix(t):
    out = t.games.groupBy("season").pivot("home", [0, 1, 2]).agg(F.max_by("p", F.struct("kickoff", "game_id")))
    return out.withColumnsRenamed({str(i): f"t{i}" for i in range(3)})


@query("win_share_of_total", "SELECT event_id, value / sum(value) OVER (PARTITION BY user_id) AS share FROM events", "share")
def win_share_of_total(t):
    return t.events.select("event_id", (F.col("value") / F.sum("value").over(W.partitionBy("user_id"))).alias("share"))


@query("win_tail_1", "SELECT key, max_by(run_id, {'a': run_at, 'b': run_id}) AS run_id, max_by(p, {'a': run_at, 'b': run_id}) AS p FROM ledger WHERE run_at < deadline GROUP BY key", "p")
def win_tail_1(t):
    return X.last_per_key(t.ledger, ["key"], ["run_at", "run_id"], ["run_id", "p"], F.col("run_at") < F.col("deadline"))


@query("win_weekday_last", "SELECT key, max_by(run_id, {'a': run_at, 'b': run_id}) AS run_id FROM ledger WHERE dayofweek(timezone('America/New_York', timezone('UTC', run_at))) = 3 GROUP BY key")
def win_weekday_last(t):
    local = F.from_utc_timestamp("run_at", "America/New_York")
    return X.last_per_key(t.ledger, ["key"], ["run_at", "run_id"], ["run_id"], F.dayofweek(local) == 4)


@query("win_rank_first", "SELECT season, game_id, row_number() OVER (PARTITION BY season ORDER BY p DESC, game_id)::INT AS place, row_number() OVER (PARTITION BY season ORDER BY q DESC, game_id)::INT - row_number() OVER (PARTITION BY season ORDER BY p DESC, game_id)::INT AS change FROM games")
def win_rank_first(t):
    w = W.partitionBy("season")
    a, b = (F.row_number().over(w.orderBy(F.desc(c), "game_id")) for c in ("p", "q"))
    return t.games.select("season", "game_id", a.alias("place"), (b - a).alias("change"))


@query("win_rank_dense", "SELECT season, game_id, dense_rank() OVER (PARTITION BY season ORDER BY home_score DESC)::INT AS place FROM games")
def win_rank_dense(t):
    return t.games.select("season", "game_id", F.dense_rank().over(W.partitionBy("season").orderBy(F.desc("home_score"))).alias("place"))


@query("win_rank_min", f"WITH {SIDES}, s AS (SELECT season, team, sum(points)::BIGINT AS f, sum(points_opp)::BIGINT AS a FROM sides GROUP BY ALL) SELECT season, team, rank() OVER (PARTITION BY season ORDER BY f DESC)::INT + rank() OVER (PARTITION BY season ORDER BY a)::INT AS combined FROM s")
def win_rank_min(t):
    s = sides(t).groupBy("season", "team").agg(F.sum("points").alias("f"), F.sum("points_opp").alias("a"))
    w = W.partitionBy("season")
    return s.select("season", "team", (F.rank().over(w.orderBy(F.desc("f"))) + F.rank().over(w.orderBy("a"))).alias("combined"))


@query("win_running_max", "SELECT event_id, max(value) OVER w AS hi, min(value) OVER w AS lo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "hi lo")
def win_running_max(t):
    return X.running(t.events, ["user_id"], ["ts", "event_id"], hi=F.max("value"), lo=F.min("value")).select("event_id", "hi", "lo")


@query("win_diff", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff FROM events", "diff")
def win_diff(t):
    return t.events.select("event_id", (F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("diff"))


@query("win_cumulative_season", f"WITH {SIDES} SELECT game_id, team, row_number() OVER w::INT AS game_no, sum(result) OVER w AS won, sum(prob) OVER w AS expected, CAST(sum(points) OVER w AS BIGINT) AS scored FROM sides WINDOW w AS (PARTITION BY season, team ORDER BY week, game_id ROWS UNBOUNDED PRECEDING)".replace("row_number() OVER w::INT", "CAST(row_number() OVER w AS INT)"), "won expected")
def win_cumulative_season(t):
    out = X.running(sides(t), ["season", "team"], ["week", "game_id"], won=F.sum("result"), expected=F.sum("prob"), scored=F.sum("points"))
    return out.withColumn("game_no", F.row_number().over(W.partitionBy("season", "team").orderBy("week", "game_id"))).select("game_id", "team", "game_no", "won", "expected", "scored")


@query("win_week_blocks", """WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM l""")
def win_week_blocks(t):
    return X.islands(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "block")


@query("win_season_lookback", "WITH s AS (SELECT home, season, sum(y) AS w, count(*) AS n FROM games GROUP BY ALL) SELECT home, season, sum(w) OVER x / sum(n) OVER x AS rate FROM s WINDOW x AS (PARTITION BY home ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)", "rate")
def win_season_lookback(t):
    s = t.games.groupBy("home", "season").agg(F.sum("y").alias("w"), F.count("*").alias("n"))
    x = W.partitionBy("home").orderBy("season").rangeBetween(-3, -1)
    return s.select("home", "season", (F.sum("w").over(x) / F.sum("n").over(x)).alias("rate"))


@query("win_min_debut", "SELECT event_id, strftime(min(ts) OVER (PARTITION BY user_id), '%Y-%m-%d %H:%M:%S') AS debut FROM events")
def win_min_debut(t):
    return t.events.select("event_id", F.date_format(F.min("ts").over(W.partitionBy("user_id")), "yyyy-MM-dd HH:mm:ss").alias("debut"))


@query("sort_stable_multi", "SELECT season, game_id, p FROM games ORDER BY season, game_date, game_id", "p")
def sort_stable_multi(t):
    return t.games.orderBy("season", "game_date", "game_id").select("season", "game_id", "p")


@query("topk_abs", "SELECT event_id, value - 50 AS swing FROM events ORDER BY abs(value - 50) DESC, event_id LIMIT 25", "swing")
def topk_abs(t):
    return t.events.select("event_id", (F.col("value") - 50).alias("swing")).orderBy(F.abs("swing").desc(), "event_id").limit(25)


@query("topk_per_group", "SELECT kind, down, player, v FROM (SELECT *, row_number() OVER (PARTITION BY kind, down ORDER BY v DESC, player) AS k FROM (SELECT kind, down, player, round(avg(epa), 9) AS v FROM plays GROUP BY ALL)) WHERE k <= 3", "v")
def topk_per_group(t):
    s = t.plays.groupBy("kind", "down", "player").agg(F.round(F.avg("epa"), 9).alias("v"))
    return X.top_per_group(s, ["kind", "down"], [F.desc("v"), "player"], 3)


@query("argbest_columns", """WITH l AS (SELECT game_id, unnest([{'v': -p, 'n': 'p'}, {'v': -q, 'n': 'q'}, {'v': spread / -10, 'n': 's'}]) AS s FROM games), r AS (SELECT game_id, s.v AS v, s.n AS n, row_number() OVER (PARTITION BY game_id ORDER BY s.v, s.n) AS k FROM l)
SELECT a.game_id, a.n AS best, b.n AS second, b.v - a.v AS margin FROM r a JOIN r b ON b.game_id = a.game_id AND a.k = 1 AND b.k = 2""", "margin")
def argbest_columns(t):
    return X.best_columns(t.games.withColumn("s", F.col("spread") / 10), ["p", "q", "s"]).select("game_id", "best", "second", "margin")


@query("dedupe_two_row", f"WITH {SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id, least(team, opp), greatest(team, opp) ORDER BY is_home DESC) AS k FROM sides) SELECT game_id, team, opp, points, points_opp FROM r WHERE k = 1")
def dedupe_two_row(t):
    return X.top_per_group(sides(t).withColumns({"a": F.least("team", "opp"), "b": F.greatest("team", "opp")}), ["game_id", "a", "b"], [F.desc("is_home")]).select("game_id", "team", "opp", "points", "points_opp")


@query("dedupe_priority", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS k FROM events) WHERE k = 1")
def dedupe_priority(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t.events.groupBy("user_id").agg(F.min(F.struct(rank.alias("r"), "ts", "event_id", "event_type")).alias("s")).select("user_id", "s.event_type", "s.event_id")


LADDER = ("h2h", "div", "common", "sov", "sos", "common_net", "net")
_BEST = ", ".join(f"CASE WHEN count({c}) = count(*) THEN sum(bit) FILTER (WHERE {c} >= max_{c} - 1e-9) END AS best_{c}" for c in LADDER)
_TOPS = ", ".join(f"max({c}) OVER (PARTITION BY league, season, division, m) AS max_{c}" for c in LADDER)
_NEXT = "coalesce(" + ", ".join(f"nullif(best_{c}, m)" for c in LADDER) + ", low)"
#: A set of tied teams is a sum of bits; `nx` leads to the set that a pass of the ladder leaves, `follow` to the winner.
TIES = f"""WITH RECURSIVE s AS (SELECT league, season, home AS team, away AS opp, y AS r, home_score - away_score AS d FROM league_games UNION ALL SELECT league, season, away, home, 1 - y, away_score - home_score FROM league_games),
p AS (SELECT league, season, team, opp, count(*) AS n, sum(r) AS w, count_if(r = 1) AS k, sum(d)::BIGINT AS d FROM s GROUP BY ALL),
b AS (SELECT league, season, team, sum(n) AS n, sum(w) AS w, sum(d)::BIGINT AS net FROM p GROUP BY ALL),
v AS (SELECT p.league, p.season, p.team, sum(p.n * o.w) / sum(p.n * o.n) AS sos, coalesce(sum(p.k * o.w) / nullif(sum(p.k * o.n), 0), 0e0) AS sov, sum(p.w) FILTER (WHERE x.division = y.division) / sum(p.n) FILTER (WHERE x.division = y.division) AS div
FROM p JOIN b o ON o.league = p.league AND o.season = p.season AND o.team = p.opp JOIN teams x ON x.team = p.team JOIN teams y ON y.team = p.opp GROUP BY ALL),
t AS (SELECT league, season, division, team, round(b.w / b.n, 9) AS pct, div, sov, sos, net, 1 << (row_number() OVER (PARTITION BY league, season, division ORDER BY team) - 1)::INT AS bit FROM b JOIN v USING (league, season, team) JOIN teams USING (team)),
f AS (SELECT *, rank() OVER (PARTITION BY league, season, division ORDER BY pct DESC) AS first FROM t),
z AS (SELECT league, season, division, first, sum(bit)::INT AS mask FROM f GROUP BY ALL),
g AS (SELECT league, season, division, m::INT AS m FROM z JOIN range(1, 32) AS r(m) ON (m & mask) = m),
e AS (SELECT g.*, team, bit, div, sov, sos, net FROM g JOIN t USING (league, season, division) WHERE (bit & m) <> 0),
q AS (SELECT e.league, e.season, e.division, e.m, e.team, p.opp, n, w, d, coalesce((o.bit & e.m) <> 0 AND o.division = e.division, false) AS inside FROM e JOIN p USING (league, season, team) LEFT JOIN t o ON o.league = p.league AND o.season = p.season AND o.team = p.opp),
c AS (SELECT league, season, division, m, opp FROM q GROUP BY ALL HAVING count(DISTINCT team) = bit_count(m)),
h AS (SELECT league, season, division, m, team, sum(w) / sum(n) AS h2h FROM q WHERE inside GROUP BY ALL),
i AS (SELECT league, season, division, m, team, sum(w) / sum(n) AS common, sum(d) AS common_net FROM q JOIN c USING (league, season, division, m, opp) GROUP BY ALL),
l AS (SELECT e.*, h2h, common, coalesce(common_net, 0) AS common_net FROM e LEFT JOIN h USING (league, season, division, m, team) LEFT JOIN i USING (league, season, division, m, team)),
a AS (SELECT *, {_TOPS} FROM l),
u AS (SELECT league, season, division, m, min(bit) AS low, {_BEST} FROM a GROUP BY ALL),
nx AS (SELECT league, season, division, m, CAST({_NEXT} AS INT) AS nxt FROM u),
follow AS (SELECT league, season, division, m AS start, m FROM g UNION ALL SELECT league, season, division, start, nxt FROM follow JOIN nx USING (league, season, division, m) WHERE bit_count(m) > 1),
win AS (SELECT league, season, division, start AS rest, m AS bit FROM follow WHERE bit_count(m) = 1),
placed AS (SELECT league, season, division, bit, mask - bit AS rest, first::INT AS place FROM z JOIN win USING (league, season, division) WHERE win.rest = mask
UNION ALL SELECT league, season, division, win.bit, placed.rest - win.bit, place + 1 FROM placed JOIN win USING (league, season, division, rest) WHERE placed.rest > 0)
SELECT league, season, division, team, place FROM placed JOIN t USING (league, season, division, bit)"""


@query("tie_ladder_rank", TIES)
def tie_ladder_rank(t):
    by = ["league", "season"]
    rows = contests.unpivot_sides(t.league_games, by, mirrored={"points": ("home_score", "away_score")}, flipped={"result": "y"}).withColumn("margin", F.col("points") - F.col("points_opp"))
    base = contests.standings(rows, by, F.broadcast(t.teams)).withColumns({"div": F.col("group_pct"), "sov": F.coalesce("sov", F.lit(0.0))})
    teams = base.join(F.broadcast(t.teams), "team").select(*by, "division", "team", "pct", "div", "sov", "sos", "net")
    return X.tie_ladder(rows, teams, by, ["division"], "pct", LADDER)


#: Steps between division winners and between the rest; two that met are parted by their games, more by a sweep.
WILD = ("sweep", "conf", "common4", "sov", "sos", "rank_conf", "rank_all", "net_conf", "net")


@query("tie_seed_field")
def tie_seed_field(t):
    """Seven seeds of each half of a league: division winners first, then the best of the rest."""
    by = ["league", "season"]
    half = t.teams.withColumn("half", (F.col("division") >= 3).cast("int"))
    rows = contests.unpivot_sides(t.league_games, by, mirrored={"points": ("home_score", "away_score")}, flipped={"result": "y"}).withColumn("margin", F.col("points") - F.col("points_opp"))
    base = contests.standings(rows, by, F.broadcast(t.teams)).withColumns({"div": F.col("group_pct"), "sov": F.coalesce("sov", F.lit(0.0))}).join(F.broadcast(half), "team")
    own, other = half.select("team", F.col("half").alias("h1")), half.select(F.col("team").alias("opp"), F.col("half").alias("h2"))
    inside = rows.join(F.broadcast(own), "team").join(F.broadcast(other), "opp").where("h1 = h2").groupBy(*by, "team").agg(F.avg("result").alias("conf"), F.sum("margin").cast("double").alias("net_conf"))
    teams = X.combined_ranks(X.combined_ranks(base, [*by, "half"], "scored", "allowed", "rank_conf"), by, "scored", "allowed", "rank_all")
    teams = teams.join(inside, [*by, "team"], "left").select(*by, "division", "half", "team", "pct", "div", "sov", "sos", "net", "conf", F.coalesce("net_conf", F.lit(0.0)).alias("net_conf"), "rank_conf", "rank_all")
    return X.seed_field(rows, teams, by, "division", "half", "pct", LADDER, WILD, 7)


@query("tie_criteria", f"""WITH {SIDES}, g AS (SELECT season, team, division AS tie_group FROM teams CROSS JOIN (SELECT DISTINCT season FROM games)), b AS (SELECT season, team, sum(result) AS w, count(*) AS n, avg(result) AS pct, sum(points - points_opp)::BIGINT AS net FROM sides GROUP BY ALL),
x AS (SELECT s.season, s.team, sum(o.w) / sum(o.n) AS sos, sum(o.w) FILTER (WHERE result = 1) / sum(o.n) FILTER (WHERE result = 1) AS sov FROM sides s JOIN b o ON o.season = s.season AND o.team = s.opp GROUP BY ALL),
h AS (SELECT s.season, s.team, avg(result) AS h2h FROM sides s JOIN g a ON a.season = s.season AND a.team = s.team JOIN g o ON o.season = s.season AND o.team = s.opp WHERE a.tie_group = o.tie_group GROUP BY ALL),
m AS (SELECT s.*, a.tie_group FROM sides s JOIN g a USING (season, team)), z AS (SELECT season, tie_group, count(*) AS size FROM g GROUP BY ALL), k AS (SELECT m.season, m.tie_group, m.opp FROM m JOIN z USING (season, tie_group) GROUP BY ALL HAVING count(DISTINCT m.team) = max(size)),
c AS (SELECT m.season, m.team, avg(result) AS common FROM m JOIN k USING (season, tie_group, opp) GROUP BY ALL HAVING count(*) >= 4)
SELECT b.season, b.team, pct, h2h, common, sov, sos, net, rank() OVER (PARTITION BY b.season ORDER BY net DESC)::INT AS net_rank FROM b JOIN x USING (season, team) LEFT JOIN h USING (season, team) LEFT JOIN c USING (season, team)""", "pct h2h common sov sos")
def tie_criteria(t):
    from gridlore.plans.aggregations import tied

    rows, g = sides(t), tied(t)
    base = contests.standings(rows, ["season"], t.teams).select("season", "team", "pct", "sov", "sos", "net")
    h = contests.head_to_head(rows, g, ["season"]).select("season", "team", F.col("h2h_pct").alias("h2h"))
    c = contests.common_opponents(rows, g, ["season"], minimum=4).select("season", "team", F.col("common_pct").alias("common"))
    out = base.join(h, ["season", "team"], "left").join(c, ["season", "team"], "left")
    return out.withColumn("net_rank", F.rank().over(W.partitionBy("season").orderBy(F.desc("net"))))


@query("union_sources", "SELECT game_id, season, home, 'old' AS source FROM games WHERE season < 1995 UNION ALL SELECT game_id, season, away, 'new' FROM games WHERE season >= 1995")
def union_sources(t):
    old = t.games.where("season < 1995").select("game_id", "season", "home", F.lit("old").alias("source"))
    return old.unionByName(t.games.where("season >= 1995").select("season", "game_id", F.col("away").alias("home"), F.lit("new").alias("source")))


@query("union_fill_columns", "SELECT game_id, home, NULL::DOUBLE AS m FROM games WHERE season < 1994 UNION ALL SELECT game_id, NULL, m FROM games WHERE season >= 1994", "m")
def union_fill_columns(t):
    return t.games.where("season < 1994").select("game_id", "home").unionByName(t.games.where("season >= 1994").select("game_id", "m"), allowMissingColumns=True).select("game_id", "home", "m")


@query("distinct_pairs", "WITH d AS (SELECT DISTINCT home, season FROM games), c AS (SELECT *, home || ':' || season AS code FROM d) SELECT game_id, code FROM games JOIN c USING (home, season)")
def distinct_pairs(t):
    codes = t.games.select("home", "season").distinct().withColumn("code", F.concat_ws(":", F.col("home").cast("string"), F.col("season").cast("string")))
    return t.games.join(codes, ["home", "season"]).select("game_id", "code")


@query("except_keys", "SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def except_keys(t):
    return t.orders.select(F.col("o_custkey").alias("key")).distinct().join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key", "left_anti")


@query("intersect_keys", "SELECT passer FROM plays WHERE season = 1994 GROUP BY passer HAVING count(*) >= 20 INTERSECT SELECT passer FROM plays WHERE season = 1995 GROUP BY passer HAVING count(*) >= 20")
def intersect_keys(t):
    a, b = (t.plays.where(f"season = {s}").groupBy("passer").count().where("count >= 20").select("passer") for s in (1994, 1995))
    return a.intersect(b)
