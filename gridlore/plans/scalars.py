"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlore.functions import distributions as D
from gridlore.functions import scalar as S
from gridlore.operators import aggregates as A
from gridlore.operators import asof, contests, scoring
from gridlore.plans.joins import TS, stamp
from gridlore.registry import query

#: The error function in SQL, with the same fixed coefficients.
ERF = "(sign({x}) * (1 - ((((1.061405429e0 / (1 + 0.3275911e0 * abs({x})) - 1.453152027e0) / (1 + 0.3275911e0 * abs({x})) + 1.421413741e0) / (1 + 0.3275911e0 * abs({x})) - 0.284496736e0) / (1 + 0.3275911e0 * abs({x})) + 0.254829592e0) / (1 + 0.3275911e0 * abs({x})) * exp(-({x}) * ({x}))))"


def cdf(z):
    return f"(0.5e0 * (1 + {ERF.format(x=f'(({z}) / sqrt(2e0))')}))"


@query("fn_season_from_date", "SELECT game_id, (year(game_date) - CASE WHEN month(game_date) <= 2 THEN 1 ELSE 0 END)::INT AS s FROM games")
def fn_season_from_date(t):
    return t.games.select("game_id", S.season_of(F.col("game_date")).alias("s"))


@query("fn_kickoff_time", f"SELECT game_id, strftime(timezone('UTC', timezone('America/New_York', CAST(game_date AS TIMESTAMP) + INTERVAL (CASE WHEN game_id % 3 = 0 THEN 0 ELSE 13 * 60 + 5 END) MINUTE)), {TS}) AS at FROM games")
def fn_kickoff_time(t):
    clock = F.when(F.col("game_id") % 3 == 0, "late").otherwise("13:05")
    return t.games.select("game_id", stamp(S.kickoff_instant(F.col("game_date"), clock, "America/New_York")).alias("at"))


@query("fn_utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def fn_utc_iso(t):
    return t.events.select("event_id", S.utc_iso(F.col("ts")).alias("iso"))


@query("fn_local_hour_offset", """WITH z AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/London' ELSE 'Asia/Tokyo' END AS tz FROM events)
SELECT event_id, hour(timezone(tz, timezone('UTC', ts))) + minute(timezone(tz, timezone('UTC', ts))) / 60e0 AS h, (epoch(timezone(tz, timezone('UTC', ts))) - epoch(ts)) / 3600 AS off_h FROM z""", "h off_h")
def fn_local_hour_offset(t):
    tz = F.when(F.col("event_id") % 3 == 0, "America/New_York").when(F.col("event_id") % 3 == 1, "Europe/London").otherwise("Asia/Tokyo")
    return t.events.withColumn("tz", tz).select("event_id", S.local_hour(F.col("ts"), F.col("tz")).alias("h"), S.utc_offset_hours(F.col("ts"), F.col("tz")).alias("off_h"))


@query("fn_utc_nanos", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def fn_utc_nanos(t):
    return t.events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))


@query("fn_game_key", "SELECT game_id, season * 100 + week AS k FROM games")
def fn_game_key(t):
    return t.games.select("game_id", S.game_key(F.col("season"), F.col("week")).alias("k"))


RESULT = "CASE WHEN game_id % 11 = 0 THEN 'cancelled' WHEN home_score > away_score THEN 'W ' || home_score || '-' || away_score WHEN home_score < away_score THEN 'L ' || home_score || '-' || away_score ELSE 'T ' || home_score || '-' || away_score END"


@query("fn_parse_result", "SELECT game_id, CASE WHEN game_id % 11 <> 0 THEN CASE WHEN home_score > away_score THEN 'W' WHEN home_score < away_score THEN 'L' ELSE 'T' END END AS outcome, CASE WHEN game_id % 11 <> 0 THEN home_score::INT END AS scored, CASE WHEN game_id % 11 <> 0 THEN away_score::INT END AS allowed FROM games")
def fn_parse_result(t):
    return t.games.select("game_id", S.parse_result(F.expr(RESULT)).alias("r")).select("game_id", "r.*")


@query("fn_build_id", "SELECT game_id, season || '_' || lpad(week::VARCHAR, 2, '0') || '_' || away || '_' || home AS id FROM games")
def fn_build_id(t):
    return t.games.select("game_id", S.build_id(F.col("season"), F.col("week"), F.col("away").cast("string"), F.col("home").cast("string")).alias("id"))


@query("fn_pair_key", "SELECT game_id, least(home, away) AS side_a, greatest(home, away) AS side_b FROM games")
def fn_pair_key(t):
    return t.games.select("game_id", *contests.pair_key("home", "away"))


@query("fn_normalize_code", "SELECT c_custkey, CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 'BLD' WHEN 'MACHINERY' THEN 'MCH' ELSE upper(trim(c_mktsegment)) END AS code FROM customer")
def fn_normalize_code(t):
    padded = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))
    return t.customer.select("c_custkey", S.normal_code(padded, {"BUILDING": "BLD", "MACHINERY": "MCH"}).alias("code"))


@query("fn_impute_category", "SELECT game_id, play_id, player, coalesce(CASE WHEN kind <> 'N' THEN kind END, CASE WHEN is_pass = 1 THEN 'A' ELSE 'R' END) AS kind FROM plays")
def fn_impute_category(t):
    known = F.when(F.col("kind") != "N", F.col("kind"))
    return t.plays.select("game_id", "play_id", "player", F.coalesce(known, F.when(F.col("is_pass") == 1, "A").otherwise("R")).alias("kind"))


@query("fn_split_ids", "SELECT game_id, 2 AS n, home || ',' || away AS ids FROM games")
def fn_split_ids(t):
    raw = F.concat_ws(";", F.col("home").cast("string"), F.lit(" "), F.col("away").cast("string"), F.col("home").cast("string"))
    ids = S.split_ids(raw)
    return t.games.select("game_id", F.size(ids).alias("n"), F.array_join(ids, ",").alias("ids"))


@query("fn_parse_personnel", "SELECT game_id, (home % 3)::INT AS rb, (away % 4)::INT AS te, (5 - home % 3 - away % 4)::INT AS wr FROM games")
def fn_parse_personnel(t):
    text = F.concat((F.col("home") % 3).cast("string"), F.lit(" RB, "), (F.col("away") % 4).cast("string"), F.lit(" TE"))
    m = S.personnel(text, ["RB", "TE"], "WR", 5)
    return t.games.select("game_id", m["RB"].alias("rb"), m["TE"].alias("te"), m["WR"].alias("wr"))


@query("fn_side_majority", "WITH c AS (SELECT player, status, count(*) AS n FROM plays GROUP BY ALL), m AS (SELECT player, arg_min(status, {'n': -n, 's': status}) AS side FROM c GROUP BY player) SELECT game_id, count(*) AS n, count_if(status = side)::BIGINT AS agree FROM plays JOIN m USING (player) GROUP BY game_id")
def fn_side_majority(t):
    side = A.mode(t.plays, ["player"], "status", F.col("status")).select("player", F.col("status").alias("side"))
    return t.plays.join(side, "player").groupBy("game_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == F.col("side")).alias("agree"))


@query("fn_surface_type", "SELECT p_partkey, CASE WHEN p_type IN ('STANDARD ANODIZED', 'STANDARD BRUSHED') THEN 'grass' WHEN p_type LIKE 'ECONOMY%' THEN 'turf' ELSE 'other' END AS surface FROM part")
def fn_surface_type(t):
    p = F.col("p_type")
    return t.part.select("p_partkey", F.when(p.isin("STANDARD ANODIZED", "STANDARD BRUSHED"), "grass").when(p.startswith("ECONOMY"), "turf").otherwise("other").alias("surface"))


@query("fn_personnel_label", "SELECT game_id, CASE WHEN (home % 3)::VARCHAR || (away % 4)::VARCHAR IN ('11', '12', '21') THEN (home % 3)::VARCHAR || (away % 4)::VARCHAR ELSE 'other' END AS label FROM games")
def fn_personnel_label(t):
    return t.games.select("game_id", S.label_of({"rb": F.col("home") % 3, "te": F.col("away") % 4}, ["11", "12", "21"]).alias("label"))


@query("fn_bucket", "SELECT game_id, play_id, player, CASE WHEN togo >= 11 THEN 3 WHEN togo >= 7 THEN 2 WHEN togo >= 3 THEN 1 ELSE 0 END AS dist, CAST(floor(yardline / 5) AS INT) AS spot FROM plays")
def fn_bucket(t):
    return t.plays.select("game_id", "play_id", "player", A.bucket(F.col("togo"), [3, 7, 11]).alias("dist"), F.floor(F.col("yardline") / 5).cast("int").alias("spot"))


@query("fn_haversine", "SELECT game_id, 2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(away - home) / 2), 2) + cos(radians(25 + home)) * cos(radians(25 + away)) * pow(sin(radians(2 * (away - home)) / 2), 2)))) AS km FROM games", "km")
def fn_haversine(t):
    return t.games.select("game_id", S.haversine_km(25 + F.col("home"), 2 * F.col("home"), 25 + F.col("away"), 2 * F.col("away")).alias("km"))


@query("fn_implied_prob", "WITH i AS (SELECT game_id, CASE WHEN moneyline < 0 THEN -moneyline / (100 - moneyline) ELSE 100 / (100 + moneyline) END AS h, CASE WHEN -moneyline < 0 THEN moneyline / (100 + moneyline) ELSE 100 / (100 - moneyline) END + 0.05e0 AS a FROM games) SELECT game_id, h / (h + a) AS prob FROM i", "prob")
def fn_implied_prob(t):
    m = F.col("moneyline")
    return t.games.select("game_id", S.remove_vig(contests.implied_probability(m), contests.implied_probability(-m) + 0.05).alias("prob"))


@query("fn_elo_expected", "WITH r AS (SELECT game_id, 1500 + 10e0 * (home - 12) AS h, 1500 + 10e0 * (away - 12) AS a, CASE WHEN neutral THEN 0 ELSE 48 END AS e, home_score - away_score AS m FROM games) SELECT game_id, 1 / (1 + pow(10e0, -(h + e - a) / 400)) AS expected, (h + e - a) / 25 AS line, CASE WHEN m = 0 THEN 1e0 ELSE ln(abs(m) + 1) * 2.2e0 / (0.001e0 * (CASE WHEN m >= 0 THEN 1 ELSE -1 END * (h + e - a)) + 2.2e0) END AS multiplier FROM r", "expected line multiplier")
def fn_elo_expected(t):
    h, a = 1500.0 + 10 * (F.col("home") - 12), 1500.0 + 10 * (F.col("away") - 12)
    e = F.when(F.col("neutral"), 0.0).otherwise(48.0)
    m = F.col("home_score") - F.col("away_score")
    return t.games.select("game_id", contests.expected_home(h, a, e).alias("expected"), ((h + e - a) / 25).alias("line"), S.margin_multiplier(m, F.when(m >= 0, 1).otherwise(-1) * (h + e - a)).alias("multiplier"))


@query("fn_logit_sigmoid", "SELECT game_id, ln(p / (1 - p)) AS z, 1 / (1 + exp(-(0.1e0 + 0.9e0 * ln(p / (1 - p))))) AS s FROM games", "z s")
def fn_logit_sigmoid(t):
    z = S.logit(F.col("p"))
    return t.games.select("game_id", z.alias("z"), S.sigmoid(0.1 + 0.9 * z).alias("s"))


@query("fn_decay_weight", "SELECT game_id, pow(0.5e0, (53 - week) / 8e0) * pow(0.7e0, 1998 - season) AS w FROM games", "w")
def fn_decay_weight(t):
    return t.games.select("game_id", (asof.half_life(53 - F.col("week"), 8.0) * F.pow(F.lit(0.7), 1998 - F.col("season"))).alias("w"))


@query("fn_normal_cdf", f"SELECT game_id, {cdf('spread / 13e0')} AS prob FROM games", "prob")
def fn_normal_cdf(t):
    return t.games.select("game_id", D.normal_cdf(F.col("spread") / 13.0).alias("prob"))


PMF = f"""g AS (SELECT game_id, spread, home_score - away_score AS m FROM games), k AS (SELECT unnest(range(-80, 81)) AS k),
f AS (SELECT game_id, spread, m, k, CASE WHEN k = 80 THEN 1 ELSE {cdf('(k + 0.5e0 - spread) / 9e0')} END - CASE WHEN k = -80 THEN 0 ELSE {cdf('(k - 0.5e0 - spread) / 9e0')} END AS w FROM g, k)"""


def pmf(t):
    rows = t.games.withColumn("m", F.col("home_score") - F.col("away_score"))
    return rows.withColumn("pmf", D.normal_pmf(F.col("spread"), F.lit(9.0), -80, 80))


@query("fn_pmf_grid", f"WITH {PMF}, r AS (SELECT game_id, k, w * CASE WHEN abs(k) = 3 THEN 2e0 ELSE 1e0 END AS w FROM f) SELECT game_id, sum(w) FILTER (WHERE k = 3) / sum(w) AS at3, sum(w) FILTER (WHERE k = 0) / sum(w) AS at0 FROM r GROUP BY game_id", "at3 at0")
def fn_pmf_grid(t):
    factors = F.array(*[F.lit(2.0 if i == 3 else 1.0) for i in range(81)])
    w = pmf(t).withColumn("w", D.reweighted(F.col("pmf"), -80, factors))
    return w.select("game_id", F.get("w", F.lit(83)).alias("at3"), F.get("w", F.lit(80)).alias("at0"))


@query("fn_pmf_summaries", f"WITH {PMF}, c AS (SELECT *, sum(w) OVER (PARTITION BY game_id ORDER BY k) AS c FROM f) SELECT game_id, sum(CASE WHEN k > 0 THEN w WHEN k = 0 THEN w / 2 ELSE 0 END) AS win, min(k) FILTER (WHERE c >= 0.5 - 1e-9)::INT AS med FROM c GROUP BY game_id", "win")
def fn_pmf_summaries(t):
    of = lambda value: D.on_normal_grid(F.col("spread"), F.lit(9.0), -80, 80, value)
    return t.games.select("game_id", of(D.above_of).alias("win"), of(D.median_of).cast("int").alias("med"))


@query("fn_crps", f"""WITH {PMF}, c AS (SELECT *, sum(w) OVER (PARTITION BY game_id ORDER BY k) AS c FROM f), x AS (SELECT game_id, sum(pow(c - CASE WHEN k >= m THEN 1e0 ELSE 0e0 END, 2)) AS grid FROM c GROUP BY game_id)
SELECT game_id, grid, 9e0 * ((m - spread) / 9e0 * (2 * {cdf('(m - spread) / 9e0')} - 1) + 2 * exp(-pow((m - spread) / 9e0, 2) / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS closed,
(abs(m + 7) + abs(m) + abs(m - 3)) / 3e0 - (7 + 10 + 3) / 9e0 AS sample FROM x JOIN g USING (game_id)""", "grid closed sample")
def fn_crps(t):
    samples = F.array(F.lit(3.0), F.lit(-7.0), F.lit(0.0))
    rows = t.games.withColumn("m", F.col("home_score") - F.col("away_score"))
    grid = D.on_normal_grid(F.col("spread"), F.lit(9.0), -80, 80, D.crps_of, F.col("m"))
    return rows.select("game_id", grid.alias("grid"), D.crps_normal(F.col("m"), F.col("spread"), F.lit(9.0)).alias("closed"), D.crps_sample(F.col("m"), samples).alias("sample"))


@query("fn_per_row_losses", "SELECT game_id, pow(p - y, 2) AS brier, -(y * ln(p) + (1 - y) * ln(1 - p)) AS logloss, abs(y - p) AS mae FROM games", "brier logloss mae")
def fn_per_row_losses(t):
    return t.games.select("game_id", *[scoring.METRICS[m]("y", "p").alias(m) for m in ("brier", "logloss", "mae")])


@query("fn_fold_distribution", f"WITH {PMF}, b AS (SELECT game_id, k + 80 AS i, w, 80 + game_id % 15 AS lim FROM f), d AS (SELECT game_id, least(i, lim) AS i, sum(w) AS w FROM b GROUP BY ALL), r AS (SELECT game_id, i, greatest(w, 0.001e0) AS w FROM d) SELECT game_id, max(i)::INT AS last, arg_max(w, i) / sum(w) AS w_last FROM r GROUP BY game_id", "w_last")
def fn_fold_distribution(t):
    lim = (80 + F.col("game_id") % 15).cast("int")
    f = pmf(t).select("game_id", lim.alias("last"), D.fold(F.col("pmf"), lim, 0.001).alias("w"))
    return f.select("game_id", "last", F.get("w", F.col("last")).alias("w_last"))


@query("fn_event_probs", f"WITH {PMF} SELECT game_id, sum(w) FILTER (WHERE k >= 7) AS p7, sum(w * k) AS mean FROM f GROUP BY game_id", "p7 mean")
def fn_event_probs(t):
    of = lambda value: D.on_normal_grid(F.col("spread"), F.lit(9.0), -80, 80, value)
    return t.games.select("game_id", of(lambda g, k: g[:, k >= 7].sum(axis=1)).alias("p7"), of(lambda g, k: g @ k).alias("mean"))


@query("fn_shift_distribution", f"WITH {PMF}, e AS (SELECT game_id, sum(w) FILTER (WHERE k >= 3) AS p FROM f GROUP BY game_id) SELECT game_id, 1 / (1 + exp(-(ln(p / (1 - p)) + 0.4e0))) AS p FROM e", "p")
def fn_shift_distribution(t):
    moved = D.shift_event(F.col("pmf"), -80, F.lit(3), 0.4)
    return pmf(t).withColumn("s", moved).select("game_id", D.total(F.transform("s", lambda x, i: F.when(i - 80 >= 3, x).otherwise(0.0))).alias("p"))


@query("fn_sparse_bins", f"WITH {PMF} SELECT game_id, min(k + 80) FILTER (WHERE w >= 0.01)::INT AS start, (max(k) FILTER (WHERE w >= 0.01) - min(k) FILTER (WHERE w >= 0.01) + 1)::INT AS n FROM f GROUP BY game_id")
def fn_sparse_bins(t):
    return pmf(t).select("game_id", D.trimmed(F.col("pmf"), 0.01).alias("s")).select("game_id", "s.start", F.size("s.bins").alias("n"))


@query("fn_waterfill", """WITH RECURSIVE u AS (SELECT off, player, count(*) AS usage FROM plays GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY off ORDER BY usage DESC, player) AS r, sum(usage) OVER (PARTITION BY off ORDER BY usage DESC, player ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM u),
f AS (SELECT *, usage * (300 - r + 1) >= rest AND r <= 300 AS full_ FROM r), t AS (SELECT *, count_if(full_) OVER (PARTITION BY off) AS nf, sum(CASE WHEN NOT full_ THEN usage END) OVER (PARTITION BY off) AS l FROM f) SELECT off, player, CASE WHEN full_ THEN 1e0 ELSE usage * (300 - nf) / l END AS share FROM t""".replace("WITH RECURSIVE", "WITH"), "share")
def fn_waterfill(t):
    u = t.plays.groupBy("off", "player").agg(F.count("*").cast("double").alias("usage"))
    return A.waterfill(u, ["off"], "usage", 300, ["player"]).select("off", "player", "share")


@query("fn_situation_dummies", "SELECT game_id, play_id, player, (down = 2)::INT::DOUBLE AS d2, (down = 3)::INT::DOUBLE AS d3, (down = 4)::INT::DOUBLE AS d4, (yardline <= 20)::INT::DOUBLE AS redzone FROM plays", "d2 d3 d4 redzone")
def fn_situation_dummies(t):
    return t.plays.select("game_id", "play_id", "player", *[(F.col("down") == d).cast("double").alias(f"d{d}") for d in (2, 3, 4)], (F.col("yardline") <= 20).cast("double").alias("redzone"))


@query("fn_early_interaction", "SELECT game_id, p * greatest(0, 1 - week / 8e0) AS early FROM games", "early")
def fn_early_interaction(t):
    return t.games.select("game_id", (F.col("p") * F.greatest(F.lit(0.0), 1 - F.col("week") / 8)).alias("early"))


@query("fn_member_keys", "WITH k AS (SELECT DISTINCT 'o|' || player AS key FROM plays UNION SELECT DISTINCT 'd|' || passer FROM plays) SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM k")
def fn_member_keys(t):
    keys = t.plays.select(F.explode(F.concat(S.member_keys("o", F.array("player")), S.member_keys("d", F.array("passer")))).alias("key")).distinct()
    return keys.withColumn("idx", (F.row_number().over(W.orderBy("key")) - 1).cast("long"))  # an index of the members, not of the rows


@query("fn_raw_to_bins", "SELECT game_id, play_id, player, CASE WHEN yards >= 100 - yardline THEN 52 ELSE least(greatest(yards, -10), 40) + 10 END AS bin FROM plays")
def fn_raw_to_bins(t):
    b = F.when(F.col("yards") >= 100 - F.col("yardline"), 52).otherwise(F.least(F.greatest(F.col("yards"), F.lit(-10)), F.lit(40)) + 10)
    return t.plays.select("game_id", "play_id", "player", b.alias("bin"))


@query("fn_weather", "SELECT game_id, CASE WHEN home % 4 = 0 THEN 1 ELSE 0 END AS indoor, CASE WHEN home % 4 = 0 THEN 0 ELSE coalesce(CASE WHEN week % 5 <> 0 THEN week % 17 END, 8) END AS wind, greatest(0, 32 - week)::INT AS cold FROM games")
def fn_weather(t):
    indoor = F.col("home") % 4 == 0
    wind = F.when(F.col("week") % 5 != 0, F.col("week") % 17)
    return t.games.select("game_id", indoor.cast("int").alias("indoor"), F.when(indoor, 0).otherwise(F.coalesce(wind, F.lit(8))).alias("wind"), F.greatest(F.lit(0), 32 - F.col("week")).alias("cold"))


@query("fn_wp_derived", "SELECT game_id, play_id, player, exp(-4 * secs / 3600e0) AS elapsed, (wp - 0.5e0) * exp(-4 * secs / 3600e0) AS interaction FROM plays", "elapsed interaction")
def fn_wp_derived(t):
    e = F.exp(-4 * F.col("secs") / 3600)
    return t.plays.select("game_id", "play_id", "player", e.alias("elapsed"), ((F.col("wp") - 0.5) * e).alias("interaction"))


@query("fn_flag_change", "SELECT game_id, CASE WHEN abs(p - q) >= 0.3 THEN CASE WHEN p > q THEN 'p' ELSE 'q' END END AS larger, p - q AS diff FROM games", "diff")
def fn_flag_change(t):
    d = F.col("p") - F.col("q")
    return t.games.select("game_id", F.when(F.abs(d) >= 0.3, F.when(d > 0, "p").otherwise("q")).alias("larger"), d.alias("diff"))


@query("fn_clock_text", "SELECT game_id, play_id, player, 'Q' || down || ' ' || CAST(floor((secs % 900) / 60) AS INT) || ':' || lpad((secs % 900 % 60)::VARCHAR, 2, '0') AS clock FROM plays")
def fn_clock_text(t):
    return t.plays.select("game_id", "play_id", "player", S.clock_text(F.col("down"), F.col("secs")).alias("clock"))


@query("fn_hash_split")
def fn_hash_split(t):
    return t.games.select("game_id", S.hash_holdout(F.col("game_id")).alias("held_out"))
