"""Queries of the scans and sinks: tables go out through a sink and come back through a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators import joins as J
from gridlore.sources import files as S
from gridlore.functions import scalar
from gridlore.registry import query

GAME_COLUMNS = ["game_id", "season", "week", "home", "away", "home_score", "away_score"]
GAME_SCHEMA = "game_id long, season int, week int, home long, away long, home_score long, away_score long"
GAME_SQL = f"SELECT {', '.join(GAME_COLUMNS)} FROM games"


def landed(t, df, tag, fmt="csv", **options):
    path = S.scratch(t.spark, tag)
    df.write.options(header=True, **options).format(fmt).save(path)
    return path


@query("scan_games_csv", "SELECT game_id, strftime(game_date, '%Y-%m-%d') AS day, home, away FROM games")
def scan_games_csv(t):
    path = landed(t, t.games.select("game_id", "game_date", "home", "away"), "games")
    return S.scan_csv(t.spark, path, "game_id long, game_date date, home long, away long").select("game_id", F.date_format("game_date", "yyyy-MM-dd").alias("day"), "home", "away")


@query("scan_538_csv", "SELECT game_id, season, CASE game_type WHEN 'POST' THEN 'playoff' ELSE 'regular' END AS game_type, m FROM games WHERE season BETWEEN 1993 AND 1995 AND m IS NOT NULL", "m")
def scan_538_csv(t):
    path = landed(t, t.games.select("game_id", "season", "game_type", "m"), "games")
    return S.scan_mapped(t.spark, path, "game_id long, season int, game_type string, m double", "game_type", {"POST": "playoff", "REG": "regular"}, ["m"], F.col("season").between(1993, 1995))


@query("scan_legacy_rows", "SELECT game_id, CASE WHEN home_score > away_score THEN 'W' WHEN home_score < away_score THEN 'L' ELSE 'T' END AS outcome, home_score::INT AS scored, away_score::INT AS allowed FROM games")
def scan_legacy_rows(t):
    text = F.concat(F.when(F.col("home_score") > F.col("away_score"), "W ").when(F.col("home_score") < F.col("away_score"), "L ").otherwise("T "), F.col("home_score").cast("string"), F.lit("-"), F.col("away_score").cast("string"))
    path = landed(t, t.games.select("game_id", text.alias("result")), "legacy")
    return S.scan_csv(t.spark, path, "game_id long, result string").select("game_id", scalar.parse_result(F.col("result")).alias("r")).select("game_id", "r.*")


@query("scan_schedule_cached", GAME_SQL)
def scan_schedule_cached(t):
    path = landed(t, t.games.select(*GAME_COLUMNS), "schedule", "parquet")
    return S.scan_first(t.spark, [f"{path}-fresh", path])


@query("scan_season_parquet", "SELECT season, home, p FROM games WHERE season IN (1994, 1996)", "p")
def scan_season_parquet(t):
    path = S.scratch(t.spark, "seasons")
    S.write_partitioned(t.games, path, "season")
    rules = {"without id": F.col("game_id").isNotNull(), "with a forecast outside 0 to 1": F.col("p").between(0, 1), "against themselves": F.col("home") != F.col("away")}
    S.scan_validated(S.scan_partitions(t.spark, path, "season", [1994, 1996]), rules)
    return S.scan_partitions(t.spark, path, "season", [1994, 1996], ["season", "home", "p"])


@query("scan_events", "SELECT event_id, user_id, event_type FROM events")
def scan_events(t):
    return S.scan_guarded(t.events, "^(value|props|ts)$")


@query("scan_schedules", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_schedules(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("scan_player_stats", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 10", "p_retailprice")
def scan_player_stats(t):
    return t.part.where("p_size <= 10").select("p_partkey", "p_size", "p_retailprice")


@query("scan_injuries", "SELECT season, week, player FROM plays WHERE season >= 1995 AND player IS NOT NULL")
def scan_injuries(t):
    return t.plays.where("season >= 1995 AND player IS NOT NULL").select(F.col("season").cast("int"), F.col("week").cast("int"), "player")


@query("scan_rosters", "SELECT season, week, passer AS player FROM plays WHERE passer IS NOT NULL")
def scan_rosters(t):
    return t.plays.where("passer IS NOT NULL").select("season", "week", F.col("passer").alias("player"))


@query("scan_snapshot_dim", "SELECT p_partkey AS player, p_brand AS grp, 0 AS season FROM part")
def scan_snapshot_dim(t):
    return S.scan_dimension(t.part.select(F.col("p_partkey").alias("player"), F.col("p_brand").alias("grp"), F.lit(0).alias("season")), ["player"])


@query("scan_participation", "SELECT game_id, play_id, off, def FROM plays WHERE season >= 1996")
def scan_participation(t):
    return t.plays.where("season >= 1996").select("game_id", "play_id", "off", "def")


@query("scan_depth_union", "SELECT off AS team, player, season FROM plays WHERE season < 1995 UNION ALL SELECT def, passer, season FROM plays WHERE season >= 1995")
def scan_depth_union(t):
    a = t.plays.where("season < 1995").select(F.col("off").alias("team"), "player", "season")
    b = t.plays.where("season >= 1995").select(F.col("passer").alias("player"), F.col("def").alias("team"), "season")
    both = a.unionByName(b)
    return J.lookup_strict(both, t.teams, ["team"], [])


@query("scan_weekly_depth", """WITH c AS (SELECT season, max(week) AS cw FROM plays GROUP BY 1), s AS (SELECT season, max(week) AS sw FROM games GROUP BY 1), h AS (SELECT season, CASE WHEN season = (SELECT max(season) FROM games) THEN 0 ELSE cw - sw END AS shift FROM c JOIN s USING (season))
SELECT DISTINCT l.season, l.week - shift AS week, off, CASE WHEN down <= 1 THEN 'offense' WHEN down <= 3 THEN 'defense' ELSE 'special' END AS side, player FROM plays l JOIN h ON h.season = l.season""")
def scan_weekly_depth(t):
    last = t.games.agg(F.max("season")).first()[0]
    shift = S.week_shifts(t.plays, t.games, "season", "week", last)
    side = F.when(F.col("down") <= 1, "offense").when(F.col("down") <= 3, "defense").otherwise("special")
    return t.plays.join(F.broadcast(shift), "season").select("season", (F.col("week") - F.col("shift")).alias("week"), "off", side.alias("side"), "player").distinct()


@query("scan_stadium_dim", "SELECT s_suppkey AS stadium, s_name AS name FROM supplier")
def scan_stadium_dim(t):
    path = landed(t, t.supplier.select(F.col("s_suppkey").alias("stadium"), F.col("s_name").alias("name")), "stadiums")
    return S.scan_dimension(S.scan_csv(t.spark, path, "stadium long, name string"), ["stadium"])


@query("scan_seed_dim", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_seed_dim(t):
    return S.scan_csv(t.spark, landed(t, t.customer.select("c_custkey", "c_name", "c_nationkey"), "seeds"), "c_custkey long, c_name string, c_nationkey int")


@query("scan_ledger", "SELECT CAST(key AS VARCHAR) AS key, CAST(run_id AS VARCHAR) AS run_id, strftime(run_at, '%Y-%m-%d %H:%M:%S') AS at, p FROM ledger", "p")
def scan_ledger(t):
    path = landed(t, t.ledger.select("key", "run_id", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("run_at"), "p", F.lit(0.5).alias("p_market")), "ledger")
    rows = S.scan_csv(t.spark, path, "key string, run_id string, run_at string, p double, p_market double")
    return S.scan_guarded(rows, "market").select("key", "run_id", F.date_format(F.to_timestamp("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "yyyy-MM-dd HH:mm:ss").alias("at"), "p")


@query("scan_json_runs", "SELECT season, 'elo' AS name, count(*) AS n, avg(pow(p - y, 2)) AS brier, count(DISTINCT week)::BIGINT AS weeks, 1 AS named FROM games GROUP BY season", "brier")
def scan_json_runs(t):
    """Nested run records, a document a season, with the file that each came from."""
    metrics = F.struct(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    runs = t.games.groupBy("season").agg(metrics.alias("metrics"), F.array_sort(F.collect_set("week")).alias("weeks"))
    path = landed(t, runs.select(F.lit("elo").alias("name"), F.struct("season", "weeks").alias("scope"), "metrics"), "runs", "json")
    read = S.scan_json_runs(t.spark, path, "name string, scope struct<season:int, weeks:array<int>>, metrics struct<n:long, brier:double>")
    return read.select("scope.season", "name", "metrics.*", F.size("scope.weeks").cast("long").alias("weeks"), F.col("file").endswith(".json").cast("int").alias("named"))


@query("scan_site_inputs", "SELECT game_id, name FROM games JOIN teams ON team = home")
def scan_site_inputs(t):
    games = S.scan_csv(t.spark, landed(t, t.games.select("game_id", "home"), "elo"), "game_id long, home long")
    names = t.spark.read.schema("team long, name string").json(landed(t, t.teams.select("team", "name"), "ratings", "json"))
    return J.checked(games, names.withColumnRenamed("team", "home"), "home").select("game_id", "name")


@query("scan_many_inputs", "SELECT 'games' AS source, season, count(*) AS n FROM games WHERE season BETWEEN 1994 AND 1996 GROUP BY 2 UNION ALL SELECT 'plays', season, count(*) FROM plays WHERE season BETWEEN 1994 AND 1996 GROUP BY 2")
def scan_many_inputs(t):
    parts = [df.where("season BETWEEN 1994 AND 1996").groupBy("season").agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "season", "n") for n, df in (("games", t.games), ("plays", t.plays))]
    return parts[0].union(parts[1])


@query("scan_cleaned_plays_cache", "SELECT game_id, play_id, player, epa FROM plays WHERE epa IS NOT NULL AND player IS NOT NULL", "epa")
def scan_cleaned_plays_cache(t):
    clean = t.plays.where("epa IS NOT NULL AND player IS NOT NULL").select("game_id", "play_id", "player", "epa")
    root = S.scratch(t.spark, "cleaned")
    key = S.table_key(clean)
    S.cached(clean, root, key)
    return S.cached(clean, root, key)


@query("sink_parquet_atomic", "SELECT game_id, season, CASE WHEN season = 1995 THEN p + 1 ELSE p END AS p FROM games", "p")
def sink_parquet_atomic(t):
    path = S.scratch(t.spark, "atomic")
    rows = t.games.select("game_id", "season", "p")
    S.write_partitioned(rows, path, "season")
    S.write_partitioned(rows.where("season = 1995").withColumn("p", F.col("p") + 1), path, "season")
    return t.spark.read.parquet(path).select("game_id", F.col("season").cast("int").alias("season"), "p")


@query("sink_append_ledger", "SELECT CAST(season AS INT) AS season, run_at, n FROM (SELECT season, 1 AS run_at, count(*) AS n FROM games GROUP BY season UNION ALL SELECT season, 2, count(*) FROM plays GROUP BY season)")
def sink_append_ledger(t):
    path, columns = S.scratch(t.spark, "ledger"), ["season", "run_at", "n"]
    for run, df in ((1, t.games), (2, t.plays)):
        S.append_run(df.groupBy("season").agg(F.count("*").alias("n")).select("season", F.lit(run).alias("run_at"), "n"), path, columns)
    return t.spark.read.parquet(path)


@query("sink_csv_rounded", "SELECT game_id, round(p, 3) AS p, strftime(game_date, '%Y-%m-%d') AS game_date FROM games", "p")
def sink_csv_rounded(t):
    path = S.scratch(t.spark, "rounded")
    S.write_csv_rounded(t.games.select("game_id", "p", "game_date"), path, {"p": 3}, ["game_date"])
    return S.scan_csv(t.spark, path, "game_id long, p double, game_date string")


@query("sink_json_document", "SELECT game_id, m, home FROM games", "m")
def sink_json_document(t):
    path = S.scratch(t.spark, "documents")
    S.write_json_documents(t.games.select("game_id", F.coalesce("m", F.lit(float("nan"))).alias("m"), "home"), path)
    return t.spark.read.schema("game_id long, m double, home long").json(path)


@query("sink_run_record", "SELECT 'elo' AS name, avg(pow(p - y, 2)) AS brier, count(*) AS n FROM games", "brier")
def sink_run_record(t):
    path = S.scratch(t.spark, "records")
    record = t.games.agg(F.struct(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.count("*").alias("n")).alias("metrics")).select(F.lit("elo").alias("name"), "metrics")
    record.write.mode("append").json(path)
    return t.spark.read.schema("name string, metrics struct<brier:double,n:long>").json(path).select("name", "metrics.*")


@query("sink_frames", "SELECT season, game_id, q FROM games", "q")
def sink_frames(t):
    path = S.scratch(t.spark, "frames")
    S.write_partitioned(t.games.select("season", "game_id", "q"), path, "season")
    return t.spark.read.parquet(path).select(F.col("season").cast("int").alias("season"), "game_id", "q")


@query("sink_rating_cache", "SELECT off, season, avg(epa) AS rating FROM plays GROUP BY ALL", "rating")
def sink_rating_cache(t):
    return S.cached(t.plays.groupBy("off", "season").agg(F.avg("epa").alias("rating")), S.scratch(t.spark, "ratings"), S.table_key(t.plays, "rating", 1))


@query("table_fingerprint", "SELECT season, count(*) AS n, (season = 1995)::BIGINT AS changed FROM games GROUP BY season")
def table_fingerprint(t):
    from gridlore.operators.quality import fingerprint

    again = t.games.repartition(7).withColumn("p", F.when(F.col("season") == 1995, F.col("p") + 1).otherwise(F.col("p")))
    a, b = fingerprint(t.games, ["season"]), fingerprint(again, ["season"])
    joined = a.join(b.withColumnsRenamed({"xor": "x2", "sum": "s2", "n": "n2"}), "season", "full_outer")
    same = (F.col("xor") == F.col("x2")) & (F.col("sum") == F.col("s2"))
    return joined.select("season", "n", F.when(same, 0).otherwise(1).cast("long").alias("changed"))


@query("manifest_status", """WITH n AS (SELECT season, count(*) AS n FROM games GROUP BY season)
SELECT 'season=' || season AS part, CASE WHEN season = 1995 THEN 'changed' WHEN season = 1996 THEN 'missing' WHEN season = 2095 THEN 'new' ELSE 'same' END AS status, CASE WHEN season < 2095 THEN n END AS rows_was, CASE WHEN season <> 1996 THEN n END AS rows_now
FROM (SELECT * FROM n UNION ALL SELECT 2095, n FROM n WHERE season = 1995)""")
def manifest_status(t):
    """A folder of seasons against its manifest: one season was rewritten, one removed, one added."""
    path, kept = S.scratch(t.spark, "manifest"), S.scratch(t.spark, "kept")
    S.write_partitioned(t.games, path, "season")
    S.manifest(t.spark, path, "(season=[^/]*)/").write.parquet(kept)
    S.write_partitioned(t.games.where("season = 1995").withColumn("p", F.col("p") + 1), path, "season")
    S.write_partitioned(t.games.where("season = 1995").withColumn("season", F.lit(2095)), path, "season")
    S.remove(t.spark, f"{path}/season=1996")
    return S.manifest_diff(t.spark.read.parquet(kept), S.manifest(t.spark, path, "(season=[^/]*)/"))
