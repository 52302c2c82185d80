"""Queries of the streaming operators: a table is landed as files, streamed through, and the sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators.folds import Elo
from gridlore.registry import query
from gridlore.sources.files import scratch
from gridlore.streaming import ledger as L


def streamed(t, df, tag, parts=4):
    path = scratch(t.spark, tag)
    df.repartition(parts).write.parquet(path)
    return L.source(t.spark, path, df.schema, files=2)


def entries(t):
    return t.ledger.withColumns({"run_at": F.col("run_at").cast("timestamp"), "deadline": F.expr("CAST('1996-01-01' AS TIMESTAMP)")})


@query("stream_ledger_append", "SELECT CAST(year(run_at) AS INTEGER) AS run, run_id, key, p FROM ledger", "p")
def stream_ledger_append(t):
    """A run for each year, two files each, one run a batch; one run comes a second time, too late, and is refused."""
    rows = t.ledger.select(F.year("run_at").alias("run"), "run_id", "key", "p")
    path, out = scratch(t.spark, "ledger"), scratch(t.spark, "out")
    years = sorted(r[0] for r in rows.select("run").distinct().collect())
    for year in [*years, *years[:1]]:
        rows.where(F.col("run") == year).repartition(2).write.mode("append").parquet(path)
    L.drain(L.source(t.spark, path, rows.schema, files=2), L.guarded(out, rows.columns, "run"))
    return L.results(t.spark, out, rows)


@query("stream_deadline_reject", "SELECT run_id, run_at < TIMESTAMP '1996-01-01' AS accepted FROM ledger")
def stream_deadline_reject(t):
    out = scratch(t.spark, "out")

    def write(batch, n):
        kept, late = L.split_late(batch, "run_at", "deadline")
        for rows, ok in ((kept, True), (late, False)):
            rows.select("run_id", F.lit(ok).alias("accepted")).write.mode("overwrite").parquet(f"{out}/batch={2 * n + ok}")

    s = streamed(t, entries(t), "ledger")
    L.drain(s.withWatermark("run_at", "30 days"), write)
    return t.spark.read.parquet(out).drop("batch")


@query("stream_latest_per_key", "SELECT key, max_by(run_id, {'a': run_at, 'b': run_id}) AS run_id FROM ledger WHERE run_at < TIMESTAMP '1996-01-01' GROUP BY key")
def stream_latest_per_key(t):
    s = streamed(t, entries(t), "ledger").where(F.col("run_at") < F.col("deadline")).select("key", "run_at", "run_id")
    out = scratch(t.spark, "out")
    state = L.latest(s, "key", "run_at", ["run_id"])
    L.drain(state, L.to_folder(out), "update")
    return L.results(t.spark, out, state).groupBy("key").agg(F.max(F.struct("run_at", "run_id"))["run_id"].alias("run_id"))


@query("stream_dedupe_run", "SELECT DISTINCT key, run_at::DATE::VARCHAR AS day FROM ledger")
def stream_dedupe_run(t):
    twice = entries(t).select("key", "run_at").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    s = streamed(t, twice, "ledger").withWatermark("run_at", "4000 days").dropDuplicatesWithinWatermark(["key", "run_at"])
    out = scratch(t.spark, "out")
    L.drain(s, L.to_folder(out))
    return L.results(t.spark, out, s).select("key", F.date_format("run_at", "yyyy-MM-dd").alias("day"))


@query("stream_join_results", "SELECT game_id, p, y FROM games", "p y")
def stream_join_results(t):
    g = t.games.withColumn("kickoff", F.col("kickoff").cast("timestamp"))
    f = streamed(t, g.select("game_id", "p", F.col("kickoff").alias("at")), "forecasts").withWatermark("at", "4000 days")
    r = streamed(t, g.select(F.col("game_id").alias("id"), "y", (F.col("kickoff") + F.expr("INTERVAL 3 HOURS")).alias("done")), "results").withWatermark("done", "4000 days")
    j = f.join(r, F.expr("game_id = id AND done >= at AND done <= at + INTERVAL 1 DAY")).select("game_id", "p", "y")
    out = scratch(t.spark, "out")
    L.drain(j, L.to_folder(out))
    return L.results(t.spark, out, j)


@query("stream_week_window", """WITH s AS (SELECT event_type, value, floor(epoch(ts) / 604800) * 604800 - k * 604800 AS beg FROM events, (SELECT unnest([0, 1]) AS k))
SELECT strftime(TIMESTAMP '1970-01-01' + INTERVAL (beg) SECOND, '%Y-%m-%d') AS week, event_type, count(*) AS n, sum(value) AS total FROM s GROUP BY ALL""", "total")
def stream_week_window(t):
    """Windows of two weeks that slide by one, so that an event is in two of them."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = streamed(t, e, "events").withWatermark("ts", "60 days").groupBy(F.window("ts", "14 days", "7 days"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    s = w.select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "event_type", "n", "total")
    out = scratch(t.spark, "out")
    L.drain(s, L.to_folder(out), "update")
    return L.results(t.spark, out, s).groupBy("week", "event_type").agg(F.max_by("n", "n").alias("n"), F.max_by("total", "n").alias("total"))


@query("stream_session", """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "user_id")
    s = streamed(t, e, "events").withWatermark("ts", "60 days").groupBy(F.session_window("ts", "2 days"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("start"))
    out = scratch(t.spark, "out")

    def write(batch, n):
        batch.select("user_id", "start", "n").write.mode("overwrite").parquet(out)

    L.drain(s, write, "complete")
    return t.spark.read.parquet(out).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stream_elo_state")
def stream_elo_state(t):
    """Games land season after season, in several files each and in any order within them; a last row without a game moves the time past all."""
    g = t.league_games.select(F.col("kickoff").cast("timestamp").alias("kickoff"), "game_id", "season", "home", "away", "home_score", "away_score", "neutral", "league")
    path, out = scratch(t.spark, "games"), scratch(t.spark, "out")
    seasons = sorted(r[0] for r in g.select("season").distinct().collect())
    for season in seasons:
        g.where(F.col("season") == season).repartition(4).write.mode("append").parquet(path)
    end = g.agg((F.max("kickoff") + F.expr("INTERVAL 800 DAYS")).alias("kickoff")).select("kickoff", *[F.lit(None).cast(k).alias(c) for c, k in g.dtypes if c != "kickoff"])
    end.write.mode("append").parquet(path)
    with L.with_state(t.spark):
        s = L.rating_state(L.source(t.spark, path, g.schema, files=4), "league", Elo(edge_step=0.5), "kickoff", "400 days")
        L.drain(s, L.to_folder(out))
    return L.results(t.spark, out, s)


@query("stream_incremental_new_only", "SELECT key, count(*) > 0 AS valued FROM ledger GROUP BY key")
def stream_incremental_new_only(t):
    out = scratch(t.spark, "out")
    s = streamed(t, entries(t).select("key", "p"), "ledger")

    def write(batch, n):
        like = batch.select("key", F.lit(True).alias("valued"))
        L.new_only(like, L.results(batch.sparkSession, out, like), ["key"]).write.mode("overwrite").parquet(f"{out}/batch={n}")

    L.drain(s, write)
    return t.spark.read.parquet(out).drop("batch")
