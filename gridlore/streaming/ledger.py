"""Structured Streaming forms of the ledger, its joins and its windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlore.operators.folds import _EloState
from gridlore.sources.files import scratch


def source(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all that is there now, one batch after another, with its checkpoint in the shared folder."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession, "stream")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder by number, so that a batch run again replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def results(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What the sink has, or an empty table of the stream's columns."""
    try:
        return spark.read.parquet(path).drop("batch")
    except AnalysisException as e:
        if not {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"} & {e.getCondition() or ""}:
            raise
        return spark.createDataFrame([], like.schema)


def split_late(rows: DataFrame, at: str, deadline: str) -> tuple[DataFrame, DataFrame]:
    """Rows before their deadline, and the others."""
    on_time = F.coalesce(F.col(at) < F.col(deadline), F.lit(False))
    return rows.where(on_time), rows.where(~on_time)


def latest(rows: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The last row so far of each key: one row of state a key, emitted again whenever a batch moves it on."""
    return rows.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("s_")).select(key, f"s_.{at}", *[f"s_.{c}" for c in columns])


def new_only(batch: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key the sink has not, each key once."""
    return batch.dropDuplicates(list(keys)).join(done.select(*keys), list(keys), "left_anti")


def guarded(path: str, columns: Sequence[str], run: str) -> Callable[[DataFrame, int], None]:
    """A sink for runs whose time has to rise: rows of a run that isn't later than all earlier batches go to a folder of refused rows.

    A batch compares itself with the batches before it only, and writes to its
    own folder, so one that is run again after a failure changes nothing. A
    batch of other columns is an error, and nothing of it is written.
    """

    def write(batch: DataFrame, n: int) -> None:
        if list(batch.columns) != list(columns):
            raise ValueError(f"columns {batch.columns}, not {list(columns)}")
        spark = batch.sparkSession
        try:
            last = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < n).agg(F.max(run)).first()[0]
        except AnalysisException as e:
            if not {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"} & {e.getCondition() or ""}:
                raise
            last = None
        fresh = F.coalesce(F.col(run) > F.lit(last), F.lit(False)) if last is not None else F.col(run).isNotNull()
        batch.where(fresh).write.mode("overwrite").parquet(f"{path}/batch={n}")
        batch.where(~fresh).write.mode("overwrite").parquet(f"{path}-refused/batch={n}")

    return write


class _Ratings(StatefulProcessor):
    """A league's ratings, an entry for each team, its games that wait for their time, and a clock.

    A batch appends a league's games as one row of columns and has one timer, at the first
    game that waits; when it comes, all games whose time has come are played,
    and what is left waits for the next one. Games are never a call each.
    """

    def __init__(self, cfg, team: str) -> None:
        self.cfg, self.team = cfg, team

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getValueState("ratings", f"team array<{self.team}>, rating array<double>")
        kinds = {"at": "long", "game_id": "long", "season": "int", "home": self.team, "away": self.team, "home_score": "double", "away_score": "double", "neutral": "boolean"}
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{k}>" for c, k in kinds.items()))
        self.head = handle.getValueState("head", "season int, edge double, first boolean")
        self.timer = handle.getValueState("timer", "at long")

    @staticmethod
    def _columns(games: list) -> tuple:
        return tuple(list(c) for c in zip(*games, strict=True))

    def _wake(self, first: int) -> None:
        """A timer at the end of the day of the first game that waits."""
        day = -(-first // 86_400_000) * 86_400_000
        self.handle.registerTimer(day)
        self.timer.update((day,))

    def handleInputRows(self, key, rows, timerValues):
        came = []
        score = lambda x: None if x is None or x != x else float(x)
        plain = lambda x: x.item() if hasattr(x, "item") else x
        for pdf in rows:
            for r in pdf.itertuples():
                if r.game_id is None or r.game_id != r.game_id:  # only the time counts
                    continue
                came.append((int(r.ms), int(r.game_id), int(r.season), plain(r.home), plain(r.away), score(r.home_score), score(r.away_score), bool(r.neutral)))
        if came:
            self.waiting.appendValue(self._columns(came))
            first = min(game[0] for game in came)
            if not self.timer.exists() or first <= self.timer.get()[0] - 86_400_000:
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        held = {game[:2]: game for part in self.waiting.get() for game in zip(*part, strict=True)}  # a game that came twice is as it came last
        due = [held.pop(k) for k in sorted(k for k in held if k[0] <= until)]
        if held:
            self._wake(min(k[0] for k in held))
        else:
            self.timer.clear()
        if not due:
            return
        if held:
            self.waiting.put([self._columns(list(held.values()))])
        else:
            self.waiting.clear()
        elo = _EloState(self.cfg)
        elo.r = dict(zip(*self.ratings.get(), strict=True)) if self.ratings.exists() else {}
        if self.head.exists():
            elo.season, elo.edge, elo.first = self.head.get()
        out = []
        for _, game, season, *rest in due:
            out.append((key[0], game, *elo.play(season, *rest)[2:5]))
        if elo.r:
            self.ratings.update((list(elo.r), [float(v) for v in elo.r.values()]))
        self.head.update((elo.season, float(elo.edge), elo.first))
        yield pd.DataFrame(out, columns=["league", "game_id", "p_elo", "home_post", "away_post"])

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def rating_state(rows: DataFrame, league: str, cfg, at: str, delay: str) -> DataFrame:
    """Ratings as keyed state: one row for each game, played once the watermark has passed its time.

    State is a rating for each team, the games that wait, the season with the
    home edge, and the next time to play. A game that comes before its time waits in state for a timer,
    so any two orders of arrival within `delay` give the same ratings. One that
    comes later than that is dropped by Spark and counted in the query's
    progress; it stops nothing. Rows with a null game_id only move the time on.
    State has to be in the RocksDB store: start the stream under `with_state`.
    """
    kinds = dict(rows.dtypes)
    games = rows.withColumn("at", F.col(at)).withWatermark("at", delay).withColumn("ms", F.unix_millis("at")).select(league, "at", "ms", *["game_id", "season", "home", "away", "home_score", "away_score", "neutral"])
    return games.groupBy(league).transformWithStateInPandas(_Ratings(cfg, kinds["home"]), f"league {kinds[league]}, game_id long, p_elo double, home_post double, away_post double", "Append", "EventTime")


@contextmanager
def with_state(spark: SparkSession):
    """Streams started here keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before is not None else spark.conf.unset(STATE_STORE)
