"""Window operators over ordered rows of a key."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from gridlore.sources.files import settled


def week_ordinals(df: DataFrame, season: str = "season", week: str = "week") -> DataFrame:
    """(season, week, ord): places on a timeline of the weeks that occur; the window is over weeks, not rows."""
    return df.select(season, week).distinct().withColumn("ord", F.row_number().over(Window.orderBy(season, week)) - 1)


def period_start(df: DataFrame, by: Sequence[str], time: str, when: Column | None = None, alias: str = "as_of") -> DataFrame:
    """The earliest time of the row's period (of rows that satisfy `when`), never later than the row's own."""
    t = F.col(time) if when is None else F.when(when, F.col(time))
    return df.withColumn(alias, F.least(F.col(time), F.min(t).over(Window.partitionBy(*by))))


def calendar_week(date: Column, first: Column) -> Column:
    """Weeks run from Tuesday to Monday; the one of the season's first date is 1."""
    tuesday = F.date_sub(first, (F.dayofweek(first) + 4) % 7)
    return (F.floor(F.datediff(date, tuesday) / 7) + 1).cast("int")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], **exprs: Column) -> DataFrame:
    """Each expression aggregated over the rows up to this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: v.over(w) for k, v in exprs.items()})


def before(df: DataFrame, by: Sequence[str], order: Sequence[str], **exprs: Column) -> DataFrame:
    """Each expression aggregated over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({k: v.over(w) for k, v in exprs.items()})


def rolling(df: DataFrame, by: Sequence[str], order: Sequence[str], back: int, following: int = 0, /, **exprs: Column) -> DataFrame:
    """Each expression aggregated over `back` rows before to `following` rows after."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-back, following)
    return df.withColumns({k: v.over(w) for k, v in exprs.items()})


def next_where(df: DataFrame, by: Sequence[str], order: Sequence[str], when: Column, value: Column, alias: str) -> DataFrame:
    """The value of the next row that satisfies the predicate."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(alias, F.first(F.when(when, value), ignorenulls=True).over(w))


def last_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], when: Column | None = None) -> DataFrame:
    """The last row of each key, by an aggregate: no sort, and hot keys are combined before the shuffle."""
    rows = df if when is None else df.where(when)
    return rows.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("s_")).select(*by, *[F.col(f"s_.{c}") for c in columns])


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alias: str = "block") -> DataFrame:
    """The number of the run of equal values that a row is in."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("new_", new).withColumn(alias, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits each task to n rows a group before the shuffle."""
    return df.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k_") <= n).drop("k_")


def best_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The names of the greatest and second of several columns, and the margin; equal values by name."""
    pairs = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("name")) for c in columns]))
    return df.withColumn("s_", pairs).withColumns({"best": F.col("s_")[0]["name"], "second": F.col("s_")[1]["name"], "margin": F.col("s_")[1]["v"] - F.col("s_")[0]["v"]}).drop("s_")


#: Steps of a tie ladder whose values depend on who is tied; every other step is a column of the teams.
AMONG = ("h2h", "sweep", "common", "common4", "common_net")


def _step(step: str, facts: dict, met: dict, tied: list) -> dict:
    """The values of a step for the tied teams, the higher the better; None if it doesn't apply to one of them.

    `facts` are the columns of a team, `met` its (games, won, net) against each opponent.
    """
    if step not in AMONG:
        return {t: None if facts[t][step] is None or facts[t][step] != facts[t][step] else float(facts[t][step]) for t in tied}
    among = set(tied) if step in ("h2h", "sweep") else set.intersection(*[set(met[t]) for t in tied])
    own = {t: [x for o, x in met[t].items() if o in among] for t in tied}
    if step == "common_net":
        return {t: float(sum(x[2] or 0.0 for x in own[t])) for t in tied}
    games = {t: sum(x[0] for x in own[t]) for t in tied}
    rate = {t: sum(x[1] for x in own[t]) / games[t] if games[t] else None for t in tied}
    if step == "common4":
        return {t: rate[t] if games[t] >= 4 else None for t in tied}
    if step == "sweep" and len(tied) > 2:
        beat = {t: len(own[t]) == len(tied) - 1 and rate[t] == 1 for t in tied}
        lost = {t: len(own[t]) == len(tied) - 1 and rate[t] == 0 for t in tied}
        return {t: float(beat[t]) if any(beat.values()) else float(not lost[t]) for t in tied}
    return rate


def _pick(facts: dict, met: dict, tied: list, steps: Sequence[str]) -> object:
    """The team that wins a tie; the first of `tied` if no step parts them."""
    at = 0
    while len(tied) > 1 and at < len(steps):
        v = _step(steps[at], facts, met, tied)
        best = [x for x in tied if v[x] >= max(v.values()) - 1e-9] if all(x is not None for x in v.values()) else tied
        tied, at = (best, 0) if len(best) < len(tied) else (tied, at + 1)
    return tied[0]


def tie_ladder(rows: DataFrame, teams: DataFrame, by: Sequence[str], group: Sequence[str], score: str, steps: Sequence[str], best_of: tuple[str, str] | None = None) -> DataFrame:
    """(by, group, team, place): places by `score` within (by, group), ties broken by steps that start anew with those left.

    `rows` are side rows (by, team, opp, result, margin); `teams` has by, group,
    team, score and a column for each step outside AMONG. A step leaves the best
    of a tie: a single one takes the next place, fewer than before begin again
    at the first step. Steps that don't apply to all are passed over, and if none
    parts the tied, the least `team` goes first. After each pick the rest are
    compared anew. With `best_of`, (division, place), only the team of the least
    place of each division competes for a pick.

    Only tied teams leave the window. Their games are summed by pair first, so
    that a group has one row for each pair of a tied team and an opponent. Ties
    follow one another in a sorted partition; a task holds one of them.
    """
    w = Window.partitionBy(*by, *group)
    ranked = teams.withColumn("s_", F.round(score, 9)).withColumn("first_", F.rank().over(w.orderBy(F.desc_nulls_last("s_")))).withColumn("n_", F.count("*").over(Window.partitionBy(*by, *group, "s_")))
    alone = ranked.where("n_ = 1").select(*by, *group, "team", F.col("first_").alias("place"))
    static = [s for s in steps if s not in AMONG] + list(best_of or ())
    tied = ranked.where("n_ > 1").select(*by, *group, "first_", "team", *dict.fromkeys(static))
    pairs = rows.where(F.col("result").isNotNull()).groupBy(*by, "team", "opp").agg(F.count("*").alias("games_"), F.sum("result").cast("double").alias("won_"), F.sum("margin").cast("double").alias("net_"))
    keys = [*by, *group, "first_"]

    def order(rows: list[dict]) -> list:
        facts = {r["team"]: r for r in reversed(rows)}
        met: dict = {t: {} for t in facts}
        for r in rows:
            if r["games_"]:
                met[r["team"]][r["opp"]] = (r["games_"], r["won_"], r["net_"])
        left, out = sorted(facts), []
        while left:
            rivals = left
            if best_of:
                ahead: dict = {}
                for t in left:
                    at = ahead.get(facts[t][best_of[0]])
                    if at is None or facts[t][best_of[1]] < facts[at][best_of[1]]:
                        ahead[facts[t][best_of[0]]] = t
                rivals = [t for t in left if ahead[facts[t][best_of[0]]] == t]
            out.append(_pick(facts, met, rivals, steps))
            left = [t for t in left if t != out[-1]]
        return out

    def ordered(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        done: dict = {c: [] for c in arrow.names}
        for key, own in itertools.groupby(rows, lambda r: tuple(r[c] for c in keys)):
            for k, team in enumerate(order(list(own))):
                for c, v in zip(arrow.names, (*key[:-1], team, key[-1] + k), strict=True):
                    done[c].append(v)
            if len(done["place"]) >= 10_000:
                yield pa.RecordBatch.from_pydict(done, arrow)
                done = {c: [] for c in arrow.names}
        if done["place"]:
            yield pa.RecordBatch.from_pydict(done, arrow)

    schema = StructType([*[tied.schema[c] for c in (*keys[:-1], "team")], StructField("place", IntegerType())])
    arrow = to_arrow_schema(schema)
    dealt = tied.join(pairs, [*by, "team"], "left").repartition(*keys).sortWithinPartitions(*keys)
    return alone.union(dealt.mapInArrow(ordered, schema))


def combined_ranks(teams: DataFrame, by: Sequence[str], scored: str, allowed: str, alias: str) -> DataFrame:
    """The teams with minus the sum of their ranks in points scored and in points allowed, so that more is better; equal points share a rank."""
    w = Window.partitionBy(*by)
    ranks = F.rank().over(w.orderBy(F.desc(scored))) + F.rank().over(w.orderBy(allowed))
    return teams.withColumn(alias, -ranks.cast("double"))


def seed_field(rows: DataFrame, teams: DataFrame, by: Sequence[str], division: str, conference: str, score: str, division_steps: Sequence[str], steps: Sequence[str], seeds: int) -> DataFrame:
    """(by, conference, team, seed) of each conference's first `seeds`: the winners of divisions ahead of the rest.

    Divisions are ordered by their own ladder. Winners are then ordered among
    each other, and the others after them, by `steps` with only the best team of
    a division competing for a pick. A division of one team has that as winner.
    The teams with their places are written once to the shared folder.
    """
    places = tie_ladder(rows, teams, by, [division], score, division_steps).select(*by, "team", F.col("place").alias("at_"))
    table = settled(teams.join(places, [*by, "team"]), "places")
    first = tie_ladder(rows, table.where("at_ = 1"), by, [conference], score, steps, (division, "at_"))
    rest = tie_ladder(rows, table.where("at_ > 1"), by, [conference], score, steps, (division, "at_"))
    winners = table.where("at_ = 1").groupBy(*by, conference).agg(F.count("*").cast("int").alias("w_"))
    after = rest.join(winners, [*by, conference]).withColumn("place", F.col("place") + F.col("w_")).drop("w_")
    return first.unionByName(after).where(F.col("place") <= seeds).withColumnRenamed("place", "seed")
