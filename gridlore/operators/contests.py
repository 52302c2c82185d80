"""Operators on tables of contests between two sides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(mine: str, theirs: str) -> Column:
    """1, 0.5 or 0; null if a score is missing."""
    return F.when(F.col(mine) > F.col(theirs), 1.0).when(F.col(mine) == F.col(theirs), 0.5).when(F.col(mine) < F.col(theirs), 0.0)


def unpivot_sides(df: DataFrame, keys: Sequence[str], home: str = "home", away: str = "away", mirrored: Mapping[str, tuple[str, str]] | None = None, flipped: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each side of a contest: keys, team, opp, is_home, mirrored pairs as name and name_opp, flipped columns as 1 - x for the away side."""

    def side(mine: str, theirs: str, at_home: bool) -> Column:
        pairs = [x for n, (h, a) in (mirrored or {}).items() for x in (F.col(h if at_home else a).alias(n), F.col(a if at_home else h).alias(f"{n}_opp"))]
        flips = [(F.col(c) if at_home else 1 - F.col(c)).alias(n) for n, c in (flipped or {}).items()]
        return F.struct(F.col(mine).alias("team"), F.col(theirs).alias("opp"), F.lit(at_home).alias("is_home"), *pairs, *flips)

    return df.select(*keys, F.explode(F.array(side(home, away, True), side(away, home, False))).alias("s_")).select(*keys, "s_.*")


def pair_sides(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The inverse of `unpivot_sides`: one row for each contest with home_ and away_ columns."""
    cols = ["team", *values]
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("is_home") == at, F.col(c))).alias(f"{n}_{c}") for at, n in ((True, "home"), (False, "away")) for c in cols])


def pair_key(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("side_a"), F.greatest(a, b).alias("side_b")]


def nth_meeting(df: DataFrame, by: Sequence[str], home: str, away: str, order: Sequence[str]) -> DataFrame:
    """The number, from 0, of each meeting of an unordered pair."""
    w = Window.partitionBy(*by, F.least(home, away), F.greatest(home, away)).orderBy(*order)
    return df.withColumn("meeting", F.row_number().over(w) - 1)


def expand_ties(df: DataFrame, y: str, weight: str = "weight") -> DataFrame:
    """Rows with an outcome of 0.5 become a win and a loss of half the weight."""
    tie = F.col(y) == 0.5
    out = df.withColumn(weight, F.when(tie, 0.5).otherwise(1.0))
    return out.withColumn(y, F.explode(F.when(tie, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.col(y)))))


def side_difference(games: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, alias: str, home: str = "home", away: str = "away", default: float | None = None) -> DataFrame:
    """Home minus away of a value looked up by (keys, team)."""
    look = rows.select(*keys, F.col("team").alias("t_"), F.col(value).alias("v_"))
    for side in (home, away):
        right = look.withColumnsRenamed({"t_": f"t_{side}", "v_": f"v_{side}"})
        games = games.join(right.withColumnsRenamed({k: f"{k}_{side}" for k in keys}), [games[k] == F.col(f"{k}_{side}") for k in keys] + [games[side] == F.col(f"t_{side}")], "left").drop(*[f"{k}_{side}" for k in keys], f"t_{side}")
    values = [F.coalesce(F.col(f"v_{s}"), F.lit(default)) if default is not None else F.col(f"v_{s}") for s in (home, away)]
    return games.withColumn(alias, values[0] - values[1]).drop(f"v_{home}", f"v_{away}")


def records(rows: DataFrame, by: Sequence[str], result: str = "result") -> DataFrame:
    """Wins, losses, ties and the percentage of side rows whose result is 1, 0.5 or 0."""
    r = F.col(result)
    return rows.groupBy(*by).agg(F.count(r).alias("games"), F.count_if(r == 1).alias("wins"), F.count_if(r == 0).alias("losses"), F.count_if(r == 0.5).alias("ties"), F.avg(r).alias("pct"))


def standings(rows: DataFrame, by: Sequence[str], teams: DataFrame, group: str = "division") -> DataFrame:
    """Record, in-group record, points, strength of schedule and of victory of each team.

    `rows` are side rows with result, points and points_opp; `teams` gives each
    team's group. Strength of schedule pools the records of all opponents met,
    strength of victory of those beaten.
    """
    own, theirs = teams.select(F.col("team"), F.col(group).alias("group_")), teams.select(F.col("team").alias("opp"), F.col(group).alias("group_opp_"))
    rows = rows.join(own, "team").join(theirs, "opp")
    same = F.col("group_") == F.col("group_opp_")
    base = rows.groupBy(*by, "team").agg(F.count("result").alias("games"), F.sum("result").alias("points_won"), F.avg("result").alias("pct"), F.avg(F.when(same, F.col("result"))).alias("group_pct"), F.sum("points").alias("scored"), F.sum("points_opp").alias("allowed"))
    opp = base.select(*by, F.col("team").alias("opp"), F.col("points_won").alias("won_"), F.col("games").alias("games_"))
    met = rows.select(*by, "team", "opp", "result").join(opp, [*by, "opp"])
    strength = met.groupBy(*by, "team").agg((F.sum("won_") / F.sum("games_")).alias("sos"), (F.sum(F.when(F.col("result") == 1, F.col("won_"))) / F.sum(F.when(F.col("result") == 1, F.col("games_")))).alias("sov"))
    return base.join(strength, [*by, "team"]).withColumn("net", F.col("scored") - F.col("allowed"))


def head_to_head(rows: DataFrame, groups: DataFrame, by: Sequence[str], group: str = "tie_group") -> DataFrame:
    """Record of each team against the other members of its tie group, and whether it swept or was swept by all of them."""
    mine = groups.select(*by, "team", F.col(group).alias("g_"))
    other = groups.select(*by, F.col("team").alias("opp"), F.col(group).alias("g_opp_"))
    met = rows.join(mine, [*by, "team"]).join(other, [*by, "opp"]).where("g_ = g_opp_")
    size = groups.groupBy(*by, F.col(group).alias("g_")).agg(F.count("*").alias("size_"))
    out = met.groupBy(*by, "g_", "team").agg(F.count("*").alias("h2h_games"), F.avg("result").alias("h2h_pct"), F.count_distinct("opp").alias("met_"), F.min("result").alias("lo_"), F.max("result").alias("hi_"))
    every = F.col("met_") == F.col("size_") - 1
    return out.join(size, [*by, "g_"]).select(*by, F.col("g_").alias(group), "team", "h2h_games", "h2h_pct", F.when(every & (F.col("lo_") == 1), 1).when(every & (F.col("hi_") == 0), -1).otherwise(0).alias("sweep"))


def common_opponents(rows: DataFrame, groups: DataFrame, by: Sequence[str], group: str = "tie_group", minimum: int = 1) -> DataFrame:
    """Record of each member of a tie group against the opponents that all members met; groups with fewer common games than `minimum` are left out."""
    met = rows.join(groups.select(*by, "team", F.col(group).alias("g_")), [*by, "team"])
    size = groups.groupBy(*by, F.col(group).alias("g_")).agg(F.count("*").alias("size_"))
    shared = met.groupBy(*by, "g_", "opp").agg(F.count_distinct("team").alias("n_")).join(size, [*by, "g_"]).where("n_ = size_").select(*by, "g_", "opp")
    out = met.join(shared, [*by, "g_", "opp"], "left_semi").groupBy(*by, "g_", "team").agg(F.count("*").alias("common_games"), F.avg("result").alias("common_pct"))
    return out.where(F.col("common_games") >= minimum).withColumnRenamed("g_", group)


def expected_home(home: Column, away: Column, edge: Column | float = 0.0, scale: float = 400.0) -> Column:
    """Logistic expectation, base 10, of the home side."""
    edge = edge if isinstance(edge, Column) else F.lit(float(edge))
    return 1 / (1 + F.pow(F.lit(10.0), -(home + edge - away) / scale))


def implied_probability(moneyline: Column) -> Column:
    return F.when(moneyline < 0, -moneyline / (100 - moneyline)).otherwise(100 / (100 + moneyline))
