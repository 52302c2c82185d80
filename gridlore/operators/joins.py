"""Joins: strict lookups, validity ranges, bands, fallbacks, overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000
#: Parts that a group's rows are dealt to in `with_members`, and its tasks for each core.
MEMBER_PARTS, MEMBER_TASKS = 8, 8


def checked(left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join whose right side is broadcast only after its rows, counted up to the bound, are few."""
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def lookup_strict(left: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attach columns of a dimension; a key of `left` that it lacks is an error."""
    missing = left.select(*on).join(dim.select(*on), list(on), "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"keys without a match: {[tuple(r) for r in missing]}")
    return left.join(dim.select(*on, *columns), list(on))


def dated(left: DataFrame, dim: DataFrame, key: str, at: str, first: str, last: str) -> DataFrame:
    """Join a dimension on key where `at` lies in its validity range."""
    d = dim.withColumnRenamed(key, "key_")
    return left.join(d, (left[key] == d["key_"]) & left[at].between(d[first], d[last]), "left").drop("key_", first, last)


def band_count(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, band: float, alias: str = "n_similar") -> DataFrame:
    """For each row, how many rows of `right` have its keys and a value within the band.

    Values are cut into cells as wide as the band, so a row meets only its own
    cell and the two beside it, by equi-join; counts of equal values are
    combined before.
    """
    cell = lambda c: F.floor(F.col(c) / band)
    counts = right.groupBy(*on, value).agg(F.count("*").alias("n_")).select(*[F.col(c).alias(f"{c}_r") for c in on], F.col(value).alias("v_"), "n_", cell(value).alias("cell_r"))
    points = left.select(*on, value).distinct()
    near = points.select(*on, value, F.explode(F.sequence(cell(value) - 1, cell(value) + 1)).alias("cell_"))
    met = near.join(counts, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on] + [F.col("cell_") == F.col("cell_r")], "left")
    hits = F.when(F.abs(F.col(value) - F.col("v_")) <= band, F.col("n_"))
    found = met.groupBy(*on, value).agg(F.coalesce(F.sum(hits), F.lit(0)).alias(alias))
    renamed = found.withColumnsRenamed({c: f"{c}_l" for c in [*on, value]})
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"{c}_l")) for c in [*on, value]]).drop(*[f"{c}_l" for c in [*on, value]])


def outer_fill(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join; a column is a's, or b's where a has none."""
    r = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(r, list(on), "full_outer").select(*on, *[F.coalesce(c, f"{c}_b").alias(c) for c in columns])


def override(base: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of `other`, and those of `base` whose key it lacks."""
    return base.join(other.select(*on), list(on), "left_anti").unionByName(other)


def with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str], alias: str = "matched") -> DataFrame:
    keys = right.select(*on).distinct().withColumn(alias, F.lit(True))
    return left.join(keys, list(on), "left").withColumn(alias, F.coalesce(alias, F.lit(False)))


def one_to_one(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left joins of several tables on a key that must be unique in each."""
    for t in tables:
        if t.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"key {list(on)} is not unique")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(on), "left")
    return out


def sides_lookup(games: DataFrame, dim: DataFrame, on: Sequence[str], value: str, home: str = "home", away: str = "away", default: float = 0.0) -> DataFrame:
    """Two lookups of one dimension, as {value}_home and {value}_away."""
    for side in (home, away):
        r = dim.select(*[F.col(c).alias(f"{c}_l") for c in on], F.col("team").alias("team_l"), F.col(value).alias(f"{value}_{side}"))
        games = games.join(r, [games[c] == r[f"{c}_l"] for c in on] + [games[side] == r["team_l"]], "left").drop("team_l", *[f"{c}_l" for c in on])
    return games.withColumns({f"{value}_{s}": F.coalesce(f"{value}_{s}", F.lit(default)) for s in (home, away)})


def with_members(rows: DataFrame, members: DataFrame, on: Sequence[str], member: str, deal: str) -> DataFrame:
    """Each row of `rows` with each member of its group: the inner join, repeated and null members too; null groups match nothing.

    What comes out is many times what goes in, and AQE would set tasks by the
    bytes that go in, so their number is given. A group's members travel as one
    list; its rows are dealt by `deal` to parts that each meet a copy of the
    list, so that a large group takes several tasks. The merge join spills.
    """
    none = F.array_repeat(F.lit(None).cast(members.schema[member].dataType), F.count_if(F.col(member).isNull()).cast("int"))
    lists = members.groupBy(*on).agg(F.concat(F.collect_list(member), none).alias("members_")).withColumn("part_", F.explode(F.array(*[F.lit(k) for k in range(MEMBER_PARTS)])))
    tasks = MEMBER_TASKS * rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.withColumn("part_", F.pmod(F.hash(deal), F.lit(MEMBER_PARTS))).repartition(tasks, *on, "part_")
    return dealt.join(lists.hint("merge"), [*on, "part_"]).withColumn(member, F.explode("members_")).drop("part_", "members_")


def ordered_override(default: Column, rules: Sequence[tuple[Column, Column]]) -> Column:
    """The value of the first rule that holds, else the default."""
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return default if out is None else out.otherwise(default)


def changed(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Flags, by alias, of columns whose values differ between two tables; null equals null."""
    r = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in columns.values()])
    return a.join(r, list(on), "left").select(*on, *[(~F.col(c).eqNullSafe(F.col(f"{c}_b"))).cast("int").alias(n) for n, c in columns.items()])
