"""As-of joins, decayed sums and other operators that never see the future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Queries and events in one table; q_ is 1 for a query, l_ holds its row, r_ an event's columns."""
    q = left.select(*[F.col(c).alias(f"k{i}_") for i, c in enumerate(by)], F.col(left_time).alias("t_"), F.lit(1).alias("q_"), F.struct(*left.columns).alias("l_"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("r_"))
    e = right.select(*[F.col(c).alias(f"k{i}_") for i, c in enumerate(by)], F.col(right_time).alias("t_"), F.lit(0).alias("q_"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("l_"), F.struct(*columns).alias("r_"))
    return q.unionByName(e)


def backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], strict: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """`left` with `columns` of the last event of the same key before it (at its time too if not strict).

    One shuffle by key and one sort serve both sides; of events at one time the
    last by `tie` (columns of `columns`) counts.
    """
    w = Window.partitionBy(*[f"k{i}_" for i in range(len(by))]).orderBy("t_", F.col("q_").desc() if strict else F.col("q_"), *[F.col(f"r_.{c}") for c in tie]).rowsBetween(Window.unboundedPreceding, -1)
    found = _merged(left, right, by, left_time, right_time, columns).withColumn("f_", F.last("r_", ignorenulls=True).over(w))
    return found.where("q_ = 1").select("l_.*", *[F.col(f"f_.{c}") for c in columns])


def forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], strict: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """`left` with `columns` of the first event of the same key after it."""
    w = Window.partitionBy(*[f"k{i}_" for i in range(len(by))]).orderBy("t_", F.col("q_") if strict else F.col("q_").desc(), *[F.col(f"r_.{c}") for c in tie]).rowsBetween(1, Window.unboundedFollowing)
    found = _merged(left, right, by, left_time, right_time, columns).withColumn("f_", F.first("r_", ignorenulls=True).over(w))
    return found.where("q_ = 1").select("l_.*", *[F.col(f"f_.{c}") for c in columns])


def snapshot(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str) -> DataFrame:
    """All rows of the last snapshot strictly before each row of `left`."""
    times = right.select(*by, F.col(right_time).alias("snap_time")).distinct()
    with_time = backward(left, times, by, left_time, "snap_time", ["snap_time"])
    return with_time.join(right.withColumnRenamed(right_time, "snap_time"), [*by, "snap_time"])


def prior_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], suffix: str = "_before") -> DataFrame:
    """Sums of the earlier rows of the key; 0 on the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{v}{suffix}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})


def period_sums_before(rows: DataFrame, by: Sequence[str], period: str, values: Sequence[str]) -> DataFrame:
    """Per key and period the sums of all earlier periods: rows are summed by period first, so the window is over periods, not rows."""
    sums = rows.groupBy(*by, period).agg(*[F.sum(v).alias(v) for v in values])
    w = Window.partitionBy(*by).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, period, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_before") for v in values])


def half_life(age: Column, life: float) -> Column:
    return F.pow(F.lit(0.5), age / life)


def decayed_values(rows: DataFrame, by: Sequence[str], period: str, num: str, den: str, life: float, prior: float, strength: float, alias: str = "value") -> DataFrame:
    """Per key and period: sums of the earlier periods, halved every `life` periods, shrunk to a prior.

    value = (sum w num + strength prior) / (sum w den + strength). The periods of
    a key meet each other, not its rows: rows are summed by key and period
    before the range join, whose size is that of a key's periods squared.
    """
    sums = rows.groupBy(*by, period).agg(F.sum(num).alias("num_"), F.sum(den).alias("den_"))
    past = sums.select(*by, F.col(period).alias("past_"), "num_", "den_")
    w = half_life(F.col(period) - F.col("past_"), life)
    met = sums.select(*by, period).join(past, list(by), "left").withColumn("w_", F.when(F.col("past_") < F.col(period), w))
    out = met.groupBy(*by, period).agg(F.coalesce(F.sum(F.col("w_") * F.col("num_")), F.lit(0.0)).alias("num_"), F.coalesce(F.sum(F.col("w_") * F.col("den_")), F.lit(0.0)).alias("den_"))
    return out.select(*by, period, F.try_divide(F.col("num_") + strength * prior, F.col("den_") + strength).alias(alias), F.col("den_").alias("weight"))


def nearest_earlier(left: DataFrame, right: DataFrame, by: Sequence[str], period: str, value: str, fallback: Column | None = None) -> DataFrame:
    """The value of the same period, else of the latest earlier one, else the fallback."""
    r = right.select(*by, F.col(period).alias("p_"), F.col(value).alias(value))
    out = backward(left, r, by, period, "p_", [value], strict=False)
    return out.withColumn(value, F.coalesce(value, fallback)) if fallback is not None else out


def as_of_view(df: DataFrame, time: str, now: Column, outcomes: Sequence[str], attributes: Sequence[str] = (), horizon_days: int = 7) -> DataFrame:
    """The table as it looked at `now`: outcomes of rows not yet begun are null, attributes too beyond the horizon."""
    later = F.col(time) >= now
    far = F.col(time) >= now + F.make_interval(days=F.lit(horizon_days))
    return df.withColumns({**{c: F.when(~later, F.col(c)) for c in outcomes}, **{c: F.when(~far, F.col(c)) for c in attributes}})


def lineup_terms(shares: DataFrame, values: DataFrame, asked: DataFrame, unit: Sequence[str], half: float, carry: float) -> DataFrame:
    """(unit, season, week, expected, remembered, last): what a unit's members are worth as of each week asked for.

    `shares` (unit, season, week, member, share) are the parts that members had
    in a unit's weeks, `values` (season, member) what a member is worth in a
    season. A week's worth at a season's values is the sum of both.
    `expected` is the worth of the unit's latest week before, `remembered` the
    mean of the earlier weeks of this season and the last one, halved every
    `half` weeks and times `carry` for the last season, `last` the plain mean of
    the last season. Where a unit has no week of the kind, the expected worth
    stands, else 0. Members without a value count 0. Weeks are summed by unit
    before they meet, so a unit meets at most two seasons of its own weeks.
    """
    units = list(unit)
    both = shares.select(*units, "season", "week", "member", "share", F.explode(F.array(F.col("season"), F.col("season") + 1)).alias("at_"))
    value = values.select(*[c for c in units if c in values.columns], F.col("season").alias("at_"), "member", "value")
    met = both.join(value, [c for c in value.columns if c != "value"], "left")
    worth = met.groupBy(*units, "at_", F.col("season").alias("t_"), F.col("week").alias("w_")).agg(F.sum(F.col("share") * F.coalesce("value", F.lit(0.0))).alias("c_"))
    now = asked.select(*units, "season", "week").distinct()
    age = (F.col("season") - F.col("t_")) * 53 + F.col("week") - F.col("w_")
    past = now.join(worth, units).where((F.col("at_") == F.col("season")) & (age > 0))
    w = half_life(age.cast("double"), half) * F.when(F.col("t_") < F.col("season"), carry).otherwise(1.0)
    last = F.when(F.col("t_") < F.col("season"), F.col("c_"))
    out = past.groupBy(*units, "season", "week").agg(F.min_by("c_", age).alias("expected"), (F.sum(w * F.col("c_")) / F.sum(w)).alias("remembered"), F.avg(last).alias("last"))
    rest = F.coalesce("expected", F.lit(0.0))
    return now.join(out, [*units, "season", "week"], "left").select(*units, "season", "week", rest.alias("expected"), F.coalesce("remembered", rest).alias("remembered"), F.coalesce("last", rest).alias("last"))


def decayed_mix(rows: DataFrame, values: DataFrame, by: Sequence[str], entity: str, weight: str, value: str) -> DataFrame:
    """Weighted mean of entities' values over each group's own rows."""
    met = rows.join(values.select(entity, value), entity)
    return met.groupBy(*by).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mix"))


def corrupt_after(df: DataFrame, time: str, cut: Column, numeric: Sequence[str], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Numbers of the rows at or after the cut are replaced by hashed noise from -1 to 1, for tests of point-in-time builders.

    Noise that happens to be the number itself is moved by a half, so that every such row changes.
    """
    noise = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *keys), F.lit(2_000_001)) / 1e6 - 1.0
    other = lambda c: F.when(F.col(c) == noise(c), noise(c) + F.when(noise(c) > 0, -0.5).otherwise(0.5)).otherwise(noise(c))
    return df.withColumns({c: F.when(F.col(time) >= cut, other(c)).otherwise(F.col(c)) for c in numeric})


def changed_keys(clean: DataFrame, dirty: DataFrame, keys: Sequence[str], columns: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Per column, how many keys differ between two builds of the same table."""
    both = clean.join(dirty.select(*keys, *[F.col(c).alias(f"{c}_dirty") for c in columns]), list(keys))
    differs = lambda c: F.when(F.col(c).isNull() | F.col(f"{c}_dirty").isNull(), ~F.col(c).eqNullSafe(F.col(f"{c}_dirty"))).otherwise(F.abs(F.col(c) - F.col(f"{c}_dirty")) > tol)
    return both.agg(F.count("*").alias("n_keys"), *[F.count_if(differs(c)).alias(f"{c}_changed") for c in columns])
