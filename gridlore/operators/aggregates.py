"""Aggregations: shrinkage, hierarchies, credit, shares, modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Rows and the sum of each named expression."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def pooled_rate(cur: str, prev: str, n_cur: str, n_prev: str, weight: float) -> Column:
    """(cur + w prev) / (n_cur + w n_prev), null if both are empty."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    den = zero(n_cur) + weight * zero(n_prev)
    return F.when(den > 0, (zero(cur) + weight * zero(prev)) / den)


def shrunk(num: Column, den: Column, strength: float, prior: Column | float) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (num + strength * prior) / (den + strength)


def hierarchical_rate(df: DataFrame, levels: Sequence[str], value: str, strength: float) -> DataFrame:
    """A rate for each cell of the last level, shrunk to its parent's shrunk rate, and so on up to the overall mean.

    One rollup counts every level; parents are joined by their keys, which are
    few.
    """
    cube = df.rollup(*levels).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.grouping_id().alias("g_"))
    whole = 2 ** len(levels) - 1
    parent = cube.where(f"g_ = {whole}").select((F.col("s") / F.col("n")).alias("rate"))
    for i in range(1, len(levels) + 1):
        keys = list(levels[:i])
        level = cube.where(f"g_ = {2 ** (len(levels) - i) - 1}").select(*keys, "n", "s")
        up = parent.withColumnRenamed("rate", "up_")
        joined = level.join(up, keys[:-1]) if i > 1 else level.join(F.broadcast(up))
        parent = joined.select(*keys, "n", shrunk(F.col("s"), F.col("n"), strength, F.col("up_")).alias("rate")) if i == len(levels) else joined.select(*keys, shrunk(F.col("s"), F.col("n"), strength, F.col("up_")).alias("rate"))
    return parent


def hierarchical_distribution(df: DataFrame, levels: Sequence[str], outcome: str, strength: float) -> DataFrame:
    """Per cell and outcome the smoothed share: a cell's shares are shrunk to its parent's, level after level."""
    classes = df.select(outcome).distinct()
    overall = df.groupBy(outcome).agg(F.count("*").alias("c_")).select(outcome, (F.col("c_") / F.sum("c_").over(Window.partitionBy())).alias("share"))
    parent = overall
    for i in range(1, len(levels) + 1):
        keys = list(levels[:i])
        cells = df.groupBy(*keys).agg(F.count("*").alias("n_"))
        counts = df.groupBy(*keys, outcome).agg(F.count("*").alias("c_"))
        grid = cells.join(F.broadcast(classes)).join(counts, [*keys, outcome], "left")
        up = parent.withColumnRenamed("share", "up_")
        parent = grid.join(up, [*keys[:-1], outcome]).select(*keys, outcome, shrunk(F.coalesce("c_", F.lit(0)), F.col("n_"), strength, F.col("up_")).alias("share"))
    return parent


def backoff_level(df: DataFrame, levels: Sequence[Sequence[str]], minimum: int) -> DataFrame:
    """Rows with the count of each grouping level and the first level that has `minimum` rows (the number of levels if none has)."""
    out = df
    for i, keys in enumerate(levels):
        counts = df.groupBy(*keys).agg(F.count("*").alias(f"n{i}"))
        out = out.join(counts, list(keys))
    level = F.coalesce(*[F.when(F.col(f"n{i}") >= minimum, F.lit(i)) for i in range(len(levels))], F.lit(len(levels)))
    return out.withColumn("level", level)


def mode(df: DataFrame, by: Sequence[str], value: str, tie: Column | None = None) -> DataFrame:
    """The most frequent value of each key; of equal counts the smallest `tie` (the value itself unless given)."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), (F.min(tie) if tie is not None else F.first(value)).alias("t_"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "t_", value)
    return counts.withColumn("k_", F.row_number().over(w)).where("k_ = 1").select(*by, value, "n")


def explode_credit(df: DataFrame, ids: Sequence[str], value: str, weights: Sequence[float] | None = None, entity: str = "entity") -> DataFrame:
    """One row for each non-null id of a row; its value is split by the ids' weights, equal unless given."""
    pairs = F.filter(F.array(*[F.struct(F.col(c).alias("id"), F.lit(float(w)).alias("w")) for c, w in zip(ids, weights or [1.0] * len(ids), strict=True)]), lambda x: x["id"].isNotNull())
    total = F.aggregate(F.col("p_"), F.lit(0.0), lambda a, x: a + x["w"])
    out = df.withColumn("p_", pairs).withColumn("t_", total).withColumn("e_", F.explode("p_"))
    return out.withColumns({entity: F.col("e_.id"), "credit": F.col(value) * F.col("e_.w") / F.col("t_")}).drop("p_", "t_", "e_")


def leave_one_out(df: DataFrame, group: Sequence[str], num: str, den: str, strength: float, prior: float, alias: str = "vs_others") -> DataFrame:
    """An entity's rate minus the shrunk rate of the others in its group."""
    w = Window.partitionBy(*group)
    others = shrunk(F.sum(num).over(w) - F.col(num), F.sum(den).over(w) - F.col(den), strength, prior)
    return df.withColumn(alias, F.col(num) / F.col(den) - others)


def lookback_mean(df: DataFrame, by: Sequence[str], period: str, num: str, den: str, back: int, alias: str = "mean") -> DataFrame:
    """Pooled mean of the `back` periods before; the first period takes its own."""
    sums = df.groupBy(*by, period).agg(F.sum(num).alias("num_"), F.sum(den).alias("den_"))
    w = Window.partitionBy(*by).orderBy(period).rangeBetween(-back, -1)
    past = F.sum("num_").over(w) / F.sum("den_").over(w)
    return sums.select(*by, period, F.coalesce(past, F.col("num_") / F.col("den_")).alias(alias))


def share_of_total(df: DataFrame, value: str, by: Sequence[str], alias: str = "share") -> DataFrame:
    return df.withColumn(alias, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def bucket(c: Column, edges: Sequence[float]) -> Column:
    """The number of edges that the value reaches: 0 below the first."""
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def with_total(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], label: str = "ALL") -> DataFrame:
    """Aggregates of each group and of all rows, under the label, by one rollup."""
    keys = [F.col(k).cast("string").alias(k) for k in by]
    out = df.select("*", *[k.alias(f"{n}_") for k, n in zip(keys, by, strict=True)]).rollup(*[f"{n}_" for n in by]).agg(*aggs, F.grouping_id().alias("g_"))
    whole = 2 ** len(by) - 1
    return out.where(f"g_ = 0 or g_ = {whole}").select(*[F.when(F.col("g_") == whole, F.lit(label)).otherwise(F.col(f"{n}_")).alias(n) for n in by], *[c for c in out.columns if c not in {"g_", *(f"{n}_" for n in by)}])


def extremes(df: DataFrame, by: Sequence[str], value: str, label: Sequence[str]) -> DataFrame:
    """Highest and lowest value of each key and the first row, by `label`, that has it."""
    s = lambda sign: F.struct((sign * F.col(value)).alias("v"), *label)
    out = df.groupBy(*by).agg(F.min(s(-1)).alias("hi_"), F.min(s(1)).alias("lo_"), F.avg(value).alias("mean"))
    return out.select(*by, (-F.col("hi_.v")).alias("peak"), *[F.col(f"hi_.{n}").alias(f"peak_{n}") for n in label], F.col("lo_.v").alias("low"), *[F.col(f"lo_.{n}").alias(f"low_{n}") for n in label], "mean")


def interpolate(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Null values between known ones are put on the line between them."""
    before = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(x).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))
    out = df.withColumns({"a_": F.last(known, True).over(before), "b_": F.first(known, True).over(after)})
    at = (F.col(x) - F.col("a_.x")) / (F.col("b_.x") - F.col("a_.x"))
    line = F.col("a_.y") + at * (F.col("b_.y") - F.col("a_.y"))
    return out.withColumn(y, F.coalesce(F.col(y), line, F.col("a_.y"), F.col("b_.y"))).drop("a_", "b_")


def waterfill(df: DataFrame, by: Sequence[str], usage: str, slots: float, order: Sequence[str], alias: str = "share") -> DataFrame:
    """Shares in proportion to usage, none above 1, that add up to `slots` (or to the members, if fewer).

    In order of usage, the first j members are full if the next one's
    proportional share of what is left would not exceed 1; the number of full
    members has a closed form in running sums, so no loop is needed.
    """
    desc = [F.desc(usage), *order]
    w = Window.partitionBy(*by).orderBy(*desc)
    rest = F.sum(usage).over(Window.partitionBy(*by).orderBy(*desc).rowsBetween(0, Window.unboundedFollowing))
    ranked = df.withColumns({"r_": F.row_number().over(w), "rest_": rest})
    full = F.col(usage) * (slots - F.col("r_") + 1) >= F.col("rest_")
    ranked = ranked.withColumn("full_", full & (F.col("r_") <= slots))
    whole = Window.partitionBy(*by)
    n_full = F.count_if("full_").over(whole)
    left = F.sum(F.when(~F.col("full_"), F.col(usage))).over(whole)
    share = F.when(F.col("full_"), 1.0).otherwise(F.coalesce(F.col(usage) * F.greatest(slots - n_full, F.lit(0)) / F.nullif(left, F.lit(0.0)), F.lit(0.0)))
    return ranked.withColumn(alias, share).drop("r_", "rest_", "full_")
