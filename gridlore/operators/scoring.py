"""Proper scores, calibration and comparisons of forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(p: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), p))


def brier(y: str, p: str) -> Column:
    return F.pow(F.col(p) - F.col(y), 2)


def logloss(y: str, p: str, eps: float = 1e-6) -> Column:
    c = clip(F.col(p), eps, 1 - eps)
    return -(F.col(y) * F.log(c) + (1 - F.col(y)) * F.log(1 - c))


def correct(y: str, p: str) -> Column:
    """1 if the favoured side won, 0 if not, null for a tie or an even forecast."""
    return F.when((F.col(y) == 0.5) | (F.col(p) == 0.5), None).otherwise(((F.col(p) > 0.5) == (F.col(y) > 0.5)).cast("double"))


#: Metrics by name; each takes (outcome, forecast).
METRICS = {"brier": brier, "logloss": logloss, "accuracy": correct, "mae": lambda y, p: F.abs(F.col(y) - F.col(p))}


def scores(df: DataFrame, y: str, p: str, by: Sequence[str] = (), metrics: Sequence[str] = ("brier", "logloss", "accuracy")) -> DataFrame:
    """n and the mean of each metric, for rows with both outcome and forecast."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(METRICS[m](y, p)).alias(m) for m in metrics])


def melt(df: DataFrame, keys: Sequence[str], models: Mapping[str, str], value: str = "p") -> DataFrame:
    """One row for each forecast column: keys, model, value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).cast("double").alias(value)) for k, c in models.items()])
    return df.select(*keys, F.explode(pairs).alias("melt_")).select(*keys, "melt_.model", f"melt_.{value}")


def paired_difference(df: DataFrame, y: str, a: str, b: str, metric: str = "brier", by: Sequence[str] = ()) -> DataFrame:
    """Mean of metric(a) - metric(b) on rows that have both, and its standard error."""
    d = METRICS[metric](y, a) - METRICS[metric](y, b)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()).withColumn("d_", d)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d_").alias("diff"), (F.stddev_samp("d_") / F.sqrt(F.count("*"))).alias("se"))


def uniform_bin(p: Column, bins: int) -> Column:
    """0 .. bins - 1; 1 falls in the last bin."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def quantile_bin(df: DataFrame, p: str, bins: int, order: Sequence[str], by: Sequence[str] = (), alias: str = "bin") -> DataFrame:
    """Equally filled bins by rank within `by`.

    With keys, a window ranks each segment. Without, ranks would meet in one
    task, so a row's bin comes from exact counts: forecasts are counted by
    distinct value, values are few (rounded forecasts), and running counts over
    them give each value's first rank; rows of one value share the bin of it.
    """
    if by:
        return df.withColumn(alias, F.ntile(bins).over(Window.partitionBy(*by).orderBy(p, *order)) - 1)
    counts = df.groupBy(F.col(p).alias("v_")).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("v_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_").over(Window.partitionBy())
    edges = counts.select("v_", F.floor(before * bins / total).cast("int").alias(alias))
    return df.join(edges, F.col(p).eqNullSafe(F.col("v_"))).drop("v_")


def reliability(df: DataFrame, y: str, p: str, bin_col: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """For each bin: rows, mean forecast, mean outcome and the gap."""
    return df.groupBy(*by, bin_col).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y")).withColumn("gap", F.col("mean_y") - F.col("mean_p"))


def ece(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size-weighted mean absolute gap of a reliability table."""
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def decomposition(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reliability, resolution and uncertainty from a reliability table."""
    base = F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")
    totals = table.groupBy(*by).agg(F.sum("n").alias("total"), base.alias("base"))
    joined = table.join(totals, list(by)) if by else table.join(F.broadcast(totals))
    share = F.col("n") / F.col("total")
    return joined.groupBy(*by).agg(F.sum(share * F.pow("gap", 2)).alias("reliability"), F.sum(share * F.pow(F.col("mean_y") - F.col("base"), 2)).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def entropy(p: str) -> Column:
    c = clip(F.col(p), 1e-9, 1 - 1e-9)
    return -(c * F.log(c) + (1 - c) * F.log(1 - c))


def sharpness(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_samp(p).alias("sd"), F.avg(entropy(p)).alias("entropy"))


def best_of(df: DataFrame, value: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The row of the smallest value in each group, the first by `names` among equals."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct(value, *names)).alias("s_"), F.min(value).alias(value)).select(*by, *[F.col(f"s_.{n}") for n in names], value)
