"""Mixing sources to target weights by Poisson replication (operator 1)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import free_name, join_checked, settle

#: Mean of one Poisson draw at most; a greater rate is the sum of several draws.
PART_RATE = 16.0
#: Sources up to which the rate table, about 1 KB a source, is broadcast.
RATE_ROWS = 10_000


def uniform(*key: Column) -> Column:
    """A number from 0 up to 1 from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _cdf(rate: Column) -> Column:
    """P(X <= k) of a Poisson variable for k from 0 until it can't be told from 1."""
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + term)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, mass, rate) of every source: how often each of its documents is wanted on average.

    A source's mass is the characters of its texts. The weights are shares of
    the mixture's characters; without them, a source's weight is its mass to
    the power `alpha`. A source that `weights` doesn't name has weight 0, and
    one without characters has rate 0. The mixture has `epochs` times the
    characters of all sources.
    """
    mass = settle(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(F.col(text_col).cast("string"))), F.lit(0)).cast("double").alias("mass")), "mass")
    if weights is None:
        weight = F.pow("mass", F.lit(float(alpha)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("source", F.lit("")))if pairs else F.lit(None), F.lit(0.0))
    weighed = mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(0.0))
    total, parts = weighed.agg(F.coalesce(F.sum("mass"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = F.col("weight") / F.lit(parts) if parts else F.lit(0.0)
    return weighed.select("source", "mass", F.when(F.col("mass") > 0, share * F.lit(total) * F.lit(float(epochs)) / F.col("mass")).otherwise(0.0).alias("rate"))


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document as often as a Poisson draw says, in a random order.

    The draw inverts the Poisson distribution at a uniform number hashed from
    seed and id; its mean is the source's rate of `source_rates`. Rows come out
    with all columns of `docs` and copy_no (from 1), copies, order_key; a clash
    of names adds "_" to ours. The order is by partition and, in a partition,
    by order_key, a hash of seed, id and copy, which also deals the rows out.

    A null source is a source of its own. Rows that repeat an id draw the same
    number; null ids all draw the same. A null text has no characters but is
    repeated like its source's others. An empty table stays empty.
    """
    own = {c: free_name(docs, c) for c in ("source_key", "parts", "cdf", "copies", "copy_no", "order_key")}
    rates = source_rates(docs, weights, alpha, epochs, source_col, text_col).where("rate > 0")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int"))
    table = settle(rates.select(F.col("source").alias(own["source_key"]), parts.alias(own["parts"]), _cdf(F.col("rate") / parts).alias(own["cdf"])), "rates")
    joined = join_checked(docs, table, F.col(source_col).cast("string").eqNullSafe(F.col(own["source_key"])), "inner", RATE_ROWS)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))

    def drawn(i: Column) -> Column:
        u = uniform(F.lit(str(seed)), ident, i.cast("string"))
        return F.size(F.filter(F.col(own["cdf"]), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col(own["parts"])), F.lit(0), lambda acc, i: acc + drawn(i))
    counted = joined.withColumn(own["copies"], count).where(F.col(own["copies"]) > 0).drop(own["source_key"], own["parts"], own["cdf"])
    copies = counted.withColumn(own["copy_no"], F.explode(F.sequence(F.lit(1), F.col(own["copies"]))))
    order = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), ident, F.col(own["copy_no"]).cast("string"))), 1, 15), 16, 10).cast("bigint")
    keyed = copies.withColumn(own["order_key"], order)
    return keyed.repartition(own["order_key"]).sortWithinPartitions(own["order_key"])
