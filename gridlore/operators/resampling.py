"""Bootstraps by hash-seeded weights, refits under them, and tests built on them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gridlore.sources.files import settled


def hashed(seed: int | str, *key: Column) -> Column:
    """52 bits of the MD5 of a seed and key values as text; nulls are passed over."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    return hashed(seed, *key) / float(1 << 52)


#: The distribution function of Poisson(1), as far as 52 bits tell its values from 1.
POISSON_ONE = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]


#: The same as 13 hex digits, which sort as the numbers do: a hash isn't turned into a number to be compared.
POISSON_HEX = [f"{math.ceil(c * (1 << 52)):013x}" for c in POISSON_ONE if c < 1]


def poisson_one(digits: Column) -> Column:
    """A Poisson(1) draw by inversion, from the hex digits of a hash."""
    out = F.when(digits < POISSON_HEX[0], 0)
    for k, least in enumerate(POISSON_HEX[1:], 1):
        out = out.when(digits < least, k)
    return out.otherwise(len(POISSON_HEX))


_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]


def _md5_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of messages of one block, given as 16 rows of words."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += words[_PLACES[i]]
        f += _SINES[i]
        turned = f << np.uint32(_SHIFTS[i])
        turned |= f >> np.uint32(32 - _SHIFTS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    return a + start[0], b + start[1]


def md5_bits(heads: Sequence[bytes], texts: Sequence[bytes]) -> np.ndarray:
    """52 bits of the MD5 of each head followed by each text, a row for each head; all texts of one block go together."""
    widest = max(map(len, texts), default=0)
    out = np.empty((len(heads), len(texts)), np.uint64)
    if not len(texts) or widest + max(map(len, heads)) > 55:
        for k, head in enumerate(heads):
            out[k] = np.frombuffer(b"".join([hashlib.md5(head + x).digest()[:8] for x in texts]), ">u8")
        return out >> np.uint64(12)
    size = np.array(list(map(len, texts)), np.int64)
    body = np.frombuffer(b"".join([x + b"\x80" + bytes(widest - len(x)) for x in texts]), np.uint8).reshape(len(texts), widest + 1)
    for k, head in enumerate(heads):
        block = np.zeros((len(texts), 64), np.uint8)
        block[:, : len(head)] = np.frombuffer(head, np.uint8)
        block[:, len(head) : len(head) + widest + 1] = body
        words = block.view("<u4").T.astype(np.uint32, order="C")
        words[14] = ((size + len(head)) * 8).astype(np.uint32)
        for at in range(0, len(texts), 8192):
            a, b = _md5_words(words[:, at : at + 8192])
            out[k, at : at + 8192] = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
    return out >> np.uint64(12)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to as many partitions as a shuffle has, for rows that are few but make much work; adaptive execution would put them together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def replicates(df: DataFrame, reps: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Each row once for each replicate that draws it, with its Poisson weight; equal keys draw alike.

    A hash is taken once for a row and replicate, where the row is repeated: the
    filter by weight can't take it again for each value it compares.
    """
    digits = lambda r: F.md5(F.concat_ws("|", F.lit(str(seed)), r.cast("string"), *[F.col(k).cast("string") for k in key]))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.struct(r.alias("rep"), digits(r).alias("h_")))
    rows = df.withColumn("r_", F.explode(drawn))
    return rows.withColumns({"rep": F.col("r_.rep"), "weight": poisson_one(F.col("r_.h_"))}).where("weight > 0").drop("r_")


def numbered(df: DataFrame, key: Sequence[str], seed: int = 0, groups: int = 1024) -> DataFrame:
    """(key, at): the different keys numbered from 0 without gaps, in an order by hash.

    Keys are counted by 1,024 groups of their hash, and a group's numbers start
    where the ones before it end, so no window holds more than a group.
    """
    keys = df.select(*key).distinct().withColumn("h_", hashed(f"at{seed}", *[F.col(k) for k in key])).withColumn("g_", F.col("h_") % groups)
    before = F.coalesce(F.sum("n_").over(Window.orderBy("g_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keys.groupBy("g_").agg(F.count("*").alias("n_")).select("g_", before.alias("start_"))
    own = F.row_number().over(Window.partitionBy("g_").orderBy("h_", *key)) - 1
    return keys.withColumn("own_", own).join(F.broadcast(starts), "g_").select(*key, (F.col("start_") + F.col("own_")).alias("at"))


#: Numbers of keys whose draws are counted together, and draws that a task gathers before it sends them.
BLOCK, GATHERED = 8192, 1 << 22


def multinomial_weights(df: DataFrame, key: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(key, weights): for each of the n different keys, how often each replicate draws it in n draws with replacement.

    A draw is a hash of replicate and number, which names a key by its number.
    `weights` has an entry for each replicate. Null key values are a key. Draws
    travel as four bytes each, a task's draws of a block of numbers in one row;
    a block is counted in one place. Keys and weights are written once to the
    shared folder.
    """
    keys = settled(numbered(df, key, seed), "keys")
    n = keys.count()

    def drawn(batches):
        held: list = []

        def flush():
            numbers = np.sort(np.concatenate(held))
            blocks, starts = np.unique(numbers // (BLOCK * reps), return_index=True)
            parts = np.split((numbers % (BLOCK * reps)).astype(np.uint32), starts[1:])
            return pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "draws": pa.array([x.tobytes() for x in parts], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [str(x).encode() for x in batch.column("at").to_pylist()]
            for rep in range(reps):
                u = md5_bits([f"{seed}|{rep}|".encode()], texts)[0].astype(float) / float(1 << 52)
                held.append(np.floor(u * n).astype(np.int64) * reps + rep)
                if sum(map(len, held)) >= GATHERED:
                    yield flush()
                    held = []
        if held:
            yield flush()

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        named = np.frombuffer(b"".join(right.column("draws").to_pylist()), np.uint32)
        counts = np.bincount(named, minlength=BLOCK * reps).astype(np.int32)
        rows = counts.reshape(BLOCK, reps)[left.column("at").to_numpy() % BLOCK]
        weights = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * reps, pa.int32()), pa.array(rows.ravel()))
        return left.select(list(key)).append_column("weights", weights)

    kinds = StructType([*[keys.schema[k] for k in key], StructField("weights", ArrayType(IntegerType()))])
    draws = spread(keys.select("at"), "at").mapInArrow(drawn, "block long, draws binary")
    blocks = keys.withColumn("block", F.floor(F.col("at") / BLOCK))
    return settled(blocks.groupBy("block").cogroup(draws.groupBy("block")).applyInArrow(counted, kinds), "weights")


def attach_weights(df: DataFrame, key: Sequence[str], weights: DataFrame) -> DataFrame:
    """The rows with the `weights` of their key."""
    w = weights.withColumnsRenamed({k: f"{k}_w" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_w")) for k in key]
    return df.join(w, on).drop(*[f"{k}_w" for k in key])


def with_weights(df: DataFrame, key: Sequence[str], reps: int, seed: int) -> DataFrame:
    """The rows with the multinomial `weights` of their key."""
    return attach_weights(df, key, multinomial_weights(df, key, reps, seed))


def refit_logistic(rows: DataFrame, features: Sequence[str], y: str, weights: str, by: str | None = None, rounds: int = 25, penalty: float = 0.0) -> DataFrame:
    """(by, rep, coefs): a logistic model, intercept first, for each group and each entry of the array `weights`.

    Rows of equal group, features and outcome are one row of summed weights, so
    that repeated designs are read once. All replicates take Newton's steps
    together. A step is one pass over the rows, in which a task multiplies a batch's predictions for all replicates,
    and one grouped sum of gradients and curvatures, as many numbers as groups
    times replicates times the square of the features; groups are few.
    Steps go on until none moves a coefficient by 1e-10. Rows with a null are
    left out; outcomes may lie between 0 and 1.
    """
    spark = rows.sparkSession
    used = rows.select(
        (F.col(by) if by else F.lit(0)).alias("by_"),
        F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias("x_"),
        F.col(y).cast("double").alias("y_"),
        F.col(weights).cast("array<double>").alias("w_"),
    ).where("by_ IS NOT NULL AND y_ IS NOT NULL AND w_ IS NOT NULL AND NOT exists(x_, v -> v IS NULL)")
    reps = used.agg(F.max(F.size("w_"))).first()[0] or 0
    sums_ = [F.coalesce(F.sum(F.col("w_")[r]), F.lit(0.0)).alias(f"w{r}_") for r in range(reps)]
    used = used.groupBy("by_", "x_", "y_").agg(*sums_).select("by_", "x_", "y_", F.array(*[f"w{r}_" for r in range(reps)]).alias("w_")).persist() if reps else used.persist()
    k = len(features) + 1
    i, j = np.triu_indices(k)
    kind = dict(used.dtypes)["by_"]
    found: dict = {r[0]: np.zeros((r[1], k)) for r in used.groupBy("by_").agg(F.max(F.size("w_"))).collect()}
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(found)

        def sums(batches, now=now):
            held: dict = {}
            for batch in batches:
                groups = np.array(batch.column("by_").to_pylist(), dtype=object)
                x, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x_", "w_"))
                out = batch.column("y_").to_numpy()
                for g in set(groups):
                    at = groups == g
                    mean = 1 / (1 + np.exp(-(x[at] @ now.value[g].T)))
                    slope = (w[at] * (out[at][:, None] - mean)).T @ x[at]
                    curve = (w[at] * mean * (1 - mean)).T @ (x[at][:, i] * x[at][:, j])
                    both = np.hstack([slope, curve])
                    held[g] = held[g] + both if g in held else both
            flat = [(g, r, c, float(v)) for g, m in held.items() for r, row in enumerate(m) for c, v in enumerate(row)]
            columns = list(zip(*flat)) if flat else [[], [], [], []]
            yield pa.RecordBatch.from_pydict({"by_": pa.array(columns[0], pa.from_numpy_dtype(np.int32) if kind == "int" else None), "rep": pa.array(columns[1], pa.int32()), "c": pa.array(columns[2], pa.int32()), "v": pa.array(columns[3], pa.float64())}) if flat else None

        def some(batches, sums=sums):
            return (b for b in sums(batches) if b is not None)

        totals: dict = {g: np.zeros((len(m), k + len(i))) for g, m in found.items()}
        for g, r, c, v in used.mapInArrow(some, f"by_ {kind}, rep int, c int, v double").groupBy("by_", "rep", "c").agg(F.sum("v")).collect():
            totals[g][r, c] = v
        most, new = 0.0, {}
        for g, m in found.items():
            curve = np.zeros((len(m), k, k))
            curve[:, i, j] = curve[:, j, i] = totals[g][:, k:]
            slope = totals[g][:, :k] - penalty * m
            step = np.einsum("rij,rj->ri", np.linalg.pinv(curve + penalty * np.eye(k), hermitian=True), slope)
            new[g] = m + step
            most = max(most, float(np.abs(step).max(initial=0.0)))
        found = new
        if most < 1e-10:
            break
    used.unpersist()
    flat = [(g, r, [float(v) for v in row]) for g, m in found.items() for r, row in enumerate(m)]
    out = spark.createDataFrame(flat, f"by_ {kind}, rep int, coefs array<double>")
    return out.withColumnRenamed("by_", by) if by else out.drop("by_")


def option_bands(values: DataFrame, keys: Sequence[str], options: Sequence[str], level: float = 0.9) -> DataFrame:
    """(keys, best, second, margin, band_low, band_high, tossup): the two best options by the point estimate, and the spread of their difference over replicates.

    `values` has a row for each decision and a column for each option: an array
    whose first entry is the point estimate and whose others are replicates'.
    Which options are compared is fixed by the point estimates; among equals
    the first named is better. A decision is a toss-up if the band holds 0.
    """
    ranked = F.sort_array(F.array(*[F.struct((-F.col(o)[0]).alias("v"), F.lit(i).alias("i"), F.lit(o).alias("name"), F.col(o).alias("all")) for i, o in enumerate(options)]))
    best, second = F.col("r_")[0], F.col("r_")[1]
    gaps = F.array_sort(F.zip_with(F.slice(best["all"], 2, F.size(best["all"]) - 1), F.slice(second["all"], 2, F.size(second["all"]) - 1), lambda a, b: a - b))
    n = F.size("g_") - 1

    def at(q: float) -> Column:
        place = n * q
        low = F.floor(place).cast("int")
        return F.col("g_")[low] + (place - low) * (F.col("g_")[F.least(low + 1, n)] - F.col("g_")[low])

    rows = values.withColumn("r_", ranked).withColumn("g_", gaps)
    low, high = at((1 - level) / 2), at((1 + level) / 2)
    return rows.select(*keys, best["name"].alias("best"), second["name"].alias("second"), (best["all"][0] - second["all"][0]).alias("margin"), low.alias("band_low"), high.alias("band_high"), ((low <= 0) & (high >= 0)).alias("tossup"))


def bootstrap_mean(df: DataFrame, value: str, cluster: Sequence[str], by: Sequence[str] = (), reps: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Mean of a value with a percentile interval, resampling whole clusters.

    Rows are summed by cluster first. A task draws the weights of a batch of
    clusters, the same as in `replicates`, and sends its sums by replicate;
    clusters aren't repeated as rows.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, *cluster).agg(F.sum(value).alias("s_"), F.count(value).alias("n_"))
    point = sums.groupBy(*by).agg(F.sum("n_").alias("n"), (F.sum("s_") / F.sum("n_")).alias("mean"))
    text = F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in cluster])
    least = np.array([int(x, 16) for x in POISSON_HEX], np.uint64)
    heads = [f"{seed}|{r}".encode() for r in range(reps)]

    def summed(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column("text_").to_pylist()]
            s, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s_", "n_"))
            groups: dict = {}
            for at, group in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * len(texts)):
                groups.setdefault(group, []).append(at)
            drawn = np.searchsorted(least, md5_bits(heads, texts), "right")
            for ats in groups.values():
                w, values = drawn[:, ats].astype(float), s[ats]
                part = w @ values if np.isfinite(values).all() else np.where(w > 0, w * values, 0.0).sum(1)
                head = batch.select(list(by)).take(pa.array([ats[0]] * reps, pa.int64()))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(np.arange(reps), pa.int32()), pa.array(part), pa.array(w @ n[ats])], [*by, "rep", "s_", "n_"])

    kinds = StructType([*[sums.schema[c] for c in by], StructField("rep", IntegerType()), StructField("s_", DoubleType()), StructField("n_", DoubleType())])
    parts = spread(sums, *cluster).select(*by, text.alias("text_"), F.col("s_").cast("double").alias("s_"), F.col("n_").cast("double").alias("n_")).mapInArrow(summed, kinds)
    draws = parts.groupBy(*by, "rep").agg(F.sum("s_").alias("s_"), F.sum("n_").alias("n_")).where("n_ > 0").withColumn("m_", F.col("s_") / F.col("n_"))
    q = lambda p: F.percentile("m_", F.lit(p))
    bands = draws.groupBy(*by).agg(q((1 - level) / 2).alias("low"), q((1 + level) / 2).alias("high"), F.stddev_samp("m_").alias("se"))
    return point.join(bands, list(by)) if by else point.join(F.broadcast(bands))


def null_ece(df: DataFrame, p: str, key: Sequence[str], reps: int = 100, seed: int = 11, bins: int = 10) -> DataFrame:
    """(rep, ece) of outcomes drawn from the forecasts themselves; rows of one key share a draw."""
    u = uniform(seed, F.col("rep"), *[F.col(k) for k in key])
    drawn = spread(df, *key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("y_", (u < F.col(p)).cast("double"))
    table = drawn.groupBy("rep", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg("y_").alias("my"))
    return table.groupBy("rep").agg((F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))) / F.sum("n")).alias("ece"))


def one_se(scores: DataFrame, parameter: str, mean: str, se: str) -> DataFrame:
    """The smallest parameter whose mean is within one standard error of the best; the table has a row for each parameter."""
    best = scores.agg(F.min_by(F.struct(F.col(mean).alias("m"), F.col(se).alias("s")), mean).alias("b"))
    return scores.join(F.broadcast(best)).where(F.col(mean) <= F.col("b.m") + F.col("b.s")).agg(F.min(parameter).alias(parameter))


def shuffled_within(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], seed: int, alias: str) -> DataFrame:
    """The value permuted within groups: two numberings of a group, one by key and one by hash, joined."""
    w = Window.partitionBy(*by)
    a = df.withColumn("k_", F.row_number().over(w.orderBy(*key)))
    b = df.select(*by, F.col(value).alias(alias), F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), *key), *key)).alias("k_"))
    return a.join(b, [*by, "k_"]).drop("k_")
