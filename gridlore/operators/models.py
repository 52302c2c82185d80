"""Models fitted on tables: aggregated normal equations and Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import gridlore
from gridlore.operators.joins import checked
from gridlore.sources.files import settled

# Functions of this package travel to the executors by value.
cloudpickle.register_pickle_by_value(gridlore)


#: Sums that a task holds before it sends them on, and rows it adds up at once.
HELD_SUMS, HELD_ROWS = 1 << 24, 1 << 16


def gram(rows: DataFrame, by: Sequence[str], row_id: Sequence[str], y: str, w: str | None = None, terms: str = "terms") -> DataFrame:
    """(by, i, j, s): weighted normal equations of sparse rows.

    `terms` is an array of (key, x) of a row, few of them; a term without a key
    is left out, and a null number counts as 0. j is null for the right side
    X'Wy. A task adds up the pairs within its rows and sends a sum for each
    pair of keys, the lesser one first; Spark adds the tasks' sums up and gives
    both orders.
    """
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    kept = F.transform(F.filter(terms, lambda a: a["key"].isNotNull()), lambda a: F.struct(a["key"].cast("string").alias("k"), number(a["x"]).alias("x")))
    used = rows.select(*by, kept.alias("t_"), number(F.col(y)).alias("y_"), (number(F.col(w)) if w else F.lit(1.0)).alias("w_"))
    kinds, n = dict(rows.dtypes), len(by)

    def run(batches):
        sums, held, size = _Sums(n), [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= HELD_ROWS:
                yield from sums.add(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
        if size:
            yield from sums.add(pa.Table.from_batches(held).combine_chunks())
        yield from sums.flush()

    found = used.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in by) + "i string, j string, s double")
    half = found.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))
    one, other = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = F.when(F.col("j").isNull() | (F.col("i") == F.col("j")), F.array(one)).otherwise(F.array(one, other))
    return half.select(*by, F.explode(both).alias("p_"), "s").select(*by, "p_.i", "p_.j", "s")


class _Sums:
    """A task's sums by group and pair of keys, as dense arrays as long as they stay within `HELD_SUMS`."""

    def __init__(self, n: int) -> None:
        self.n = n
        self._reset()

    def _reset(self) -> None:
        self.groups, self.keys, self.pairs, self.right = {}, {}, np.zeros((0, 0, 0)), np.zeros((0, 0))
        self.seen = np.zeros((0, 0, 0), bool)

    def _grow(self, g: int, k: int) -> None:
        og, ok = self.right.shape
        if g <= og and k <= ok:
            return
        g, k = max(g, og), ok if k <= ok else k if g * (k + k // 4) ** 2 > HELD_SUMS else k + k // 4
        for name, shape in (("pairs", (g, k, k)), ("seen", (g, k, k)), ("right", (g, k))):
            old = getattr(self, name)
            new = np.zeros(shape, old.dtype)
            new[tuple(slice(x) for x in old.shape)] = old
            setattr(self, name, new)

    def add(self, table: pa.Table):
        """Adds rows up; yields batches of sums if there have become too many."""
        self.kinds = [f.type for f in table.schema][: self.n]
        mark = np.zeros(table.num_rows, np.int64)
        for c in range(self.n):
            coded = table.column(c).combine_chunks().dictionary_encode()
            mark = mark * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            mark = np.unique(mark, return_inverse=True)[1]
        _, first, group = np.unique(mark, return_index=True, return_inverse=True)
        names = list(zip(*[table.column(c).take(first).to_pylist() for c in range(self.n)], strict=True)) if self.n else [()] * len(first)
        lists = table.column(self.n).combine_chunks()
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        word, x = flat.flatten()
        coded, x = word.dictionary_encode(), x.to_numpy()
        words = coded.dictionary.to_pylist()
        y, w = table.column(self.n + 1).to_numpy(), table.column(self.n + 2).to_numpy()
        g, k = len(self.groups.keys() | set(names)), len(self.keys.keys() | set(words))
        if g * k * k > HELD_SUMS:
            yield from self.flush()
            self._reset()
            g, k = len(names), len(words)
        if g * k * k > HELD_SUMS and table.num_rows > 1:
            half = table.num_rows // 2
            yield from self.add(table.slice(0, half).combine_chunks())
            yield from self.add(table.slice(half).combine_chunks())
            return
        group = np.array([self.groups.setdefault(v, len(self.groups)) for v in names], np.int64)[group]
        code = np.array([self.keys.setdefault(v, len(self.keys)) for v in words], np.int64)[coded.indices.to_numpy()]
        self._grow(g, k)
        k = self.right.shape[1]
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)
        self.right += np.bincount(group[row] * k + code, x * (y * w)[row], self.right.size).reshape(self.right.shape)
        for length in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == length)
            a, b = np.triu_indices(length)
            step = max(1, (1 << 21) // len(a))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                place = ends[part][:, None] + np.arange(length)
                i, j = code[place][:, a], code[place][:, b]
                v = x[place][:, a] * x[place][:, b] * w[part][:, None]
                v = np.where((i == j) & (a != b), 2 * v, v)
                cell = ((group[part][:, None] * k + np.minimum(i, j)) * k + np.maximum(i, j)).ravel()
                self.seen.reshape(-1)[cell] = True
                self.pairs += np.bincount(cell, v.ravel(), self.pairs.size).reshape(self.pairs.shape)

    def flush(self):
        if not self.keys:
            return
        groups, words = list(self.groups), np.array(list(self.keys), object)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(words)] = np.arange(len(words))
        g, i, j = np.nonzero(self.seen)
        s = self.pairs[g, i, j]
        i, j = np.where(rank[i] <= rank[j], i, j), np.where(rank[i] <= rank[j], j, i)
        diagonal = i == j
        g, i, none = np.concatenate([g, g[diagonal]]), np.concatenate([i, i[diagonal]]), np.concatenate([np.zeros(len(j), bool), np.ones(diagonal.sum(), bool)])
        s, j = np.concatenate([s, self.right[g[len(j) :], i[len(j) :]]]), np.concatenate([j, j[diagonal]])
        by = [pa.array([v[c] for v in groups], t) for c, t in enumerate(self.kinds)]
        text = pa.array(words.tolist(), pa.string())
        for at in range(0, len(s), HELD_ROWS):
            part = slice(at, at + HELD_ROWS)
            columns = [c.take(pa.array(g[part])) for c in by] + [text.take(pa.array(i[part])), text.take(pa.array(j[part], mask=none[part])), pa.array(s[part])]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f"b{c}" for c in range(self.n)], "i", "j", "s"])
        self._reset()


def decayed_gram(stats: DataFrame, period: str, decay: float, last: int) -> DataFrame:
    """Equations for each period up to `last`, of the periods before it: an age of a periods counts decay ** (a - 1).

    `stats` are the equations of single periods, whole numbers. A pair of keys
    has a row for each period from its first one on, and one running sum over
    them; rows aren't met with periods.
    """
    stats = settled(stats, "statistics")
    ends = stats.groupBy("i", "j").agg(F.min(period).alias("first_"))
    calendar = ends.select("i", "j", F.explode(F.sequence(F.col("first_").cast("int"), F.lit(last))).alias(period), F.col("first_"))
    own = stats.select(period, F.col("i").alias("i_"), F.col("j").alias("j_"), "s")
    met = calendar.join(own.withColumnRenamed(period, "p_"), (F.col("i") == F.col("i_")) & F.col("j").eqNullSafe(F.col("j_")) & (F.col(period) == F.col("p_")), "left")
    w = Window.partitionBy("i", "j").orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    up = F.pow(F.lit(float(decay)), -(F.col(period) - F.col("first_")).cast("double"))
    past = F.sum(F.col("s") * up).over(w) * F.pow(F.lit(float(decay)), (F.col(period) - 1 - F.col("first_")).cast("double"))
    return met.select(period, "i", "j", past.alias("s")).where("s IS NOT NULL")


#: Keys up to which a group's system is solved in one place; larger ones go by conjugate gradients.
DENSE_KEYS = 1500
#: Coefficients that may be on the driver during conjugate gradients.
MOST_KEYS = 20_000_000


def solve_ridge(equations: DataFrame, by: Sequence[str], penalty: Mapping[str, float], default: float, priors: DataFrame | None = None, dense: int = DENSE_KEYS) -> DataFrame:
    """(by, key, coef, prior, weight): ridge solutions of normal equations, shrunk towards priors.

    `priors` (by, key, prior, penalty) says towards what a key is shrunk and how
    hard; a key without a row there is shrunk to 0 with the penalty of its
    prefix before "|", or the default. A key that has a prior but no equations
    gets its prior. `weight` is the key's sum of squares in the equations, 0 if
    unseen. The prior is an offset: its part of the right side is taken off,
    and the deviation from it is solved for.

    The equations are written once to the shared folder, since several steps
    read them. Groups of up to `dense` keys are solved one in a task. If a group has more,
    all groups go by conjugate gradients over the table of equations: the
    driver holds a number for each key, a task adds up its own entries.
    """
    equations, kinds = settled(equations, "equations"), dict(equations.dtypes)
    rest = F.try_element_at(F.create_map(*[F.lit(x) for k, v in penalty.items() for x in (k, float(v))]), F.substring_index("key", "|", 1)) if penalty else F.lit(None)
    known = priors.select(*by, "key", F.col("prior").cast("double").alias("prior"), F.col("penalty").cast("double").alias("penalty")) if priors is not None else None
    diagonal = equations.where("i = j").select(*by, F.col("i").alias("key"), F.col("s").alias("weight"))
    keys = diagonal.join(known, [*by, "key"], "full") if known is not None else diagonal.withColumns({"prior": F.lit(0.0), "penalty": F.lit(None).cast("double")})
    keys = keys.select(*by, "key", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("prior", F.lit(0.0)).alias("prior"), F.coalesce("penalty", rest, F.lit(float(default))).alias("penalty"))
    right = equations.where("j IS NULL").select(*by, F.col("i").alias("key"), F.col("s").alias("b_"))
    if known is not None:
        means = known.select(*by, F.col("key").alias("j"), "prior").where("prior <> 0")
        shift = equations.join(means, [*by, "j"]).groupBy(*by, F.col("i").alias("key")).agg(F.sum(F.col("s") * F.col("prior")).alias("m_"))
        right = right.join(shift, [*by, "key"], "left").withColumn("b_", F.col("b_") - F.coalesce("m_", F.lit(0.0))).drop("m_")
    nodes = keys.join(right, [*by, "key"], "left").withColumn("b_", F.coalesce("b_", F.lit(0.0)))
    seen = nodes.where("weight > 0")
    most = seen.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    solved = _solve_dense(seen, equations, by, kinds) if most <= dense else _solve_gradients(seen, equations, by)
    moved = solved.withColumnRenamed("delta", "d_")
    out = keys.join(moved, [*by, "key"], "left")
    return out.select(*by, "key", (F.col("prior") + F.coalesce("d_", F.lit(0.0))).alias("coef"), "prior", "weight")


def _solve_dense(nodes: DataFrame, equations: DataFrame, by: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """(by, key, delta), a group of keys in one task: its entries and its nodes are one group of rows."""
    nothing = F.lit(None).cast("double")
    entries = equations.where("j IS NOT NULL").select(*by, "i", "j", "s", nothing.alias("b"), nothing.alias("p"))
    ends = nodes.select(*by, F.col("key").alias("i"), F.lit(None).cast("string").alias("j"), nothing.alias("s"), F.col("b_").alias("b"), F.col("penalty").alias("p"))
    rows = entries.unionByName(ends)
    rows = rows if by else rows.withColumn("all_", F.lit(0))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own, left = pdf[pdf["j"].isna()], pdf[pdf["j"].notna()]
        names = own["i"].tolist()
        at = {k: n for n, k in enumerate(names)}
        a = np.diag(own["p"].to_numpy(float))
        a[[at[k] for k in left["i"]], [at[k] for k in left["j"]]] += left["s"].to_numpy(float)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "key": names, "delta": np.linalg.solve(a, own["b"].to_numpy(float))})

    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "key string, delta double"
    return rows.groupBy(*(by or ["all_"])).applyInPandas(solve, schema)


def _solve_gradients(nodes: DataFrame, equations: DataFrame, by: Sequence[str], rounds: int = 500, tolerance: float = 1e-12) -> DataFrame:
    """(by, key, delta) by conjugate gradients, preconditioned by the diagonal, on all groups as one block-diagonal system."""
    from gridlore.operators.resampling import numbered

    spark = nodes.sparkSession
    index = numbered(nodes, [*by, "key"]).persist()
    placed = nodes.join(index, [*by, "key"])
    table = placed.select("at", "b_", "penalty", "weight").toArrow()
    n = table.num_rows
    if n > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    at = table["at"].to_numpy()
    b, extra, inverse = np.zeros(n), np.zeros(n), np.zeros(n)
    b[at], extra[at] = table["b_"].to_numpy(), table["penalty"].to_numpy()
    inverse[at] = 1 / (table["weight"].to_numpy() + table["penalty"].to_numpy())
    end = lambda c: index.select(*by, F.col("key").alias(c), F.col("at").alias(f"{c}_at"))
    entries = equations.where("j IS NOT NULL").join(end("i"), [*by, "i"]).join(end("j"), [*by, "j"]).select("i_at", "j_at", "s").repartition("i_at").persist()

    def times(p: np.ndarray) -> np.ndarray:
        vector = spark.sparkContext.broadcast(p)

        def run(batches):
            held: dict = {}
            for batch in batches:
                i, j, s = (batch.column(c).to_numpy() for c in range(3))
                rows, place = np.unique(i, return_inverse=True)
                for k, v in zip(rows.tolist(), np.bincount(place, s * vector.value[j]).tolist()):
                    held[k] = held.get(k, 0.0) + v
            yield pd.DataFrame({"i_at": np.array(list(held), np.int64), "v": np.array(list(held.values()), float)})

        got = entries.mapInArrow(lambda batches: (pa.RecordBatch.from_pandas(f, preserve_index=False) for f in run(batches)), "i_at long, v double").toArrow()
        out = np.zeros(n)
        np.add.at(out, got["i_at"].to_numpy(), got["v"].to_numpy())
        vector.unpersist()
        return out + extra * p

    x, r = np.zeros(n), b.copy()
    z = inverse * r
    p, size = z.copy(), float(b @ (inverse * b))
    rz = float(r @ z)
    for _ in range(rounds):
        if rz <= tolerance**2 * size:
            break
        ap = times(p)
        step = rz / float(p @ ap)
        x, r = x + step * p, r - step * ap
        z = inverse * r
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    else:
        raise RuntimeError("conjugate gradients didn't settle")
    deltas = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "delta": x}), "at long, delta double")
    return index.join(deltas, "at").drop("at")


def predict_terms(rows: DataFrame, coefs: DataFrame, keys: Sequence[str], on: Sequence[str] = (), terms: str = "terms", default: float = 0.0) -> DataFrame:
    """Sum of x times the coefficient of its key, for each row; unseen keys count as `default`.

    A key that all rows have would bring them to one task, so coefficients are
    written once and broadcast if they are few.
    """
    long = rows.select(*keys, *[c for c in on if c not in keys], F.explode(terms).alias("t")).select(*dict.fromkeys([*keys, *on]), F.col("t.key").alias("key"), F.col("t.x").alias("x"))
    met = checked(long, settled(coefs.select(*on, "key", "coef"), "coefficients"), [*on, "key"], "left")
    return met.groupBy(*keys).agg(F.sum(F.col("x") * F.coalesce("coef", F.lit(default))).alias("pred"))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features_", handleInvalid="keep").transform(df)


def walk_forward(df: DataFrame, period: str, periods: Sequence[int], fit, predict, first: int | None = None) -> DataFrame:
    """For each period a model fitted on the earlier ones, applied to it; `fit(train)` and `predict(model, test)` are the caller's."""
    out = None
    for s in periods:
        past = df.where(F.col(period) < s)
        part = predict(fit(past.where(F.col(period) >= first) if first is not None else past), df.where(F.col(period) == s))
        out = part if out is None else out.unionByName(part)
    return out


def walk_logistic(df: DataFrame, features: Sequence[str], y: str, weight: Column, period: str, periods: Sequence[int], name: str = "pred") -> DataFrame:
    """Rows of the periods with a probability from a logistic model of all rows of earlier periods.

    The models of all periods are fitted together: each is a replicate whose
    weights are 0 from its period on. A period without rows before it has none.
    """
    from gridlore.operators.resampling import refit_logistic

    weights = F.array(*[F.when(F.col(period) < p, weight).otherwise(0.0) for p in periods])
    fits = refit_logistic(df.withColumn("weights_", weights), features, y, "weights_").select("rep", F.col("coefs").alias("coefs_"))
    named = fits.join(F.broadcast(df.sparkSession.createDataFrame(list(enumerate(periods)), "rep int, period_ int")), "rep").drop("rep")
    z = F.col("coefs_")[0] + sum((F.col("coefs_")[i + 1] * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
    return df.join(F.broadcast(named), F.col(period) == F.col("period_")).withColumn(name, 1 / (1 + F.exp(-z))).drop("coefs_", "period_")


def fit_logistic(train: DataFrame, features: Sequence[str], y: str, w: str | None = None, **options):
    return LogisticRegression(featuresCol="features_", labelCol=y, maxIter=50, tol=1e-8, **({"weightCol": w} if w else {}), **options).fit(assembled(train, features))


def probability(model, df: DataFrame, features: Sequence[str], name: str = "pred", index: int = 1) -> DataFrame:
    out = model.transform(assembled(df, features))
    return out.withColumn(name, vector_to_array("probability")[index]).drop("features_", "rawPrediction", "probability", "prediction")


def class_shares(model, df: DataFrame, features: Sequence[str], name: str = "shares") -> DataFrame:
    out = model.transform(assembled(df, features))
    return out.withColumn(name, vector_to_array("probability")).drop("features_", "rawPrediction", "probability", "prediction")


def fit_linear(train: DataFrame, features: Sequence[str], y: str, w: str | None = None, **options):
    return LinearRegression(featuresCol="features_", labelCol=y, solver="normal", **({"weightCol": w} if w else {}), **options).fit(assembled(train, features))


def mean_of(model, df: DataFrame, features: Sequence[str], name: str = "pred") -> DataFrame:
    return model.transform(assembled(df, features)).withColumnRenamed("prediction", name).drop("features_")


def residual_sd(df: DataFrame, y: str, pred: str, parameters: int, w: str | None = None) -> float:
    """Weighted residual standard deviation with degrees of freedom by the weights' effective number."""
    weight = F.col(w) if w else F.lit(1.0)
    s, n, n2 = df.agg(F.sum(weight * F.pow(F.col(y) - F.col(pred), 2)), F.sum(weight), F.sum(weight * weight)).first()
    effective = n * n / n2
    return float(np.sqrt(s / n * effective / (effective - parameters)))


def fit_gbt(train: DataFrame, features: Sequence[str], y: str, trees: int = 20, validation: str | None = None):
    """Boosted trees; rows of equal features, class and validation mark are one row with their number as weight, sorted so that a fit can be repeated."""
    options = {"validationIndicatorCol": validation} if validation else {}
    keys = [*features, y, *options.values()]
    counted = train.groupBy(*keys).agg(F.count("*").cast("double").alias("n_")).sortWithinPartitions(*keys).persist()
    model = GBTClassifier(featuresCol="features_", labelCol=y, weightCol="n_", maxIter=trees, maxDepth=3, seed=7, **options).fit(assembled(counted, features))
    counted.unpersist()
    return model


def fit_gbt_regression(train: DataFrame, features: Sequence[str], y: str, trees: int = 10):
    return GBTRegressor(featuresCol="features_", labelCol=y, maxIter=trees, maxDepth=3, seed=7).fit(assembled(train, features))


def fit_classes(train: DataFrame, features: Sequence[str], y: str, trees: int = 20):
    return RandomForestClassifier(featuresCol="features_", labelCol=y, numTrees=trees, maxDepth=4, seed=7).fit(assembled(train, features))


def fit_isotonic(train: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """Knots (x, y) of an isotonic calibration of forecasts: the centres of the pooled blocks, and the ends 0 and 1.

    Spark pools the rows; a block's centre is the mean forecast of its rows.
    Between centres the map is linear, so it rises wherever blocks differ. Rows
    with a null are left out; without rows the map is the identity.
    """
    used = train.select(F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).na.drop()
    if used.isEmpty():
        return [(0.0, 0.0), (1.0, 1.0)]
    fitted = IsotonicRegression(featuresCol="x_", labelCol="y_", predictionCol="f_").fit(used).transform(used)
    blocks = sorted((r["c"], r["f"]) for r in fitted.groupBy(F.round("f_", 12).alias("f")).agg(F.avg("x_").alias("c")).collect())
    rising = [b for i, b in enumerate(blocks) if i == 0 or b[0] > blocks[i - 1][0]]
    return [(0.0, min(0.0, rising[0][1])), *rising, (1.0, max(1.0, rising[-1][1]))]


def interpolated(x: Column, knots: Sequence[tuple[float, float]], margin: float = 1e-6) -> Column:
    """The piecewise linear map through knots, kept `margin` away from 0 and 1; null stays null."""
    xs, ys = (F.array(*[F.lit(float(k[i])) for k in knots]) for i in (0, 1))
    at = F.greatest(F.least(F.size(F.filter(xs, lambda v: v <= x)), F.lit(len(knots) - 1)), F.lit(1))
    left, right, low, high = (F.element_at(c, i.cast("int")) for c, i in ((xs, at), (xs, at + 1), (ys, at), (ys, at + 1)))
    inside = low + F.coalesce(F.try_divide(x - left, right - left), F.lit(0.0)) * (high - low)
    bounded = F.when(x <= knots[0][0], knots[0][1]).when(x >= knots[-1][0], knots[-1][1]).otherwise(inside)
    return F.when(x.isNotNull(), F.greatest(F.least(bounded, F.lit(1 - margin)), F.lit(margin)))


def fit_stack(train: DataFrame, logits: Sequence[str], y: str, penalty: float, weight: str | None = None, rounds: int = 30) -> list[float]:
    """[intercept, a weight of 0 or more for each base's log-odds]: least mean log loss plus `penalty` times the squared distance of the weights from equal ones.

    Newton steps from equal weights; each is one aggregate over all rows to as
    many sums as the pairs of bases. A step that raises the loss is halved.
    Rows with a null in a base, the outcome or the weight are left out; without
    rows the weights stay equal.
    """
    k = len(logits)
    used = train.na.drop(subset=[*logits, y, *([weight] if weight else [])])
    x = [F.lit(1.0), *[F.col(c) for c in logits]]
    equal, cost = np.r_[0.0, np.full(k, 1 / k)], np.r_[0.0, np.full(k, 2 * penalty)]
    kept, low, now, move = equal, np.inf, equal, np.zeros(k + 1)
    for _ in range(rounds):
        z = sum(float(v) * c for v, c in zip(now, x, strict=True))
        rows = used.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], z.alias("z"), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
        at = 1 / (1 + F.exp(-F.col("z")))
        loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z")
        slopes = [F.sum(F.col("w") * (at - F.col("y")) * F.col(f"x{i}")) for i in range(k + 1)]
        curves = [F.sum(F.col("w") * at * (1 - at) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k + 1) for j in range(k + 1)]
        n, total, *sums = rows.agg(F.sum("w"), F.sum(F.col("w") * loss), *slopes, *curves).first()
        if not n:
            return list(map(float, equal))
        value = total / n + (cost / 2 * (now - equal) ** 2).sum()
        if value > low + 1e-13:
            move = move / 2
        else:
            slope = np.array(sums[: k + 1]) / n + cost * (now - equal)
            curve = np.array(sums[k + 1 :]).reshape(k + 1, k + 1) / n + np.diag(cost)
            kept, low, move = now, value, np.zeros(k + 1)
            for i in [*range(k + 1)] * 200:  # coordinate descent on the quadratic model, weights kept from below 0
                step = move[i] - (slope[i] + curve[i] @ move) / max(curve[i, i], 1e-12)
                move[i] = step if i == 0 else max(step, -now[i])
        if np.abs(move).max() < 1e-9:
            break
        now = kept + move
    return list(map(float, kept))


def stacked(logits: Sequence[str], fitted: Sequence[float]) -> Column:
    """The probability that a fitted stack gives."""
    return 1 / (1 + F.exp(-(fitted[0] + sum(v * F.col(c) for v, c in zip(fitted[1:], logits, strict=True)))))


def key_number_factors(rows: DataFrame, margin: str, pmf: str, low: int, top: int, rounds: int = 5) -> list[float]:
    """Factors of |margin| that make the expected counts of a pmf column meet the observed ones, by proportional fitting.

    Each round is one aggregate over all rows to `top` + 1 sums.
    """
    from gridlore.functions.distributions import total

    def weigh(f: Column) -> Column:
        return F.transform(pmf, lambda x, i: x * F.coalesce(F.get(f, F.abs(i + low)), F.lit(1.0)))

    factors = [1.0] * (top + 1)
    seen = rows.agg(*[F.avg((F.abs(margin) == k).cast("double")).alias(f"k{k}") for k in range(top + 1)]).first()
    for _ in range(rounds):
        weighed = rows.select(weigh(F.array(*[F.lit(x) for x in factors])).alias("w_"))
        summed = weighed.select("w_", total(F.col("w_")).alias("t_"))
        mass = lambda k: (F.get("w_", F.lit(k - low)) + (F.get("w_", F.lit(-k - low)) if k else 0.0)) / F.col("t_")
        want = summed.agg(*[F.avg(mass(k)).alias(f"k{k}") for k in range(top + 1)]).first()
        factors = [x * (s + 1e-4) / (w + 1e-4) for x, s, w in zip(factors, seen, want, strict=True)]
    return factors


def offset_cells(df: DataFrame, cell: Sequence[str], y: str, p: str, prior_sd: float, rounds: int = 8) -> DataFrame:
    """(cell, offset): penalised logit shifts of each cell by Newton steps; a step is one grouped sum of gradient and curvature."""
    z = F.log(F.col(p) / (1 - F.col(p)))
    cells = df.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.lit(0.0).alias("offset"))
    for _ in range(rounds):
        met = df.join(cells, list(cell)).withColumn("s_", 1 / (1 + F.exp(-(z + F.col("offset")))))
        step = met.groupBy(*cell).agg(F.sum(F.col(y) - F.col("s_")).alias("g_"), F.sum(F.col("s_") * (1 - F.col("s_"))).alias("h_"), F.first("offset").alias("o_"))
        cells = step.select(*cell, (F.col("o_") + (F.col("g_") - F.col("o_") / prior_sd**2) / (F.col("h_") + 1 / prior_sd**2)).alias("offset"))
    return cells


def leave_one_out(rows: DataFrame, fold: str, by: Sequence[str], row_id: Sequence[str], y: str, penalty: float, terms: str = "terms", w: str | None = None) -> DataFrame:
    """(fold, by, key, coef): ridge models of the rows outside each fold, all from one pass.

    Equations are summed by fold; those of the other folds are the total less
    the fold's own.
    """
    own = gram(rows, [fold, *by], row_id, y, w, terms)
    total = own.groupBy(*by, "i", "j").agg(F.sum("s").alias("t_"))
    folds = rows.select(fold).distinct()
    part = own.select(F.col(fold).alias("f_"), *[F.col(c).alias(f"{c}_") for c in by], F.col("i").alias("i_"), F.col("j").alias("j_"), "s")
    met = F.col(fold).eqNullSafe(F.col("f_")) & F.col("i").eqNullSafe(F.col("i_")) & F.col("j").eqNullSafe(F.col("j_"))
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_"))
    others = total.crossJoin(F.broadcast(folds)).join(part, met, "left").select(fold, *by, "i", "j", (F.col("t_") - F.coalesce("s", F.lit(0.0))).alias("s"))
    return solve_ridge(others, [fold, *by], {}, penalty).select(fold, *by, "key", "coef")


def action_nuisances(rows: DataFrame, keys: Sequence[str], fold: str, action: str, actions: int, features: Sequence[str], y: str, extra: DataFrame | None = None, penalty: float = 1e-6) -> DataFrame:
    """The rows with `e` and `mu`, arrays over actions: propensities and expected outcomes from models that saw no row of the row's fold.

    Propensities are a multinomial model, fitted once for each fold (folds are
    seasons, so few) on all the other rows; outcomes are a linear model for
    each action, all folds from one pass over the rows. Rows of equal fold,
    action and features are one row with a weight to the models, and all rows
    are scored in one pass. Rows of `extra` get models of all `rows`. An action
    that a fold's other rows never take has propensity 0. Needs two folds.
    """
    designs = settled(rows.groupBy(fold, action, *features).agg(F.count("*").cast("double").alias("n_"), (F.coalesce(F.sum(y), F.lit(0.0)) / F.count("*")).alias("y_")), "designs")
    folds = [r[0] for r in designs.select(fold).distinct().orderBy(fold).collect()]
    if len(folds) < 2:
        raise ValueError("cross-fitting needs at least two folds")
    kind = dict(rows.dtypes)[fold]
    unseen = F.lit(None).cast(kind)
    fitted = [(f, _fit_actions(designs.where(F.col(fold) != f), features, action, "n_")) for f in folds if f is not None]
    out = rows.where(F.col(fold).isNotNull()).withColumn("fold_", F.col(fold))
    if extra is not None:
        fitted.append((None, _fit_actions(designs, features, action, "n_")))
        out = out.unionByName(extra.withColumn("fold_", unseen))
    logits = rows.sparkSession.createDataFrame([(f, _logits(m)) for f, m in fitted], f"f_ {kind}, z_ array<array<double>>")
    out = out.join(F.broadcast(logits), F.col("fold_").eqNullSafe(F.col("f_"))).drop("f_")
    z = F.transform("z_", lambda r: sum((r[i + 1] * F.col(c) for i, c in enumerate(features)), r[0]))
    grown = F.transform(F.array(z), lambda z: F.transform(z, lambda v: F.exp(v - F.array_max(z))))[0]
    out = out.withColumn("e", F.transform(F.array(grown), lambda g: F.transform(g, lambda v: v / F.aggregate(g, F.lit(0.0), lambda a, x: a + x)))[0]).drop("z_")
    full = F.concat("e", F.array_repeat(F.lit(0.0), F.lit(actions) - F.size("e")))
    terms = F.array(F.struct(F.lit("1").alias("key"), F.lit(1.0).alias("x")), *[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("x")) for c in features])
    named = designs.withColumn("terms", terms).withColumn("fold_", F.col(fold))
    coefs = leave_one_out(named, "fold_", [action], list(keys), "y_", penalty, w="n_")
    if extra is not None:
        whole = solve_ridge(gram(named, [action], list(keys), "y_", "n_"), [action], {}, penalty)
        coefs = coefs.unionByName(whole.select(unseen.alias("fold_"), action, "key", "coef"))
    table = coefs.groupBy("fold_", action).agg(F.map_from_entries(F.collect_list(F.struct("key", "coef"))).alias("c_")).groupBy("fold_").agg(F.map_from_entries(F.collect_list(F.struct(F.col(action).cast("int"), "c_"))).alias("models_")).withColumnRenamed("fold_", "f_")
    met = out.withColumn("e", full).join(F.broadcast(table), F.col("fold_").eqNullSafe(F.col("f_")))

    def mean(a: Column) -> Column:
        own = F.try_element_at("models_", a)
        return F.coalesce(F.try_element_at(own, F.lit("1")) + sum((F.try_element_at(own, F.lit(c)) * F.col(c) for c in features), F.lit(0.0)), F.lit(0.0))

    return met.withColumn("mu", F.transform(F.sequence(F.lit(0), F.lit(actions - 1)), mean)).drop("fold_", "f_", "models_")


def _fit_actions(train: DataFrame, features: Sequence[str], action: str, weight: str | None = None):
    options = {"weightCol": weight} if weight else {}
    return LogisticRegression(featuresCol="features_", labelCol=action, family="multinomial", maxIter=60, tol=1e-9, **options).fit(assembled(train, features))


def _logits(model) -> list[list[float]]:
    """Intercept and slopes of each class; a class that is certain has an endless intercept, beside which the others have none."""
    start, slopes = model.interceptVector.toArray(), model.coefficientMatrix.toArray()
    if np.isposinf(start).any():
        start = np.where(np.isposinf(start), 0.0, -1e300)
    return np.column_stack([start, slopes]).tolist()


def pseudo_outcomes(e: Column, mu: Column, action: Column, y: Column, floor: float = 1e-6) -> Column:
    """Doubly robust values of all actions for a row: the modelled means, and for the action taken the residual over its propensity, at least `floor`, on top."""
    taken = action.cast("int")
    return F.transform(mu, lambda m, i: m + F.when(i == taken, (y - m) / F.greatest(F.get(e, taken), F.lit(max(floor, 1e-6)))).otherwise(0.0))


def policy_value(recommended: Column, e: Column, values: Column, y: Column, overlap: float) -> Column:
    """Doubly robust value of a recommended action less the outcome; 0 where none is recommended or its propensity is below `overlap`."""
    on = recommended.isNotNull() & (F.get(e, recommended) >= overlap)
    return F.when(on, F.get(values, recommended) - y).otherwise(0.0)


def prepared(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Medians for missing values, flags of where they were, and standard scores, all learned on `train`."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in features}
    filled = [f"{c}_filled" for c in features]
    imputer = Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.0001).fit(train)
    scaler = StandardScaler(inputCol="features_", outputCol="scaled_", withMean=True, withStd=True).fit(assembled(imputer.transform(train), filled))
    out = scaler.transform(assembled(imputer.transform(df.withColumns(flags)), filled)).withColumn("a_", vector_to_array("scaled_"))
    return out.withColumns({f"{c}_z": F.col("a_")[i] for i, c in enumerate(features)}).drop("features_", "scaled_", "a_", *filled)
