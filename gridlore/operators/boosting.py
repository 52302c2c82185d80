"""Boosting of many classes: trees whose leaves hold a value for each class, grown from histograms that Spark sums."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import gridlore

# Functions of this package travel to the executors by value.
cloudpickle.register_pickle_by_value(gridlore)

#: Shares of all combinations of bins that may be broadcast; beyond it rows are predicted one by one.
BROADCAST_SHARES = 5_000_000


@dataclass(frozen=True)
class Boost:
    """Rounds, levels of a tree, what part of a leaf's step is taken, the penalty of a leaf and the least curvature on each side of a split."""

    rounds: int = 10
    depth: int = 2
    rate: float = 0.3
    penalty: float = 1.0
    least: float = 1.0


@dataclass
class Classes:
    """A fitted model: cuts of each feature, log shares to start from, trees, and the mean loss before each round and at the end."""

    features: list[str]
    cuts: list[list[float]]
    base: np.ndarray
    trees: list = field(default_factory=list)
    losses: list[float] = field(default_factory=list)


def place_bins(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], names: Sequence[str]) -> DataFrame:
    """The rows with the number of cuts below each feature under `names`; nulls are in the first bin, NaN in the last one."""
    cut = [(f, own, n) for f, own, n in zip(features, cuts, names, strict=True) if own]
    out = df
    if cut:
        # A bucket holds its lower end, a bin its upper one.
        splits = [[-math.inf, *[math.nextafter(c, math.inf) for c in own], math.inf] for _, own, _ in cut]
        out = Bucketizer(splitsArray=splits, inputCols=[f for f, _, _ in cut], outputCols=[n for _, _, n in cut], handleInvalid="keep").transform(df)
    found = {n: F.when(F.col(f).isNull(), 0).otherwise(F.least(F.col(n).cast("int"), F.lit(len(own)))) for f, own, n in cut}
    return out.withColumns({n: found.get(n, F.lit(0)) for n in names})


def nodes_of(tree: Sequence[tuple[int, int]], bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row `depth` levels down; `tree` is (feature, last bin to the left) by heap order, feature -1 for no split."""
    at = np.zeros(len(bins), np.int64)
    for _ in range(depth):
        split = np.array([tree[i] for i in at], np.int64).reshape(-1, 2)
        value = np.where(split[:, 0] >= 0, bins[np.arange(len(bins)), np.maximum(split[:, 0], 0)], -1)
        at = 2 * at + 1 + (value > split[:, 1])
    return at


def scores(model: Classes, bins: np.ndarray, rate: float, depth: int) -> np.ndarray:
    """Log-odds of the classes, rows by classes."""
    out = np.tile(model.base, (len(bins), 1))
    for tree, leaves in model.trees:
        out += rate * leaves[nodes_of(tree, bins, depth) - (2**depth - 1)]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _best_split(hist: np.ndarray, cfg: Boost) -> tuple[int, int, np.ndarray]:
    """(feature, bin, sums left of it) of the greatest gain over a node's histogram, features by bins by gradients and curvatures; feature -1 if nothing gains."""
    k = hist.shape[2] // 2
    worth = lambda s: (s[..., :k] ** 2 / (s[..., k:] + cfg.penalty)).sum(axis=-1)
    left = hist.cumsum(axis=1)
    whole = left[:, -1:, :]
    gain = worth(left) + worth(whole - left) - worth(whole)
    enough = np.minimum(left[..., k:].sum(axis=-1), (whole - left)[..., k:].sum(axis=-1)) >= cfg.least
    gain = np.where(enough, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > 1e-9:
        return -1, 0, whole[0, 0]
    return int(f), int(b), left[f, b]


def count_cells(train: DataFrame, features: Sequence[str], y: str, classes: int, bins: int = 32) -> tuple[list[list[float]], DataFrame]:
    """Cuts of each feature at its quantiles, and the counts of the classes for each combination of bins that occurs, persisted."""
    used = train.where(F.col(y).isNotNull())
    quantiles = used.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.002)
    cuts = [sorted({c for c in q if math.nextafter(c, math.inf) < math.inf}) for q in quantiles]
    names = [f"b{i}_" for i in range(len(features))]
    binned = place_bins(used, features, cuts, names).select(*names, F.col(y).cast("int").alias("y_"))
    counted = binned.groupBy(*names, "y_").agg(F.count("*").cast("double").alias("n_")).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("y_", "n_"))).alias("m_"))
    return cuts, counted.select(*names, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.try_element_at("m_", c), F.lit(0.0))).alias("counts")).persist()


def fit_boost(train: DataFrame, features: Sequence[str], y: str, classes: int, cfg: Boost, bins: int = 32) -> Classes:
    """Multinomial boosting on softmax residuals; `y` is the class, from 0.

    Features are cut at quantiles. Rows with equal bins are one row of class
    counts, so later passes read no more rows than there are combinations. A
    level of a tree is one pass: tasks sum gradients and curvatures by node,
    feature and bin, Spark adds them up, and the driver, which gets a number
    for each node, feature, bin and class, picks the splits. Rows without a
    class are left out.
    """
    cuts, cells = count_cells(train, features, y, classes, bins)
    model = grow(cells, features, cuts, classes, cfg)
    cells.unpersist()
    return model


def grow(cells: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], classes: int, cfg: Boost) -> Classes:
    """The rounds of `fit_boost` over counted cells."""
    model = Classes(list(features), [list(c) for c in cuts], np.zeros(classes))
    names = [f"b{i}_" for i in range(len(features))]
    total = np.zeros(classes)
    for r in cells.select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        total[r["k"]] = r["n"]
    model.base = np.log((total + 0.5) / (total.sum() + 0.5 * classes))
    width, sums = max(map(len, model.cuts)) + 1, [f"s{i}" for i in range(2 * classes)]
    schema = "node int, f int, b int, " + ", ".join(f"{s} double" for s in sums)

    def histograms(tree: list, level: int) -> tuple[dict[int, np.ndarray], float]:
        shared = cells.sparkSession.sparkContext.broadcast((model.features, model.cuts, model.base, model.trees))

        def run(batches):
            now = Classes(*shared.value)
            held: dict = {}
            loss = 0.0
            for pdf in batches:
                x, n = pdf[names].to_numpy(np.int64), np.stack(pdf["counts"].to_numpy())
                p = softmax(scores(now, x, cfg.rate, cfg.depth))
                loss -= float((n * np.log(np.maximum(p, 1e-300))).sum())
                size = n.sum(axis=1, keepdims=True)
                both = np.hstack([n - size * p, size * p * (1 - p)])
                node = nodes_of(tree, x, level)
                for f in range(len(names)):
                    place, inverse = np.unique(node * width + x[:, f], return_inverse=True)
                    out = np.zeros((len(place), both.shape[1]))
                    np.add.at(out, inverse, both)
                    for key, row in zip(place.tolist(), out):
                        at = (key // width, f, key % width)
                        held[at] = held[at] + row if at in held else row
            lost = np.zeros(2 * classes)
            lost[0] = loss
            yield pd.DataFrame([(*k, *v) for k, v in [*held.items(), ((-1, 0, 0), lost)]], columns=["node", "f", "b", *sums])

        out: dict[int, np.ndarray] = {}
        loss = 0.0
        for r in cells.mapInPandas(run, schema).groupBy("node", "f", "b").agg(*[F.sum(s).alias(s) for s in sums]).collect():
            if r["node"] < 0:
                loss = r["s0"]
            else:
                out.setdefault(r["node"], np.zeros((len(names), width, 2 * classes)))[r["f"], r["b"]] = r[3:]
        return out, loss / max(total.sum(), 1.0)

    for _ in range(cfg.rounds):
        tree: list[tuple[int, int]] = [(-1, 0)] * (2**cfg.depth - 1)
        ends = {0: None}
        for level in range(cfg.depth):
            found, loss = histograms(tree, level)
            if level == 0:
                model.losses.append(loss)
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                if node not in found:
                    ends[2 * node + 1] = ends[2 * node + 2] = None
                    continue
                f, b, left = _best_split(found[node], cfg)
                tree[node] = (f, b)
                ends[2 * node + 1], ends[2 * node + 2] = (left, found[node][0].sum(axis=0) - left) if f >= 0 else (left, None)
        first = 2**cfg.depth - 1
        leaves = np.zeros((first + 1, classes))
        for i in range(first + 1):
            if (s := ends.get(first + i)) is not None:
                leaves[i] = s[:classes] / (s[classes:] + cfg.penalty)
        model.trees.append((tree, leaves))
    model.losses.append(histograms([(-1, 0)] * (2**cfg.depth - 1), 0)[1])
    return model


def predict_boost(df: DataFrame, model: Classes, cfg: Boost, name: str = "shares", also: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows with an array of the classes' shares, and `also` columns computed from it alone.

    Rows of equal bins have equal shares, so each combination of bins is
    predicted once, with its other columns, and joined to its rows; only where
    the combinations are too many to be broadcast, each row is predicted.
    """
    also, names, sizes = dict(also or {}), [f"b{i}_" for i in range(len(model.features))], [len(c) + 1 for c in model.cuts]
    shared = df.sparkSession.sparkContext.broadcast((model.features, model.cuts, model.base, model.trees))

    @F.pandas_udf("array<double>")
    def shares(bins: pd.Series) -> pd.Series:
        x = np.stack(bins.to_numpy()).astype(np.int64)
        return pd.Series(list(softmax(scores(Classes(*shared.value), x, cfg.rate, cfg.depth))))

    placed = place_bins(df, model.features, model.cuts, names)
    if math.prod(sizes) * len(model.base) > BROADCAST_SHARES:
        return placed.withColumn(name, shares(F.array(*names))).withColumns(also).drop(*names)
    digit = lambda i: F.expr(f"CAST(id div {math.prod(sizes[i + 1 :])} % {sizes[i]} AS INT)")
    cells = df.sparkSession.range(math.prod(sizes)).select(*[digit(i).alias(n) for i, n in enumerate(names)])
    valued = cells.withColumn(name, shares(F.array(*names))).withColumns(also)
    return placed.drop(name, *also).join(F.broadcast(valued), names).drop(*names)


def class_crps(shares: Column, y: Column) -> Column:
    """The ranked score of a distribution over ordered classes: squared gaps of the distribution functions, summed."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))

    def step(a: Column, p: Column) -> Column:
        c = a["c"] + p
        return F.struct(c.alias("c"), (a["s"] + F.pow(c - F.when(y <= a["k"], 1.0).otherwise(0.0), 2)).alias("s"), (a["k"] + 1).alias("k"))

    return F.aggregate(shares, start, step, lambda a: a["s"])


def class_scores(shares: Column) -> Column:
    """`class_crps` of each class in order, and last that of a class beyond them, which null counts as."""
    return F.transform(F.sequence(F.lit(0), F.size(shares)), lambda k: class_crps(shares, k))


def score_at(scored: Column, y: Column) -> Column:
    """The entry of `class_scores` for a row's class."""
    last = F.size(scored) - 1
    return F.get(scored, F.greatest(F.least(F.coalesce(y.cast("int"), last), last), F.lit(0)))


def choose_boost(train: DataFrame, held: DataFrame, features: Sequence[str], y: str, classes: int, grid: Mapping[str, Boost]) -> tuple[str, dict[str, float]]:
    """The setting of the least mean score on held-out rows, the first among equals, and the scores of all; the settings share the counted cells."""
    table = {}
    cuts, cells = count_cells(train, features, y, classes)
    for name, cfg in grid.items():
        model = grow(cells, features, cuts, classes, cfg)
        scored = predict_boost(held, model, cfg, also={"scores": class_scores(F.col("shares"))})
        table[name] = scored.agg(F.avg(score_at(F.col("scores"), F.col(y)))).first()[0]
    cells.unpersist()
    return min(table, key=lambda k: (table[k], list(table).index(k))), table
