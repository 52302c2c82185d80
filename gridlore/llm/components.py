"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm._common import as_batch, settle

#: Parts that the edges of one node are dealt to, so that a hub's are not one task's.
SALTS = 64
#: Edges that a task joins up at once.
CHUNK = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes but the roots; a root is the least node of its component among these edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes, those of a chunk of a task's rows put together beforehand."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            size += batch.num_rows
            if size >= CHUNK:
                yield as_batch(schema, [pa.array(c) for c in forest(*map(np.concatenate, zip(*held, strict=True)))])
                held, size = [], 0
        if size:
            yield as_batch(schema, [pa.array(c) for c in forest(*map(np.concatenate, zip(*held, strict=True)))])

    return edges.mapInArrow(run, "a long, b long")


def _with_least(edges: DataFrame) -> DataFrame:
    """`edges` with m, the least b of all edges of a."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.select("a", "salt", F.min("m").over(Window.partitionBy("a")).alias("m"))  # SALTS rows a node at most
    return salted.join(least, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.union(edges.select("b", "a")))
    return both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return down.select(moved.alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's least node.

    `edges` has two long columns a and b. Self edges and repeated edges count
    once; an empty table gives an empty table. Each task first joins up the
    edges it has, in chunks of CHUNK. As long as that leaves more than one
    chunk, a star contraction follows, settled in the shared folder; rounds
    grow with the logarithm of the longest chain. A hub's edges are dealt to
    SALTS parts, whose minima meet before the parts are joined.
    """
    now = settle(_contracted(edges.where("a <> b")), "edges")
    seen = None
    while now.count() > CHUNK:
        now = settle(_contracted(_small_star(_large_star(now)).distinct()), "stars")
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38,0)))")).first())
        if mark == seen:
            break
        seen = mark
    else:
        now = settle(_contracted(now.coalesce(1)), "forest")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
