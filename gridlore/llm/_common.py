"""Helpers shared by the corpus operators: settled tables, checked joins, word reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gridlore

# Functions of this package travel to the executors by value, so that no
# executor needs the repository on its own disk.
cloudpickle.register_pickle_by_value(gridlore)

#: Rows up to which a side may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not use, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; where none is named, a temporary one, which only a local session may have."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridlore/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a settled `right`; it is broadcast only if its counted rows are few."""
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """`mapInArrow` over rows with whole texts, in batches of fewer rows unless the session says how many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, "1000")
    return df.mapInArrow(run, schema)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_table(word: bytes, lower: bool = True) -> bytes:
    """A translation table: bytes outside `word` become spaces, A-Z lower-cased."""
    keep = set(word)
    out = bytearray(256)
    for b in range(256):
        low = b + 32 if lower and 65 <= b <= 90 else b
        out[b] = low if low in keep else 32
    return bytes(out)


#: Words are runs of anything but ASCII white space.
NON_SPACE = byte_table(bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"))
#: Words are runs of digits, letters a-z and all bytes beyond ASCII.
ALNUM = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def word_blocks(text: bytes, table: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about `block` bytes each."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + block)
        piece = text[at:end].translate(table)
        while end < n and not piece.endswith(b" "):
            more = text[end : end + 4096].translate(table)
            cut = more.find(b" ")
            piece += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        at = end
        yield piece.split()


def utf8(array: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def slices(batches, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that no slice holds more than about `limit` bytes of rows."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * limit / max(1, batch.nbytes))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted columns, and the end."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


#: Base of the rolling hashes, odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, from 0 to n - 1 at least."""
    if not _cache or len(_cache[0][0]) < n:
        n = max(n, 1 << 16)
        _cache[0] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, _INVERSE))
    return _cache[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:stop] for each span, from running sums."""
    power, inverse = _powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * power[: len(values)], dtype=np.uint64)])
    return mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
