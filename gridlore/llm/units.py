"""Substring deduplication by hashing lines and their pieces (operator 10)."""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridlore.llm._common import as_batch, free_name, map_texts, mixed, settle, slices, span_hashes

#: A line is cut before a word whose hash is the least of its CONTEXT neighbours on both sides.
CONTEXT = 4
#: Characters of a block; a longer line is also cut at its end.
BLOCK = 1 << 20
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _point_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and white space of the first plane's characters, those whose lower case is one character."""
    if not _tables:
        chars = [chr(i) for i in range(1 << 16)]
        low = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
        _tables.append((low, np.array([c.isspace() for c in chars])))
    return _tables[0]


def _blocks(points: np.ndarray):
    """(place, block) of a text, cut after white space, at a line's end if there is one in the block's last half."""
    at, n, space = 0, len(points), _point_tables()[1]
    while n - at > BLOCK:
        for part in (points[at + BLOCK // 2 : at + BLOCK] == 10, space[np.minimum(points[at + BLOCK // 2 : at + BLOCK], 0xFFFF)]):
            found = np.flatnonzero(part)
            if len(found):
                break
        end = at + BLOCK // 2 + int(found[-1]) + 1 if len(found) else at + BLOCK
        yield at, points[at:end]
        at = end
    yield at, points[at:]


def units(text: str) -> tuple[np.ndarray, ...]:
    """start and stop (characters), words and the two halves of a 128-bit digest of the units of a text, in order.

    Units are lines; those of more than a few words are cut further before each
    word whose hash is the least among its neighbours, so that a passage is cut
    alike wherever it stands but for its first and last words. Words are runs of
    anything but white space, in lower case.
    """
    low, white = _point_tables()
    out = []
    for at, points in _blocks(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)):
        first = np.minimum(points, 0xFFFF)
        word = np.concatenate([[False], ~white[first], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            continue
        line = np.cumsum(points == 10)[start]
        h = span_hashes(np.where(points <= 0xFFFF, low[first], points), start, stop)
        cut = np.ones(len(h), bool)
        for j in range(1, min(CONTEXT, len(h) - 1) + 1):
            same = line[j:] == line[:-j]
            cut[j:] &= ~(same & (h[j:] >= h[:-j]))
            cut[:-j] &= ~(same & (h[:-j] > h[j:]))
        cut[1:] |= line[1:] != line[:-1]
        cut[0] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(h))
        out.append((at + start[a], at + stop[b - 1], b - a, span_hashes(h, a, b), span_hashes(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), a, b)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))


def text_key(text: str | None) -> int:
    """Spark's xxhash64 of the text."""
    value = xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace"), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def unit_table(docs: DataFrame) -> DataFrame:
    """(d1, d2, id, tk, seq, start, stop, words) of each unit of `docs` (id, text); d1 and d2 are its 128-bit digest."""
    schema = pa.schema([(n, pa.int64()) for n in ("d1", "d2", "id", "tk")] + [(n, pa.int32()) for n in ("seq", "start", "stop", "words")])

    def run(batches):
        for batch in slices(batches, 4 << 20):
            found = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, stop, words, d1, d2 = units(text) if text else units("")
                if len(start):
                    found.append((d1.view(np.int64), d2.view(np.int64), [ident] * len(start), np.full(len(start), text_key(text)), np.arange(len(start)), start, stop, words))
            if found:
                d1, d2, ident, *rest = zip(*found, strict=True)
                columns = [np.concatenate(x) for x in (d1, d2)] + [[i for x in ident for i in x]] + [np.concatenate(x) for x in rest]
                yield as_batch(schema, [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)])

    return map_texts(docs, run, "d1 long, d2 long, id long, tk long, seq int, start int, stop int, words int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(id, tk, spans): for each text with repeated passages, the start and stop characters of those to remove.

    Of equal units in all documents the one that ranks first stays: by id (null
    first), text key and place. The others are put together with their
    neighbours, and those runs go that have `min_words` words or more.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = settle(unit_table(plain), "units").repartition("d1", "d2")
    first = F.min(F.struct("id", "tk", "start", "seq", "stop", "words")).alias("first")  # all columns, so that both sides of the join read one shuffle
    several = every.groupBy("d1", "d2").agg(first, F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    met = every.join(several, ["d1", "d2"])
    gone = met.where(~F.struct("id", "tk", "start").eqNullSafe(F.struct("first.id", "first.tk", "first.start"))).select("id", "tk", "seq", "start", "stop", "words")
    inside = Window.partitionBy("id", "tk").orderBy("seq")
    once = gone.withColumn("before", F.lag("seq").over(inside)).where("before is null or before <> seq")  # rows that repeat id and text
    numbered = once.withColumn("run", F.col("seq") - F.row_number().over(inside))
    runs = numbered.groupBy("id", "tk", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words")).where(F.col("words") >= min_words)
    spans = runs.groupBy("id", "tk").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return settle(spans, "spans")


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """`docs` with repeated passages taken out of the text, and two more columns, removed and n_removed.

    Lines and the pieces of long lines are hashed and grouped over all
    documents; the first occurrence stays (see `repeated_spans`). A repeated
    line, paragraph or run of lines of `min_words` words or more goes as a
    whole; a repeated passage inside other lines goes but for some words at its
    ends. removed holds (start, stop) in characters of the original text, in
    order.

    A passage that is repeated in one document loses its later occurrences
    there too. Passages of fewer than `min_words` words always stay. Rows that
    repeat an id and a text are one document here and come out alike. Null and
    empty texts stay as they are, with nothing removed; ids may be null. An
    empty table gives an empty one. If `docs` has a column named like one of
    ours, "_" is added to ours.
    """
    gone = repeated_spans(docs, id_col, text_col, min_words)
    spans, count, unit_id, unit_key = (free_name(docs, n) for n in ("removed", "n_removed", "unit_id", "unit_key"))
    right = gone.select(F.col("id").alias(unit_id), F.col("tk").alias(unit_key), F.col("spans").alias(spans))
    same = docs[id_col].cast("long").eqNullSafe(F.col(unit_id)) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col(unit_key))
    joined = docs.join(right, same, "left")
    met = F.col(spans).isNotNull()
    cut = F.when(met, _cut(F.when(met, docs[text_col].cast("string")), F.col(f"{spans}.start"), F.col(f"{spans}.stop"))).otherwise(docs[text_col])
    columns = [cut.alias(c) if c == text_col else docs[c] for c in docs.columns]
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select(*columns, F.coalesce(F.col(spans), none).alias(spans), F.greatest(F.size(spans), F.lit(0)).alias(count))


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    def one(text, start, stop):
        if text is None or start is None:
            return text
        at = [0, *stop], [*start, len(text)]
        return "".join(text[a:b] for a, b in zip(*at, strict=True))

    return pd.Series([one(*x) for x in zip(texts, starts, stops, strict=True)], dtype=object)
