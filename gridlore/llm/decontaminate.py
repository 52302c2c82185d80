"""Benchmark decontamination with training suffix arrays (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import ALNUM, as_batch, free_name, map_texts, settle, slices, utf8, word_blocks

#: Bytes of benchmark text that go to the executors at once, as about as many bytes of word numbers; a larger benchmark is searched block after block.
BLOCK_BYTES = 64 << 20
#: Test suffixes that are searched at once.
SUFFIXES = 1 << 18


@dataclass
class Tests:
    """A benchmark block: its words as numbers, and the suffixes of its distinct texts that hold a window."""

    width: int
    words: dict[bytes, int]  # from 1; 0 is any other word
    text: np.ndarray  # word numbers of one text after the other, -1 after each
    suffixes: np.ndarray  # places in text
    depths: np.ndarray  # words of the window at the suffix
    owner: np.ndarray  # number of the suffix's text
    begins: np.ndarray  # place of text i
    starts: np.ndarray  # names of text i: items[starts[i]:starts[i + 1]]
    items: np.ndarray
    names: list[str]


def read_tests(rows: list[tuple[object, str | None]], width: int) -> Tests:
    words: dict[bytes, int] = {}
    names: dict[str, int] = {}
    texts: dict[bytes, set[int]] = {}
    for item, text in rows:
        name = names.setdefault("" if item is None else str(item), len(names))
        ids = [words.setdefault(w, len(words) + 1) for part in word_blocks((text or "").encode(), ALNUM) for w in part]
        if ids:
            texts.setdefault(np.array(ids, np.int32).tobytes(), set()).add(name)
    parts = [np.frombuffer(t, np.int32) for t in texts]
    sizes = np.array([len(x) for x in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
    depth = np.minimum(sizes, width)
    many = sizes - depth + 1
    owner = np.repeat(np.arange(len(parts)), many)
    suffixes = np.repeat(begins, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    held = [sorted(x) for x in texts.values()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
    text = np.concatenate([np.append(x, np.int32(-1)) for x in parts]) if parts else np.zeros(0, np.int32)
    return Tests(width, words, text, suffixes, np.repeat(depth, many), owner, begins, starts, np.array([i for x in held for i in x], np.int64), list(names))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of `ids`, sorted by the `depth` or more numbers that follow, by doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def _common_words(ids: np.ndarray, at: np.ndarray, text: np.ndarray, suffix: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many words the suffixes of `ids` at `at` and of `text` at `suffix` have in common, `most` at most; both arrays end in numbers that the other lacks."""
    out = np.zeros(len(at), np.int64)
    active, k = np.flatnonzero(at < len(ids)), 0
    while len(active):
        if most is not None:
            active = active[most[active] > k]
        active = active[ids[at[active] + k] == text[suffix[active] + k]]
        k += 1
        out[active] = k
    return out


def _bound(ids: np.ndarray, order: np.ndarray, text: np.ndarray, suffix: np.ndarray, depth: np.ndarray | None, upper: bool) -> np.ndarray:
    """Binary search of test suffixes in the suffix array, by `depth` words or all: the first that is not below, or that is above."""
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order), np.int64)
    while (active := np.flatnonzero(lo < hi)).size:
        mid = (lo[active] + hi[active]) >> 1
        most = None if depth is None else depth[active]
        same = _common_words(ids, order[mid], text, suffix[active], most)
        whole = np.zeros(len(active), bool) if most is None else same >= most
        below = ids[order[mid] + np.where(whole, 0, same)] < text[suffix[active] + np.where(whole, 0, same)]
        right = np.where(whole, upper, below)
        lo[active[right]] = mid[right] + 1
        hi[active[~right]] = mid[~right]
    return lo


@dataclass
class Shard:
    """The suffix array of a slice's runs of benchmark words."""

    ids: np.ndarray  # word numbers of all texts, 0 after each
    ends: np.ndarray  # place after each text
    lengths: np.ndarray
    part: np.ndarray  # the runs alone, 0 after each
    place: np.ndarray  # of the runs' words in ids
    order: np.ndarray


def read_shard(texts: list[bytes | None], tests: Tests) -> Shard:
    """Words that no item has can't be part of a match, so the array holds only runs of the benchmark's words that are as long as the shortest window."""
    get = tests.words.get
    numbers = [np.fromiter((get(w, 0) for part in word_blocks(t, ALNUM) for w in part), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    lengths = np.array([len(x) for x in numbers], np.int64)
    ends = np.cumsum(lengths + 1)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for x, end in zip(numbers, ends, strict=True):
        ids[end - 1 - len(x) : end - 1] = x
    part, place, order = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(tests.suffixes):
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begin, stop = edges[::2], edges[1::2]
        long = stop - begin >= tests.depths.min()
        begin, stop = begin[long], stop[long]
        if len(begin):
            size = stop - begin + 1
            place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            part = ids[place]
            order = suffix_array(part, int(np.diff(np.append(tests.begins, len(tests.text))).max()))
    return Shard(ids, ends, lengths, part, place, order)


def matches(shard: Shard, tests: Tests) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each suffix of the tests that the shard has a window of, in chunks: the suffix's number, its longest match's words, where that is, and its windows' range in the array."""
    if not len(shard.order):
        return
    for first in range(0, len(tests.suffixes), SUFFIXES):
        number = np.arange(first, min(first + SUFFIXES, len(tests.suffixes)))
        suffix, depth = tests.suffixes[number], tests.depths[number]
        at = _bound(shard.part, shard.order, tests.text, suffix, None, False)
        above = shard.order[np.minimum(at, len(shard.order) - 1)]
        below = shard.order[np.maximum(at - 1, 0)]
        n = [_common_words(shard.part, x, tests.text, suffix) for x in (above, below)]
        longest, where = np.maximum(*n), np.where(n[0] >= n[1], above, below)
        met = longest >= depth
        if met.any():
            lo, hi = (_bound(shard.part, shard.order, tests.text, suffix[met], depth[met], upper) for upper in (False, True))
            yield number[met], longest[met], where[met], np.stack([lo, hi])


@dataclass
class Judged:
    """What the tests have of one text."""

    words: int
    hit: np.ndarray  # flags of the words inside a window's occurrence
    items: np.ndarray
    longest: tuple[int, str, int, int] | None = None  # words, item, place in the text, place in the item


def search(texts: list[bytes | None], tests: Tests) -> list[Judged]:
    """The windows of the tests in each text and the longest verbatim match, by one shard's suffix array."""
    shard = read_shard(texts, tests)
    hit = np.zeros(len(shard.ids) + 1, np.int64)
    pairs, best = [np.zeros(0, np.int64)], {}
    for number, _, _, (lo, hi) in matches(shard, tests):
        n = hi - lo
        which = np.repeat(number, n)
        inner = shard.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        at, suffix, owner = shard.place[inner], tests.suffixes[which], tests.owner[which]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + tests.depths[which], -1)
        doc = np.searchsorted(shard.ends, at, side="right")
        pairs.append(np.unique(doc * len(tests.begins) + owner))
        # a match that the word before goes on is part of a longer one
        lead = (suffix == tests.begins[owner]) | (inner == 0) | (shard.part[inner - 1] != tests.text[suffix - 1])
        length = _common_words(shard.part, inner[lead], tests.text, suffix[lead])
        order = np.lexsort((-length, doc[lead]))
        ranked = doc[lead][order]
        top = np.maximum.reduceat(length[order], np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))) if len(order) else length
        full = np.zeros(len(texts), np.int64)
        full[np.unique(ranked)] = top
        for i in np.flatnonzero(length == full[doc[lead]]).tolist():
            d, o = int(doc[lead][i]), int(owner[lead][i])
            name = min(tests.names[k] for k in tests.items[tests.starts[o] : tests.starts[o + 1]])
            found = (-int(length[i]), name, int(at[lead][i] - (shard.ends[d] - 1 - shard.lengths[d])), int(suffix[lead][i] - tests.begins[o]))
            best[d] = min(best.get(d, found), found)
    seen = np.unique(np.concatenate(pairs))
    doc, owner = (seen // len(tests.begins), seen % len(tests.begins)) if len(seen) else (seen, seen)
    n = tests.starts[owner + 1] - tests.starts[owner]
    item = tests.items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tests.starts[owner], n)]
    both = np.unique(np.repeat(doc, n) * len(tests.names) + item)
    found_doc, found_item = (both // len(tests.names), both % len(tests.names)) if len(both) else (both, both)
    flags = np.cumsum(hit)[:-1] > 0
    cut = np.searchsorted(found_doc, np.arange(len(texts) + 1))
    out = []
    for i, (n_words, end) in enumerate(zip(shard.lengths.tolist(), shard.ends.tolist(), strict=True)):
        length = best.get(i)
        out.append(Judged(n_words, flags[end - 1 - n_words : end - 1], found_item[cut[i] : cut[i + 1]], (-length[0], *length[1:]) if length else None))
    return out


def _spans(flags: np.ndarray) -> list[int]:
    """Starts and ends of the hit words, in turn."""
    edge = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(edge[1:] != edge[:-1]).tolist()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items in blocks of about `block_bytes` of text."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i) if blocks > 1 else items for i in range(blocks)]


def _sent(spark, block: DataFrame, width: int):
    """A block's tests as a broadcast variable."""
    return spark.sparkContext.broadcast(astuple(read_tests([tuple(r) for r in block.collect()], width)))


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_at, length, doc_id, doc_at): the longest verbatim match of each item in all of `docs`, in words.

    Every suffix of the item is looked up in each shard's suffix array; its
    longest match is with one of the two neighbours of its place there. Items
    without a match of `width` words (or all, if they are shorter) have no row;
    of equally long matches one is told. Nulls and empty tables are as in
    `contamination`; rows that repeat change nothing.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "item_id string, item_at int, length int, doc_id long, doc_at int"
    schema = pa.schema([("item_id", pa.string()), ("item_at", pa.int32()), ("length", pa.int32()), ("doc_id", pa.int64()), ("doc_at", pa.int32())])

    def one(block: DataFrame) -> DataFrame:
        shared = _sent(spark, block, width)

        def run(batches):
            tests = Tests(*shared.value)
            for batch in slices(batches, 4 << 20):
                shard, rows = read_shard(utf8(batch.column(1)), tests), []
                for number, longest, where, _ in matches(shard, tests):
                    order = np.lexsort((-longest, tests.owner[number]))
                    for i in order[np.flatnonzero(np.append(True, np.diff(tests.owner[number][order]) > 0))].tolist():
                        o, at = int(tests.owner[number[i]]), int(shard.place[where[i]])
                        d = int(np.searchsorted(shard.ends, at, side="right"))
                        told = (int(tests.suffixes[number[i]] - tests.begins[o]), int(longest[i]), batch.column(0)[d].as_py(), at - int(shard.ends[d] - 1 - shard.lengths[d]))
                        rows += [(tests.names[k], *told) for k in tests.items[tests.starts[o] : tests.starts[o + 1]]]
                yield as_batch(schema, [[r[i] for r in rows] for i in range(5)])

        return map_texts(base, run, ddl)

    found = reduce(DataFrame.union, map(one, _blocks(benchmark, item_col, item_text_col, block_bytes)))
    return found.groupBy("item_id").agg(F.max_by(F.struct("item_at", "length", "doc_id", "doc_at"), "length").alias("m")).select("item_id", "m.*")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of `docs`: what windows of `width` benchmark words hit in it.

    Columns: doc_id, n_words, n_hit (words inside a window's occurrence),
    n_items, items_sha256, contaminated, spans (starts and ends of the runs of
    hit words, counted in words), longest_hit (words of the longest verbatim
    match with one item), longest_item, longest_item_at and longest_at (that
    item and the match's places in it and in the text; null without a match);
    and the columns of `docs` named in `keep`, which keep their names if they
    differ from these.

    Each slice of a partition is a shard: its words that a benchmark has too
    are sorted into a suffix array, in which every suffix of the benchmark's
    items that holds a window is looked up by binary search. No row is
    shuffled. The benchmark goes to the executors in blocks of `block_bytes` of
    text. A benchmark of more blocks means that `docs` is settled in the shared
    folder and passed over once a block; the results are united for each row.

    Null texts and empty ones have no words and no hits. An item without words
    has no window; an item of fewer than `width` words is one window. Items
    that repeat an id count once; a null id is the empty string. Rows of `docs`
    that repeat, or have a null id, each come out. An empty benchmark or table
    of documents is no error.
    """
    spark = docs.sparkSession
    keep = keep or []
    kept = [docs.schema[c] for c in keep]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in keep])
    blocks, row = _blocks(benchmark, item_col, item_text_col, block_bytes), free_name(docs, "row_")
    if len(blocks) > 1:
        base = settle(base.withColumn(row, F.monotonically_increasing_id()), "texts")
        kept = [*kept, base.schema[row]]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("item", pa.string()), ("at", pa.int32()), ("item_at", pa.int32())])

    def one(block: DataFrame) -> DataFrame:
        shared = _sent(spark, block, width)

        def run(batches):
            tests = Tests(*shared.value)
            for batch in slices(batches, 4 << 20):
                found = search(utf8(batch.column(1)), tests)
                told = [[x.longest[i] if x.longest else (None if i else 0) for x in found] for i in range(4)]
                own = as_batch(schema, [batch.column(0), [x.words for x in found], [_spans(x.hit) for x in found], [[tests.names[i] for i in x.items] for x in found], *told])
                rest = [batch.column(i) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own.columns, *rest], names=[*own.schema.names, *batch.schema.names[2:]])

        kept_ddl = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
        return map_texts(base, run, f"doc_id long, n_words long, spans array<int>, items array<string>, longest int, item string, at int, item_at int{kept_ddl}")

    out = reduce(DataFrame.union, map(one, blocks))
    if len(blocks) > 1:
        best = F.min(F.struct((-F.col("longest")).alias("less"), "item", "at", "item_at")).alias("best")
        out = out.groupBy(row).agg(*[F.first(c).alias(c) for c in ["doc_id", "n_words", *keep]], F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best)
        out = out.withColumns({"spans": _united("spans"), "longest": -F.col("best.less"), "item": F.col("best.item"), "item_at": F.col("best.item_at"), "at": F.col("best.at")})
    n_hit = F.aggregate(_pairs("spans"), F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    places = [F.col("longest").alias("longest_hit"), F.col("item").alias("longest_item"), F.col("item_at").alias("longest_item_at"), F.col("at").alias("longest_at")]
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _digest("items").alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), "spans", *places, *keep)


def _pairs(c: str):
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(c)), lambda i: (i % 2 == 0) & (i < F.size(c))), lambda i: F.struct(F.get(F.col(c), i).alias("start"), F.get(F.col(c), i + 1).alias("stop")))


def _united(c: str):
    """The union of several lists of spans, as one."""
    pairs = F.array_sort(F.flatten(F.transform(F.col(c), lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i % 2 == 0) & (i < F.size(s))), lambda i: F.struct(F.get(s, i).alias("start"), F.get(s, i + 1).alias("stop"))))))

    def add(done, s):
        n = F.size(done)
        last = F.get(done, n - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.greatest(last, s["stop"])))
        return F.when((n > 0) & (s["start"] <= last), joined).otherwise(F.concat(done, F.array(s["start"], s["stop"])))

    return F.aggregate(pairs, F.array().cast("array<int>"), add)


def _digest(c: str):
    return F.sha2(F.array_join(F.array_sort(c), ","), 256)


def sha256_of_items(items: list[str]) -> str:
    """The digest of item ids as the query returns it, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that no benchmark window occurs in, with all their columns, in one pass; awkward rows are as in `contamination`."""
    inner = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), *[F.col(c).alias(f"c{i}_") for i, c in enumerate(docs.columns)])
    judged = contamination(inner, benchmark, width, "id_", "text_", keep=[f"c{i}_" for i in range(len(docs.columns))], **options)
    return judged.where("not contaminated").select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)])
