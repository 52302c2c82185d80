"""Byte-level BPE by overlapping chunks: boundaries of pre-tokens are stitched where chunks agree, then the pieces are encoded.

What follows a boundary of pre-tokens depends on nothing before it, so two scans
of a text that both have a boundary at a place agree from there on. A text is
cut into chunks that overlap; each is scanned from its own start, and the first
boundary that two neighbours share in their overlap joins them. Chunks without
one (a pre-token longer than the overlap) become one segment.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm._common import join_checked, map_texts, settle, slices

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0
#: Pieces that a worker remembers; beyond it, it starts anew.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line for each token, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def character_classes() -> np.ndarray:
    """Letter, digit, white space or other for every code point."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything, at, out = "".join(map(chr, points)), np.array(points), np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, everything):
            out[at[m.start() : m.end()]] = kind
    return out


def pretoken_starts(u: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for texts laid end to end as code points; `begins` are the starts of the texts that aren't empty.

    The pattern in words: a run of letters, of digits or of other characters is
    a piece, with the one space before it; white space before that is a piece,
    as is white space at a text's end; an apostrophe alone with s, t, m, d, re,
    ve or ll after it, and no space before, is a piece of its own.
    """
    n = len(u)
    kind = classes[u]
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    out = run[:n].copy()
    at = np.flatnonzero(run)
    start, end = at[:-1], at[1:]
    last = end[(kind[start] == SPACE) & ~first[end]] - 1
    out[last] = True
    out[last[u[last] == 32] + 1] = False
    q = start[(u[start] == 39) & out[start] & (start + 1 < n)]
    q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
    a = u[q + 1]
    b = np.where(q + 2 < n, np.where(first[np.minimum(q + 2, n)], 0, u[np.minimum(q + 2, n - 1)]), 0)
    long = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    short = np.isin(a, (115, 116, 109, 100))
    out[q[long | short] + 1] = False
    after = np.concatenate([q[short] + 2, q[long] + 3])
    out[after[after < n]] = True
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the whole piece if it has a rank, else pairs joined by least rank, the leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    never, get = 1 << 60, ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) <= 128:
        costs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < never:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], never)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], never)
        return [ranks[p] for p in parts]
    n = len(parts)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, pair + parts[k]))
        if (h := before[i]) >= 0 and (r := get(parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + pair))
    return [ranks[p] for p in parts if p]


class Coder:
    """Ranks, character classes and the pieces met so far, in plain containers that a worker keeps from task to task."""

    def __init__(self, held: dict) -> None:
        self.ranks, self.known, self.held = held["ranks"], held.setdefault("known", {}), held

    def classes(self) -> np.ndarray:
        if "classes" not in self.held:
            self.held["classes"] = character_classes()
        return self.held["classes"]

    def learn(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str, bounds: list[int]) -> bytes:
        """The packed ids of the pieces between bounds."""
        get, learn = self.known.get, self.learn
        return b"".join([get(p) or learn(p) for p in [text[a:b] for a, b in zip(bounds, bounds[1:])]])

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        whole = "".join(texts)
        stops = np.cumsum([len(t) for t in texts])
        starts = stops - [len(t) for t in texts]
        if not whole:
            return [b""] * len(texts)
        at = np.flatnonzero(pretoken_starts(code_points(whole), starts[starts < stops], self.classes()))
        low, high = np.searchsorted(at, starts).tolist(), np.searchsorted(at, stops).tolist()
        at, ends = at.tolist(), stops.tolist()
        return [self.encode(whole, [*at[a:b], e]) for a, b, e in zip(low, high, ends)]

    def settled_from(self, text: str) -> int:
        """The second change of class: from there on a scan from anywhere is right.

        A run of letters or digits ends with a boundary wherever the scan came
        in, and white space with one at its last space or its end. Only an
        apostrophe can be taken in two ways, and that ends with the letters
        after it.
        """
        kind = self.classes()[code_points(text)]
        change = np.flatnonzero(kind[1:] != kind[:-1])
        return int(change[1]) + 1 if len(change) > 1 else len(text) + 1

    def sure(self, text: str, whole: bool) -> np.ndarray:
        """Boundaries of a scan from the text's start; if more text follows, only those that it can't change."""
        u = code_points(text)
        starts = pretoken_starts(u, np.zeros(1, np.int64), self.classes())
        if whole:
            return np.append(np.flatnonzero(starts), len(u))
        kind = self.classes()[u]
        change = np.flatnonzero(kind[1:] != kind[:-1])
        return np.flatnonzero(starts[: change[-1] + 1 if len(change) else 0])


def encode(docs: DataFrame, keys: Sequence[str], text: str, ranks: dict[bytes, int], size: int = 1 << 16, overlap: int = 1 << 12) -> DataFrame:
    """(keys, row, part, parts, ids): the ids of every text, packed as little-endian unsigned 32-bit integers.

    Texts up to `size` characters are one part and stay where they are. Longer
    ones become chunks of `size` with `overlap` more, which are scanned in
    tasks of their own; the first boundary that both neighbours have joins
    them, a pair of chunks without one goes on as one segment, and each segment
    is a part. The parts of a text follow each other in one partition, in
    order; `row` numbers the rows, so repeated and null keys are kept apart.
    Null texts count as empty and have one part without ids. A pre-token longer
    than the overlap is held whole by a task, since its merges may reach across
    it. An empty table gives none. Columns other than the keys are not read.
    """
    if overlap >= size:
        raise ValueError("chunks have to be longer than their overlap")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({"ranks": ranks})
    base = docs.select(*[F.col(k).alias(f"key{i}_") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = "".join(f"key{i}_ {dict(docs.dtypes)[k]}, " for i, k in enumerate(keys))
    named = [f"key{i}_" for i in range(len(keys))]

    def whole(batches):
        coder = Coder(held.value)
        for batch in slices(batches):
            ids = coder.encode_all(batch.column("text").to_pylist())
            ones = pa.array(np.zeros(len(ids), np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*named, "row"]], ones, pa.array(np.ones(len(ids), np.int32)), pa.array(ids, pa.binary())], names=[*named, "row", "part", "parts", "ids"])

    def cut(batches):
        for batch in slices(batches):
            for i, t in enumerate(batch.column("text").to_pylist()):
                for k, at in enumerate(range(0, len(t), size)):
                    head = [batch.column(c).slice(i, 1) for c in [*named, "row"]]
                    yield pa.RecordBatch.from_arrays([*head, pa.array([k], pa.int32()), pa.array([at + size >= len(t)]), pa.array([t[at : at + size + overlap]])], names=[*named, "row", "k", "ends", "piece"])

    def edges(batches):
        coder = Coder(held.value)
        for batch in slices(batches):
            for row, k, ends, piece in zip(*[batch.column(c).to_pylist() for c in ("row", "k", "ends", "piece")]):
                at = coder.sure(piece, ends)
                head = at[at <= overlap] if k else at[:0]
                tail = at[:0] if ends else at[at >= max(size, coder.settled_from(piece) if k else 0)]
                n = len(head) + len(tail)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([k] * len(head) + [k + 1] * len(tail), pa.int32()), pa.array(np.concatenate([head, tail]) + k * size, pa.int64())], names=["row", "k", "place"])

    def finish(batches):
        names = [*named, "row", "part", "parts", "ids"]
        coder = Coder(held.value)
        now, texts, base_at, head, span = None, [], 0, None, None

        def close():
            begin, end = span
            own = "".join(texts)[begin - base_at :]
            bounds = coder.sure(own, end is None)
            bounds = bounds[bounds <= end - begin].tolist() if end is not None else bounds.tolist()
            return pa.RecordBatch.from_arrays([*head, pa.array([coder.encode(own, bounds)], pa.binary())], names=names)

        for batch in slices(batches):
            for i, (row, seg, k, begin, end, piece) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("row", "part", "k", "begin", "end", "piece")])):
                if (row, seg) != now:
                    if now is not None:
                        yield close()
                    now, texts, base_at = (row, seg), [], k * size
                    head, span = [batch.column(c).slice(i, 1) for c in names[:-1]], (begin, end)
                else:
                    texts[-1] = texts[-1][:size]
                texts.append(piece)
        if now is not None:
            yield close()

    schema = f"{kinds}row long, part int, parts int, ids binary"
    out = map_texts(base.where(F.length("text") <= size), whole, schema)
    chunks = settle(map_texts(base.where(F.length("text") > size), cut, f"{kinds}row long, k int, ends boolean, piece string").repartition(F.col("row"), F.col("k")), "chunks")
    shared = map_texts(chunks.select("row", "k", "ends", "piece"), edges, "row long, k int, place long")
    joints = shared.groupBy("row", "k", "place").agg(F.count("*").alias("n")).where("n = 2").groupBy("row", "k").agg(F.min("place").alias("joint"))
    order = Window.partitionBy("row").orderBy("k")
    segments = chunks.select("row", "k").join(joints, ["row", "k"], "left").withColumn("part", F.count("joint").over(order).cast("int"))
    spans = segments.groupBy("row", "part").agg(F.coalesce(F.max("joint"), F.lit(0)).alias("begin"), F.collect_list("k").alias("ks"))
    parts = Window.partitionBy("row")
    spans = spans.withColumns({"end": F.lead("begin").over(parts.orderBy("part")), "parts": F.count("*").over(parts).cast("int")})
    placed = settle(spans.select("row", F.explode("ks").alias("k"), "part", "parts", "begin", "end"), "segments")
    dealt = join_checked(chunks, placed, ["row", "k"], "inner").repartition(F.col("row"), F.col("part")).sortWithinPartitions("row", "part", "k")
    long = map_texts(dealt, finish, schema).repartition("row").sortWithinPartitions("row", "part")
    return out.unionByName(long).withColumnsRenamed(dict(zip(named, keys)))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The encoded parts with a column `decoded`: the bytes of their ids one after another. Cut parts need not end with a character."""
    table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    tokens = encoded.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*encoded.dtypes, ("decoded", "binary")])

    def run(batches):
        get = tokens.value.__getitem__
        for batch in slices(batches):
            texts = [b"".join(map(get, np.frombuffer(ids, "<u4").tolist())) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    return map_texts(encoded, run, schema)


def digests(decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_tokens, ids_sha256, decoded_sha256) of each text, whose parts follow each other in one partition, as `encode` leaves them."""
    kinds = dict(decoded.dtypes)

    def run(batches):
        n, ids, text = 0, hashlib.sha256(), hashlib.sha256()
        for batch in slices(batches):
            out = []
            for i, (part, parts, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("part", "parts", "ids", "decoded")])):
                if part == 0:
                    n, ids, text = 0, hashlib.sha256(), hashlib.sha256()
                n += len(a) // 4
                ids.update(a)
                text.update(b)
                if part + 1 == parts:
                    out.append((i, n, ids.hexdigest(), text.hexdigest()))
            at, *columns = zip(*out) if out else ([], [], [], [])
            heads = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))]], names=[*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return map_texts(decoded, run, schema)
