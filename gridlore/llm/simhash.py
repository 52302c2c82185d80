"""SimHash near-duplicate groups, searched with BK-trees (operator 7)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import NON_SPACE, as_batch, map_texts, runs, settle, slices, utf8, word_blocks
from gridlore.llm.components import components

#: Fingerprints of one shard up to which a BK-tree is grown; larger shards take the exact flip search.
TREE_LIMIT = 1024


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle, block by block; a shorter text is one shingle."""
    digest, tail, found = xxhash.xxh64_intdigest, [], False
    for words in word_blocks(text, NON_SPACE):
        words = tail + words
        if len(words) >= width:
            found = True
            columns = [words[i:] for i in range(width)]
            yield np.array([digest(b" ".join(w), seed) for w in zip(*columns, strict=False)], dtype=">u8")
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if not found and tail:
        yield np.array([digest(b" ".join(tail), seed)], dtype=">u8")


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash; null and wordless texts have 0."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or b"", width, seed):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row; whole texts, in blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(t, width, seed) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield as_batch(schema, [batch.column(0), pa.array(values.view(np.int64))])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their whole-number Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            edge = (value ^ self.values[at]).bit_count()
            if edge not in self.children[at]:
                self.children[at][edge] = len(self.values) - 1
                return
            at = self.children[at][edge]

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at `radius` or less; only edges within the radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for edge, c in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join all values within the radius of each other, a spanning forest of them."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((value, values[j]))
        tree.add(value)
    return links


def _shard_keys(radius: int) -> list[tuple[int, int]]:
    """(number, mask) of the shardings: values within the radius agree on the bits of one mask at least.

    The 64 bits are cut into radius + 2 blocks; at most `radius` of them
    differ, so two blocks are equal, and every pair of blocks is a sharding.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [(i, x | y) for i, (x, y) in enumerate(itertools.combinations(blocks, 2))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _grow(limit: int, radius: int):
    """Reads shards sorted by key; yields links, or the members of a shard that is too large for a tree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []
        size, key, over = 0, None, False

        def close():
            if over or size < 2:
                return [], []
            links = tree_links(np.concatenate(held).tolist(), radius)
            return [x for x, _ in links], [y for _, y in links]

        for batch in batches:
            shard, mark, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            a: list[int] = []
            b: list[int | None] = []
            cuts = runs(shard, mark)
            for lo, hi in itertools.pairwise(cuts.tolist()):
                now = (int(shard[lo]), int(mark[lo]))
                if now != key:
                    x, y = close()
                    a += x
                    b += y
                    held, size, key, over = [], 0, now, False
                size += hi - lo
                held.append(fp[lo:hi].view(np.uint64))
                if size > limit:
                    over = True
                    for part in held:
                        a += part.view(np.int64).tolist()
                        b += [None] * len(part)
                    held = []
            yield as_batch(schema, [pa.array([_signed(v) for v in a], pa.int64()), pa.array([None if v is None else _signed(v) for v in b], pa.int64())])
        x, y = close()
        yield as_batch(schema, [pa.array([_signed(v) for v in x], pa.int64()), pa.array([_signed(v) for v in y], pa.int64())])

    return run


def _flip_links(fps: DataFrame, radius: int) -> DataFrame:
    """Exact links of the members of large shards, in groups of 65 at most.

    Two values differ in two bits or fewer if and only if one value is at one
    flip or none from both. So each value is dealt to its 65 such values; of
    those at one place, all are within two bits of each other. For a radius of
    1, values meet that are equal but for a named bit.
    """
    bits = F.sequence(F.lit(0), F.lit(63))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    if radius == 2:
        flips = F.concat(F.array("fp"), F.transform(bits, lambda i: F.col("fp").bitwiseXOR(one(i))))
    else:
        flips = F.transform(bits, lambda i: F.xxhash64(F.col("fp").bitwiseOR(one(i)), i))
    met = fps.select("fp", F.explode(flips).alias("at")).groupBy("at").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    pairs = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return pairs.where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def fingerprint_links(fps: DataFrame, radius: int = 2, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at `radius` (1 or 2) or fewer differing bits.

    `fps` has one long column fp of distinct values. A fingerprint goes to the
    shards that its blocks of bits name; each shard grows one BK-tree and asks
    it for each member. Shards of over `tree_limit` members, such as those of
    one great group of near copies, take the exact flip search instead. Only a
    spanning forest of a shard's links is returned, which keeps the components.
    """
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2 differing bits is provided for")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("mark")) for i, mask in _shard_keys(radius)])
    rows = fps.select(F.explode(shards).alias("s"), "fp").select("s.shard", "s.mark", "fp").repartition("shard", "mark").sortWithinPartitions("shard", "mark", "fp")
    found = settle(rows.mapInArrow(_grow(tree_limit, radius), "a long, b long"), "bk")
    links = found.where("b is not null")
    over = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return links.union(_flip_links(over, radius))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    Null and wordless texts have fingerprint 0 and link like any other; rows
    that repeat each come out; a null id comes out as null and never names a
    component unless nothing else could (then component_id is null). An empty
    table gives an empty table; columns other than the two are not read.
    """
    rows = settle(simhash(docs, id_col, text_col, width), "simhash")
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = settle(components(fingerprint_links(fps.select("fp"), radius, tree_limit)), "roots").withColumnRenamed("node", "fp")
    linked = fps.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    all_fps = settle(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    out = rows.join(all_fps, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
