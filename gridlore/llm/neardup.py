"""Near-duplicate removal by SimHash with a verified similarity of word shingles (operator 7 in the pipeline)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import NON_SPACE, as_batch, free_name, join_checked, map_texts, mixed, settle, slices, utf8, word_blocks
from gridlore.llm.components import components
from gridlore.llm.simhash import fingerprint_links

#: Bands of a sketch and minima of a band: texts of similarity 0.8 share a band with probability 0.9998.
BANDS, ROWS = 16, 4
#: Of a round over unresolved texts: sketches of least hashes, and the lengths to which they are compared.
TREES, DEPTHS = 64, (8, 12, 16)
#: Copies of a leader's shingles at most, so that its pairs are not one task's.
SALTS = 32
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of all word shingles of a whole text, repeats included; a shorter text is one shingle."""
    digest = xxhash.xxh64_intdigest
    known: dict[bytes, int] = {}
    words = np.fromiter((known[w] if w in known else known.setdefault(w, digest(w)) for part in word_blocks(text or b"", NON_SPACE) for w in part), np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ words[i : i + n]) * _STEPS[i % 5]
        out ^= out >> np.uint64(29)
    return out


def _simhash(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _bands(unique: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(unique), 4096):
        part = unique[at : at + 4096]
        least = np.minimum(least, (part[:, None] * _SEEDS).min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        out = (out ^ (least.reshape(BANDS, ROWS)[:, i] >> np.uint64(8))) * _STEPS[i]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _sketches(keyed: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            fps, bands = [], []
            for text in utf8(batch.column(2)):
                found = shingles(text, width)
                fps.append(_simhash(found))
                bands.append(_bands(np.unique(found)) if len(found) else np.zeros(BANDS, np.int64))
            yield as_batch(schema, [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), bands])

    return map_texts(keyed, run, "doc_id long, tk long, fp long, bands array<long>")


def _sets(keyed: DataFrame, width: int) -> DataFrame:
    """(uid, own): the distinct shingle hashes of each text, sorted, as bytes."""
    schema = pa.schema([("uid", pa.int64()), ("own", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            yield as_batch(schema, [batch.column(0), [np.unique(shingles(t, width)).tobytes() for t in utf8(batch.column(1))]])

    return map_texts(keyed.select("uid", "text"), run, "uid long, own binary")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, x, y) whose sets x and y have a Jaccard similarity of `similarity` or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield as_batch(schema, [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)])

    return map_texts(pairs.select("a", "b", "x", "y"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar, by the sets (uid, own); b may be the leader of many."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    leads = salted.select("b", "salt").distinct().join(sets.select(F.col("uid").alias("b"), F.col("own").alias("y")), "b")
    full = salted.join(leads, ["b", "salt"]).join(sets.select(F.col("uid").alias("a"), F.col("own").alias("x")), "a")
    return _similar(full, similarity)


def _deep_sketches(sets: DataFrame, seed: int) -> DataFrame:
    """(key, uid, root, size, draw) of each set (uid, root, own): its TREES sketches to each of the DEPTHS, and a hash of the set."""
    schema = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("draw", pa.int64())])
    odd = np.random.default_rng(seed).integers(1, 1 << 63, TREES * DEPTHS[-1], dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in slices(batches, 1 << 20):
            keys, sizes, draws = [], [], []
            for own in batch.column(2).to_pylist():
                draws.append(xxhash.xxh64_intdigest(own, seed) >> 1)
                least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
                s = np.frombuffer(own, np.uint64)
                for at in range(0, len(s), 512):
                    least = np.minimum(least, (s[at : at + 512, None] * odd).min(axis=0))
                key = np.arange(TREES, dtype=np.uint64)
                for i, column in enumerate(least.reshape(TREES, -1).T, 1):
                    key = mixed((key ^ (column >> np.uint64(8))) * _STEPS[i % 5])
                    if i in DEPTHS:
                        keys.append(key + np.uint64(i))
                sizes.append(len(s))
            n = TREES * len(DEPTHS)
            yield as_batch(schema, [pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.repeat(batch.column(i).to_numpy(), n)) for i in range(2)], pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(np.repeat(np.array(draws, np.int64), n))])

    return map_texts(sets.select("uid", "root", "own"), run, "key long, uid long, root long, size int, draw long")


def _unresolved(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(uid, root) of all members of the components that a candidate pair leads out of."""
    at = lambda name, c: roots.select(F.col("uid").alias(name), F.col("root").alias(c))
    across = pairs.join(at("a", "r"), "a").join(at("b", "s"), "b").where("r <> s")
    open_ = across.select(F.explode(F.array("r", "s")).alias("root")).distinct()
    return settle(roots.join(open_, "root").select("uid", "root"), "unresolved")


def _round(unresolved: DataFrame, sets: DataFrame, similarity: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(root, top): the components that the links found in one round join; and (uid, root) of the texts that may have more.

    Texts with the same sketch form a group. Its leader is the one of the least
    hash in this round; only members of another component than its own are
    compared with it. Components that meet no other one in any group, as only 8
    texts of a million with a similar one don't, are done with.
    """
    keys = settle(_deep_sketches(sets.join(unresolved, "uid"), seed), "deep")
    lead = F.min(F.struct("draw", "size", "uid", "root")).alias("lead")
    leads = keys.groupBy("key").agg(lead, F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key", "lead")
    fits = F.least("size", "lead.size") >= F.lit(similarity) * F.greatest("size", "lead.size")
    cross = keys.join(leads, "key").where(F.col("root") != F.col("lead.root"))
    cross = settle(cross.select(F.col("uid").alias("a"), F.col("lead.uid").alias("b"), F.col("root").alias("r"), F.col("lead.root").alias("s"), fits.alias("fits")).distinct(), "more-pairs")
    links = _verified(cross.where("fits").select("a", "b"), sets, similarity)
    met = cross.select(F.explode(F.array("r", "s")).alias("root")).distinct()
    top = lambda c: unresolved.select(F.col("uid").alias(c), F.col("root").alias(f"{c}_top"))
    joined = links.join(top("a"), "a").join(top("b"), "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
    return settle(components(joined).select(F.col("node").alias("root"), F.col("root").alias("top")), "tops"), unresolved.join(met, "root").select("uid", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, tk, keep_id, keep_tk) of the documents that go; tk is Spark's xxhash64 of the text.

    Documents are linked if the sets of their `width`-word shingles have a
    Jaccard similarity of `similarity` or more. Candidates are pairs of
    SimHash fingerprints within `radius` bits, found by BK-trees, and, since
    texts of similarity 0.8 differ in about nine bits, also the members of a
    band of least shingle hashes and the band's first document. Candidates are
    verified on the whole texts' shingles. Where that leaves a group of
    candidates in several components, its texts go through rounds: longer
    sketches with fresh seeds name smaller groups, whose members are compared
    with a fresh leader of another component, until a round finds no link. A
    round's pairs grow with the number of texts, whatever the groups' sizes.
    Groups are the components of all links, and the document with the smallest
    id stays (null ids last, then by text key).

    Null texts and texts without words are alike and form a group. Rows that
    repeat an id and a text are one document here. An empty table has no
    groups; columns other than id and text are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    one = _sketches(keyed, width).groupBy("doc_id", "tk").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    rows = settle(one.withColumn("uid", F.monotonically_increasing_id()), "sketches")

    banded = rows.select("uid", "doc_id", "tk", F.posexplode("bands").alias("band", "mark"))
    first = lambda: F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk", "uid"))["uid"].alias("b")  # noqa: E731  whatever the partitioning
    lead = banded.groupBy("band", "mark").agg(first(), F.count("*").alias("n")).where("n > 1").drop("n")
    by_band = banded.join(lead, ["band", "mark"]).where("uid <> b").select(F.col("uid").alias("a"), "b")
    fps = settle(rows.groupBy("fp").agg(first()), "fps")
    same = rows.join(fps, "fp").where("uid <> b").select(F.col("uid").alias("a"), "b")
    links = fingerprint_links(fps.select("fp"), radius)
    near = links.join(fps.select(F.col("fp").alias("a"), F.col("b").alias("u")), "a").join(fps.select(F.col("fp").alias("b"), F.col("b").alias("v")), "b").select("u", "v")
    pairs = settle(by_band.union(same).union(near).distinct(), "pairs")

    met = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    wanted = settle(rows.join(met, "uid").select("uid", F.col("doc_id").alias("id_"), F.col("tk").alias("tk_")), "met")
    texts = join_checked(keyed, wanted, keyed["doc_id"].eqNullSafe(F.col("id_")) & (keyed["tk"] == F.col("tk_")), "inner")
    sets = settle(_sets(texts, width), "sets")
    linked = components(_verified(pairs, sets, similarity)).withColumnRenamed("node", "uid")
    roots = settle(met.join(linked, "uid", "left").select("uid", F.coalesce("root", "uid").alias("root")), "roots")
    unresolved, seed = _unresolved(pairs, roots), 0
    while not unresolved.isEmpty():
        seed += 1
        tops, left = _round(unresolved, sets, similarity, seed)
        if tops.isEmpty():
            break
        joined = lambda df: settle(df.join(tops, "root", "left").select("uid", F.coalesce("top", "root").alias("root")), "roots")  # noqa: E731, B023
        roots, unresolved = joined(roots), joined(left)

    members = settle(rows.select("uid", "doc_id", "tk").join(roots, "uid"), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "uid")).alias("keep"))
    return members.join(first, "root").where("uid <> keep.uid").select("doc_id", "tk", F.col("keep.doc_id").alias("keep_id"), F.col("keep.tk").alias("keep_tk"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, one of each group of near-duplicates; see `near_duplicates`."""
    gone_id, gone_tk = free_name(docs, "gone_id"), free_name(docs, "gone_tk")
    gone = settle(near_duplicates(docs, id_col, text_col, **options).select(F.col("doc_id").alias(gone_id), F.col("tk").alias(gone_tk)), "gone")
    ident, key = free_name(docs, "ident"), free_name(docs, "tk")
    marked = docs.withColumns({ident: F.col(id_col).cast("long"), key: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    kept = join_checked(marked, gone, marked[ident].eqNullSafe(F.col(gone_id)) & (marked[key] == F.col(gone_tk)), "left_anti")
    repeated = marked.groupBy(ident, key).count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([ident, key]) if repeated else kept).drop(ident, key)
