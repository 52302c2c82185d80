"""Exact deduplication by composable polynomial fingerprints (operator 2)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import BROADCAST_ROWS, as_batch, free_name, join_checked, map_texts, settle, slices, utf8

#: Two primes below 2**31 and their bases: fixed values of the fingerprint.
PRIMES = ((2147483647, 1000003), (2147483629, 700001))
#: Bytes of a chunk.
CHUNK = 1 << 16
#: Members of a group that compare with one copy of its first text.
SALT_ROWS = 200

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalised(text: bytes | None) -> bytes:
    """Each run of ASCII white space is one space; null is empty."""
    return re.sub(b"  +", b" ", (text or b"").translate(_SPACES))


_known: dict[tuple[int, int], np.ndarray] = {}


def _powers(prime: int, base: int) -> np.ndarray:
    """The powers of the base for a chunk's places, the last one 1."""
    if (prime, base) in _known:
        return _known[prime, base]
    out = np.ones(CHUNK, np.uint64)
    have = 1
    while have < CHUNK:
        step = pow(base, have, prime)
        out[have : 2 * have] = out[: min(have, CHUNK - have)] * np.uint64(step) % np.uint64(prime)
        have *= 2
    _known[prime, base] = out[::-1].copy()
    return _known[prime, base]


def chunk_hash(chunk: bytes, prime: int, base: int) -> int:
    """The polynomial of one chunk of at most CHUNK bytes, each byte plus one a coefficient."""
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return int((values * _powers(prime, base)[CHUNK - len(chunk) :]).sum() % np.uint64(prime))


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of two joined parts: the left one is shifted by the length of the right one."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(text: bytes, primes=PRIMES) -> int:
    """Both polynomials of a text in one non-negative long, combined from its chunks'."""
    out = 0
    for prime, base in primes:
        whole = (0, 0)
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            whole = combine(whole, (chunk_hash(part, prime, base), len(part)), prime, base)
        out = out << 31 | whole[0]
    return out


def _prints(docs: DataFrame, primes) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("tk", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("sha", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            texts = [normalised(t) for t in utf8(batch.column(1))]
            yield as_batch(schema, [batch.column(0), batch.column(2), [fingerprint(t, primes) for t in texts], [len(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]])

    return map_texts(docs, run, "id long, tk long, fp long, size long, sha binary")


def _chunks(docs: DataFrame, primes) -> DataFrame:
    """The texts in chunks, with their fingerprints; a text without bytes has one empty chunk."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("sha", pa.binary()), ("first", pa.bool_()), ("salts", pa.int32()), ("part", pa.int64()), ("chunk", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            for i, text in enumerate(utf8(batch.column(1))):
                text = normalised(text)
                sha = hashlib.sha256(text).digest()
                if sha != batch.column(4)[i].as_py():  # another row of this id
                    continue
                own = [batch.column(0)[i].as_py(), fingerprint(text, primes), len(text), sha, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()]
                for block in range(0, max(1, len(text)), 64 * CHUNK):
                    parts = [text[at : at + CHUNK] for at in range(block, min(len(text), block + 64 * CHUNK), CHUNK)] or [b""]
                    yield as_batch(schema, [[x] * len(parts) for x in own] + [[block // CHUNK + k for k in range(len(parts))], parts])

    return map_texts(docs, run, "id long, fp long, size long, sha binary, first boolean, salts int, part long, chunk binary")


def _unlike(batches):
    """Reads chunks sorted by group, salt and place, the first text's chunk ahead; yields the texts that differ from it."""
    schema = pa.schema([("fp", pa.int64()), ("size", pa.int64()), ("sha", pa.binary())])
    key, model = None, b""
    for batch in batches:
        out: list[tuple[int, int, bytes]] = []
        rows = [c.to_pylist() for c in batch.columns]
        for fp, size, salt, part, first, sha, chunk in zip(*rows, strict=True):
            if (fp, size, salt, part) != key:
                key, model = (fp, size, salt, part), chunk if first else None
            elif not first and chunk != model:
                out.append((fp, size, sha))
        yield as_batch(schema, [[x[i] for x in out] for i in range(3)])


def _compare(docs: DataFrame, open_: DataFrame, groups: DataFrame, primes, max_rows: int) -> DataFrame:
    """(fp, size, sha) of the rows whose text is not that of their group's first row."""
    several = groups.where("n > 1")
    members = join_checked(open_, several.select("fp", "size", "lead", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), ["fp", "size"], "inner", max_rows)
    members = settle(members.select("id", "tk", "fp", "size", "sha", (F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("sha") == F.col("lead.sha"))).alias("first"), "salts").distinct(), "members")
    wanted = members.select(F.col("id").alias("id_"), F.col("tk").alias("tk_"), "fp", "size", "sha", "first", "salts")
    texts = join_checked(docs, wanted.withColumnsRenamed({c: f"{c}_" for c in ("fp", "size", "sha")}), docs["id"].eqNullSafe(F.col("id_")) & (docs["tk"] == F.col("tk_")), "inner", max_rows)
    chunks = _chunks(texts.select("id", "text", "first", "salts", "sha_"), primes)
    salt = F.when(F.col("first"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "sha"), F.col("salts")).cast("int")))
    dealt = chunks.select("fp", "size", F.explode(salt).alias("salt"), "part", "first", "sha", "chunk")
    order = ["fp", "size", "salt", "part"]
    return dealt.repartition(*order).sortWithinPartitions(*order, F.desc("first")).mapInArrow(_unlike, "fp long, size long, sha binary").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after each run of ASCII white space is
    replaced by one space; null counts as empty. Of equal texts the row with the
    smallest id stays; null ids come last. Rows that repeat an id and a text are
    in one group, and the first as the table is read stays. No column but the
    two is read, and an empty table gives an empty one.

    A text's polynomial fingerprint is put together from its chunks'. Rows of
    one fingerprint and length are then compared chunk by chunk with the
    group's first row, on as many copies of it as the group's size asks for; no
    task holds more than a chunk. Rows go back to their text by id and a hash of
    the text, so that many rows of one id don't meet each other. Rows that differ, which means a collision,
    form groups among themselves in another round.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tk", F.xxhash64(F.coalesce("text", F.lit(""))))
    open_ = settle(_prints(docs, primes).withColumn("row", F.monotonically_increasing_id()), "prints")
    done = None
    while True:
        lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "sha")).alias("lead")
        groups = settle(open_.groupBy("fp", "size").agg(F.count("*").alias("n"), lead), "groups")
        unlike = settle(_compare(docs, open_, groups, primes, max_rows), "unlike")
        more = not unlike.isEmpty()
        equal = open_.join(unlike, ["fp", "size", "sha"], "left_anti") if more else open_
        if more:
            groups = settle(equal.groupBy("fp", "size").agg(F.count("*").alias("n"), lead), "groups")
        part = join_checked(equal, groups.where("n > 1"), ["fp", "size"], "left", max_rows).select(F.col("id").alias("doc_id"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("lead.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(F.col("row") == F.col("lead.row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
        done = part if done is None else done.union(part)
        if not more:
            return done
        open_ = settle(open_.join(unlike, ["fp", "size", "sha"], "left_semi"), "prints")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see `exact_groups`.

    The rows that go are taken out by their ids. Only if ids repeat, rows go
    back to their text by id and SHA-256; of rows that repeat both, one stays.
    """
    groups = settle(exact_groups(docs, id_col, text_col, **options), "exact")
    ident, sha, gone_id, gone_sha = (free_name(docs, c) for c in ("ident", "sha", "gone_id", "gone_sha"))
    marked = docs.withColumn(ident, F.col(id_col).cast("long"))
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = settle(groups.where("not kept").select(F.col("doc_id").alias(gone_id)), "gone")
        return join_checked(marked, gone, marked[ident].eqNullSafe(F.col(gone_id)), "left_anti").drop(ident)
    plain = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    marked = marked.withColumn(sha, F.sha2(F.encode(plain, "utf-8"), 256)).dropDuplicates([ident, sha])
    kept = F.max("kept").alias("kept")
    gone = groups.groupBy("doc_id", "text_sha256").agg(kept).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    return join_checked(marked, settle(gone, "gone"), marked[ident].eqNullSafe(F.col(gone_id)) & (marked[sha] == F.col(gone_sha)), "left_anti").drop(ident, sha)
