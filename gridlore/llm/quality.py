"""Quality selection by importance resampling of hashed n-grams (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import BROADCAST_ROWS, as_batch, byte_table, join_checked, map_texts, mixed, settle, slices, span_hashes, utf8
from gridlore.llm.mixing import uniform

#: Words are runs of anything but ASCII white space, case and marks included, since those tell junk from prose.
WORDS = byte_table(bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"), lower=False)
#: What is added to a bucket's counts: words, and pairs of words, which are sparser.
SMOOTHING = (5.0, 50.0)


def features(text: bytes | None, buckets: int) -> np.ndarray:
    """Bucket numbers, as often as they occur, of a whole text's words (below `buckets`) and pairs of neighbouring words (from `buckets` on)."""
    out, carry = [], np.zeros(0, np.uint64)
    for part in _pieces(text or b""):
        values = np.frombuffer(part, np.uint8)
        word = np.concatenate([[False], values != 32, [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            continue
        words = span_hashes(values, start, stop)
        chain = np.concatenate([carry, words])
        pairs = mixed(chain[:-1] * np.uint64(3) + chain[1:])
        out += [(words % np.uint64(buckets)).astype(np.int64), (pairs % np.uint64(buckets)).astype(np.int64) + buckets]
        carry = words[-1:]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pieces(text: bytes, size: int = 1 << 20):
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        part = text[at:end].translate(WORDS)
        while end < len(text) and part[-1] != 32:
            more = text[end : end + 4096].translate(WORDS)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        at = end
        yield part


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(side, bucket, n): how often a bucket occurs on each side, over all of `docs` (text, side).

    Counts are summed in each task, then by bucket.
    """
    schema = pa.schema([("side", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros((2, 2 * buckets), np.int64)
        for batch in slices(batches):
            found: tuple[list, list] = ([], [])
            for text, side in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[side].append(features(text, buckets))
            for side in (0, 1):
                if found[side]:
                    total[side] += np.bincount(np.concatenate(found[side]), minlength=2 * buckets)
        side, bucket = np.nonzero(total)
        for at in range(0, len(side), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield as_batch(schema, [pa.array(side[part], pa.int32()), pa.array(bucket[part], pa.int32()), pa.array(total[side[part], bucket[part]])])

    return map_texts(docs.select("text", "side"), run, "side int, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(counts: np.ndarray, smoothing: tuple[float, float] = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) of each bucket from its occurrences, the first half of words, the second of pairs.

    `counts` has a row for the target and one for the raw side, which holds the
    target too. Both models are multinomials whose counts have `smoothing`
    added, on the target's scale; so each bucket counts, and the ratio of rare
    ones is drawn towards 0 by degrees. Without a target all ratios are 0.
    """
    out = []
    for (target, raw), add in zip(np.split(counts.astype(float), 2, axis=1), smoothing, strict=True):
        want = raw * (target.sum() / max(raw.sum(), 1.0))
        out.append(np.log((target + add) / (want + add)) if target.any() else np.zeros(len(raw)))
    return np.concatenate(out)


def _fit(rows: DataFrame, labels: DataFrame, target_rows: int, buckets: int) -> tuple[np.ndarray, float]:
    """The ratios and the share of good rows among the labelled."""
    one = labels.select(F.col("doc_id").cast("long").alias("label_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).where("label_id is not null and good is not null")
    one = settle(one.groupBy("label_id").agg(F.min("good").alias("good")), "labels")
    n, good = one.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    sample = one.where("good")
    if good > target_rows:
        bound = int(2**64 * (target_rows / good)) - 2**63
        sample = sample.where(F.xxhash64("label_id") <= bound)
    marked = join_checked(rows, settle(sample.select("label_id"), "target"), rows["id"] == F.col("label_id"), "left", max(BROADCAST_ROWS, 2 * target_rows))
    found = bucket_counts(marked.select("text", F.col("label_id").isNotNull().cast("int").alias("side")), buckets).toArrow()
    table = np.zeros((2, 2 * buckets), np.int64)
    table[found["side"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return log_ratios(np.stack([table[1], table.sum(axis=0)])), good / n if n else 1.0


def _threshold(scored: DataFrame, keep: int) -> float:
    """The keep-th greatest sort_key, exactly: counts of 65,536 equal steps between the least and the greatest key, again within the step that holds it.

    Steps keep the order, so the keys of a step are those between its own least
    and greatest; a step with one value ends it.
    """
    key = F.col("sort_key")
    lo, hi = scored.agg(F.min(key), F.max(key)).first()
    while lo < hi:
        step = F.floor((key - lo) / (hi - lo) * 65535)
        for _, n, least, most in sorted(map(tuple, scored.where(key.between(lo, hi)).groupBy(step.alias("p")).agg(F.count("*"), F.min(key), F.max(key)).collect()), reverse=True):
            if keep <= n:
                lo, hi = least, most
                break
            keep -= n
    return lo


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, seed: int = 42, buckets: int = 1 << 18, target_rows: int = 100_000) -> DataFrame:
    """doc_id, log_weight, sort_key, selected of every row of `docs`: Gumbel top-k by importance weight.

    log_weight is the log ratio of two generative models of hashed words and
    word pairs at the whole text: target, fitted on the documents whose label
    says quality 1 and not toxic (`labels`: doc_id, quality, toxic), and raw,
    fitted on all documents. Models hold the smoothed share of each bucket in
    all occurrences, `buckets` for words and as many for pairs. sort_key adds a Gumbel variable hashed from seed and id; the
    `share` of the rows with the greatest keys is selected, which draws without
    replacement in proportion to the weights. Without a share, it is that of
    the target among the labelled rows.

    The target is fitted on a sample of about `target_rows` labelled rows,
    chosen by hash, if there are more. Equal keys at the last place are all
    selected. A text of any length has a finite weight. Null and empty texts have weight 0 before noise; null ids draw
    one number, and so do rows that repeat an id, each of which comes out; an
    id that has several labels counts by the worst. Without labels all weights
    are 0 and all rows are selected. An empty table gives an empty one; columns
    other than id and text are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ratios, good = _fit(rows, labels, target_rows, buckets)
    share = good if share is None else share
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64())])

    def run(batches):
        ratio = shared.value
        for batch in slices(batches):
            yield as_batch(schema, [batch.column(0), [float(ratio[features(t, buckets)].sum(dtype=np.float64)) for t in utf8(batch.column(1))]])

    u = uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) + F.lit(2.0**-53)
    weighed = map_texts(rows, run, "doc_id long, log_weight double").withColumn("sort_key", F.col("log_weight") - F.log(-F.log(u)))
    weighed = settle(weighed, "weights")
    keep = round(weighed.count() * share)
    chosen = F.col("sort_key") >= _threshold(weighed, keep) if keep else F.lit(False)
    return weighed.select("doc_id", "log_weight", "sort_key", chosen.alias("selected"))
