"""WARC archives: a writer with revisit records and a salvage reader (operator 6)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm._common import BROADCAST_ROWS, as_batch, join_checked, map_texts, settle, shared_dir, slices, utf8

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: A version line, or the head of a gzip member with no reserved flag.
_EITHER = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08[\x00-\x1f]")
#: Bytes of an archive; Spark reads archives whole.
ARCHIVE_BYTES = 16 << 20
#: Bytes that are unzipped at once.
STEP = 1 << 14


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8: eight groups of 20 bits are four letters each."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        value = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\\r\\n]", " ")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, max_rows: int = BROADCAST_ROWS) -> None:
    """Write a record for each row of `pages` to WARC/1.1 files in the new folder `path`, a gzip member each.

    The payload is the html in UTF-8, null as empty. Of records with equal
    payloads of `min_bytes` or more, those with the smallest id are response
    records, and the others are revisit records without payload that refer to
    it; smaller payloads are all response records. Rows that repeat the
    smallest id are all responses. A null id comes after all others. An empty
    table gives no records; other columns are not read.

    An archive is closed when it has `archive_bytes` zipped bytes or more,
    which bounds what a reader holds, but for one long record. It goes through
    Spark's text writer as one row, whose line end is a zero byte, padding that
    gzip readers pass over.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), _one_line(F.col(url_col)).alias("url"), payload.alias("payload"))
    keyed = rows.select("*", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"), F.sha2(F.encode("payload", "utf-8"), 256).alias("key"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n"))
    several = settle(groups.where("n > 1").select("key", "lead"), "payloads")
    led = join_checked(keyed, several, "key", "left", max_rows)
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    again = F.coalesce(F.col("lead").isNotNull() & ~F.col("lead").eqNullSafe(F.col("id")), F.lit(False))
    header = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    common = F.concat(header("WARC-Record-ID", name(F.col("id"))), header("WARC-Target-URI", F.col("url")), F.lit(f"WARC-Date: {date}\r\n"), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))
    response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), common, F.lit("Content-Type: text/html; charset=utf-8\r\n"), header("Content-Length", F.col("size").cast("string")), F.lit("\r\n"), F.col("payload"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    revisit = F.concat(F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n"), common, header("WARC-Refers-To", name(F.col("lead"))), F.lit(f"WARC-Profile: {profile}\r\nContent-Length: 0\r\n\r\n"))
    record = F.when(again, revisit).otherwise(response)
    archives = map_texts(led.select(record.alias("record")), _zipped(archive_bytes), "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _zipped(archive_bytes: int):
    """Records, each zipped as a member of its own, in archives."""
    schema = pa.schema([("archive", pa.binary())])

    def run(batches):
        held, size = [], 0
        for batch in slices(batches):
            for record in utf8(batch.column(0)):
                member = gzip.compress(record + b"\r\n\r\n", 3, mtime=0)
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield as_batch(schema, [[b"".join(held)]])
                    held, size = [], 0
        if held:
            yield as_batch(schema, [[b"".join(held)]])

    return run


@dataclass
class Found:
    """A record, or a gap: bytes that could not be read, with the reason."""

    kind: str
    start: int  # bytes of the file; of a record in a member, the member's
    stop: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    reason: str = ""
    inner: tuple[int, int] | None = None  # bytes of the unzipped member


def _record(data: bytes, at: int) -> tuple[Found, str]:
    """The record at a version line; the second is what fails, if any."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return Found("record", at, at), "header has no end"
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = headers.get("content-length", "")
    if not length.isdigit():
        return Found("record", at, at), "no content length"
    stop = head + 4 + int(length)
    payload = data[head + 4 : stop]
    if len(payload) < int(length) or data[stop : stop + 4] != b"\r\n\r\n":
        return Found("record", at, at), "content is not as long as its length says"
    name, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if headers.get("warc-type") != "revisit" and name == "sha1" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest.upper():
        return Found("record", at, at), "digest differs"
    return Found("record", at, stop + 4, headers, payload), ""


def _records(data: bytes) -> Iterator[Found]:
    """All records of plain bytes; after a failed check the next version line is searched for."""
    at, gap, why = 0, None, ""
    while at < len(data):
        failed = "no version line"
        if _LINE.match(data, at):
            found, failed = _record(data, at)
            if not failed:
                if gap is not None:
                    yield Found("gap", gap, at, reason=why)
                    gap = None
                yield found
                at = found.stop
                continue
        if gap is None:
            gap, why = at, failed
        following = _LINE.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield Found("gap", gap, len(data), reason=why)


def _unzip(data: bytes, at: int) -> tuple[bytes, int, str, list[tuple[int, int]]]:
    """The plain bytes of the member at `at`, up to an error if there is one, where it ends, the error, and marks of plain bytes and bytes of the file."""
    unzip, out, pos, marks = zlib.decompressobj(31), bytearray(), at, [(0, at)]
    while pos < len(data) and not unzip.eof:
        chunk, before = data[pos : pos + STEP], unzip.copy()
        try:
            out += unzip.decompress(chunk)
        except zlib.error as e:
            for i in range(len(chunk)):  # the bytes before the error, one by one
                try:
                    out += before.decompress(chunk[i : i + 1])
                except zlib.error:
                    return bytes(out), pos + i, f"gzip: {e}", [*marks, (len(out), pos + i)]
        pos += len(chunk)
        marks.append((len(out), pos))
    stop = pos - len(unzip.unused_data)
    return bytes(out), stop, "" if unzip.eof else "gzip member has no end", [*marks[:-1], (len(out), stop)]


def _starts_member(data: bytes, at: int) -> bool:
    """Whether a gzip member that holds a WARC record begins here."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 512], 5) == b"WARC/"
    except zlib.error:
        return False


def _next_start(data: bytes, at: int) -> int:
    """The next version line or member of records, or the end."""
    for found in _EITHER.finditer(data, at):
        if found.group()[:1] == b"W" or _starts_member(data, found.start()):
            return found.start()
    return len(data)


def read_records(data: bytes) -> Iterator[Found]:
    """All records and gaps of an archive, whose records are plain, or gzipped in members of one or of many.

    What is at hand is told from the bytes at each step. After a failed check
    the next version line or valid member is searched for from inside what
    failed. All that a broken member gives before its error is kept; its gap
    begins where the bytes of its last good record end, to STEP bytes.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        failed, bad = "neither a member nor a version line", at
        if data[at] == 0 and gap is None:  # padding
            at += len(data) - at - len(data[at:].lstrip(b"\0"))
            continue
        if data[at : at + 3] == b"\x1f\x8b\x08":
            plain, stop, failed, marks = _unzip(data, at)
            place = lambda x, up: next(f for p, f in marks if p >= x) if up else next(f for p, f in reversed(marks) if p <= x)  # noqa: E731, B023
            found = list(_records(plain))
            if any(x.kind == "record" for x in found):
                if gap is not None:
                    yield Found("gap", gap, at, reason=why)
                    gap = None
                good = max(i for i, x in enumerate(found) if x.kind == "record")
                for x in found[: good + 1] if failed else found:
                    inner = (x.start, x.stop)
                    start, stop_ = (at, stop) if x.kind == "record" else (place(x.start, False), place(x.stop, True))
                    yield Found(x.kind, start, stop_, x.headers, x.payload, x.reason, inner)
                bad = place(found[good].stop, False)
            elif found and not failed:
                failed = found[0].reason
            if not failed:
                at = stop
                continue
        elif _LINE.match(data, at):
            record, failed = _record(data, at)
            if not failed:
                if gap is not None:
                    yield Found("gap", gap, at, reason=why)
                    gap = None
                yield record
                at = record.stop
                continue
        if gap is None:
            gap, why = bad, failed
        at = _next_start(data, max(at + 1, bad))
    if gap is not None and gap < len(data):
        yield Found("gap", gap, len(data), reason=why)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives under `path`.

    Columns: archive, kind (record or gap), start and stop (bytes of the file;
    of a record in a gzip member, the member's), inner_start and inner_stop
    (bytes of the unzipped member; null outside of members and for what could
    not be unzipped), reason (of a gap), headers (a map, names in lower case),
    payload_bytes, payload_digest (of the bytes read; of a revisit, what its
    header says), and payload if asked for. Files come through Spark's reader,
    whole; a task has as many as spark.sql.files.maxPartitionBytes lets it. An
    empty file has no rows, a folder without archives gives an empty table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]*").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    schema = pa.schema([("archive", pa.string()), ("kind", pa.string()), *[(n, pa.int64()) for n in ("start", "stop", "inner_start", "inner_stop")], ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payload else [])])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive, held = batch.column(0)[i].as_py(), []
                for x in read_records(batch.column(1)[i].as_py()):
                    whole = x.kind == "record"
                    digest = (x.headers.get("warc-payload-digest", "").partition(":")[2] if x.headers.get("warc-type") == "revisit" else base64.b32encode(hashlib.sha1(x.payload).digest()).decode()) if whole else None
                    held.append((archive, x.kind, x.start, x.stop, *(x.inner or (None, None)), x.reason or None, list(x.headers.items()), len(x.payload) if whole else None, digest, *([x.payload] if payload else [])))
                    if len(held) >= 1000:
                        yield as_batch(schema, [[h[k] for h in held] for k in range(len(schema))])
                        held = []
                yield as_batch(schema, [[h[k] for h in held] for k in range(len(schema))])

    kinds = "archive string, kind string, start long, stop long, inner_start long, inner_stop long, reason string, headers map<string,string>, payload_bytes long, payload_digest string"
    return map_texts(files, run, kinds + (", payload binary" if payload else ""))


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives' pages.

    A revisit takes its payload's length from the response it refers to, null
    if that was not read. Gaps are passed over; an empty table gives an empty
    one.
    """
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    at = lambda k: F.try_element_at("headers", F.lit(k))
    rows = records.where("kind = 'record'").select(at("warc-record-id").alias("name"), at("warc-type").alias("record_type"), at("warc-refers-to").alias("refers"), "payload_bytes", "payload_digest")
    rows = settle(rows, "records")
    leads = rows.where("record_type = 'response'").groupBy("name").agg(F.max("payload_bytes").alias("full"))
    wanted = rows.where("refers is not null").select("refers").distinct().withColumnRenamed("refers", "name")
    leads = settle(leads.join(wanted, "name", "left_semi").withColumnRenamed("name", "lead"), "leads")
    out = join_checked(rows, leads, rows["refers"] == F.col("lead"), "left")
    size = F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("payload_bytes"))
    return out.select(page(F.col("name")).alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", page(F.col("refers")).alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write `pages` as WARC files, to a new shared folder unless `path` is given, read them back and resolve them; awkward rows are as in `write_warc`."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/gridlore/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    return resolve(read_warc(spark, path))
