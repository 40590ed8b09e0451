"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged files.

Writer. Each row becomes one record in a gzip member of its own. Of rows with equal payloads of at least ``min_bytes``
bytes the one with the largest id is written as a response and the others as revisits of it; smaller ones are all
responses. Files are written by Spark's text writer, whose line separator is the zero byte that ends a gzip member of
less than 16 MiB (a larger one is followed by an empty member, which ends so), hence under Spark's commit protocol and
on any store that Spark can write to.

Reader. It walks a file from record to record, compressed members and plain records alike, and checks each: the member's
own checksum, the version line, the header, the block's length, and the block and payload digests where they are given.
After a check fails it searches for the next gzip magic or version line at which a whole record passes, goes on from
there, and logs the bytes between as a quarantined gap with the reason. Inside a member the same is done with the
inflated bytes, so a member of many records loses the damaged ones only; of a member whose checksum fails, or that does
not inflate to its end, those records stay that a digest of their own confirms. Members are inflated in slices: time
follows the length of a file, and beside the file (2 GB at most, what Spark hands over as one value) a task holds the
record at hand.

Defined cases: a null payload is an empty one; a null URL is left out of the header; a null id is written without an id,
and a group of equal payloads whose ids are all null consists of responses; rows that repeat the largest id are all
responses; an empty table gives an archive without records; other columns are ignored; a file without any valid record
is one gap; a payload of any length is one record, and a file ends after ``records_per_file`` of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r?\n")
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2000-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20
#: Bytes inflated at a time, bytes up to which an inflated member is kept for reading, and bytes in which a header ends.
SLICE, KEEP, HEADER = 1 << 18, 1 << 22, 1 << 20
SCHEMA = "kind string, path string, start long, end long, inner long, reason string, record_type string, headers map<string,string>, payload binary"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(row_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{row_id}|{url}' if row_id is None else str(row_id))}>"


def build_record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One plain record: a response with the payload, or a revisit that names the response and has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(row_id, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row_id is not None:
        head.append(f"X-Row-ID: {row_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, None)}", f"X-Refers-To-Row: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose last byte is zero."""
    out = gzip.compress(record, level, mtime=0)
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write(rows: DataFrame, path: str, *, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0, level: int = 6, records_per_file: int = 20_000) -> None:
    """Writes one record for every row under path."""
    pages = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    # Counts and maxima are combined before the shuffle, so a payload that a third of the rows share is one row of each
    # task here; the join after it splits such a key by Spark's skew handling.
    groups = pages.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 AND kept IS NOT NULL").select("sha1", "kept")
    pages = pages.join(groups, "sha1", "left").select("id", "url", F.when(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"), "payload")

    def members(batches):
        for batch in batches:
            held, size = [], 0
            for row_id, url, refers_to, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(member(build_record(row_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()), level)[:-1])
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    pages.mapInArrow(members, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


class Damaged(ValueError):
    """Why the bytes at a position are no valid record, and the place in the file of what is damaged in a member."""

    def __init__(self, reason: str, place: int = 0):
        super().__init__(reason)
        self.place = place


class Window:
    """Bytes that come in parts; what was read and is not needed again is forgotten."""

    def __init__(self, parts, held: bytes = b""):
        self.parts, self.held, self.base = iter(parts), held, 0

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        if not self.held:
            self.held = part
        else:
            if isinstance(self.held, bytes):
                self.held = bytearray(self.held)
            self.held += part
        return True

    def reaches(self, end: int) -> bool:
        while self.base + len(self.held) < end:
            if not self.more():
                return False
        return True

    def take(self, begin: int, end: int) -> bytes:
        self.reaches(end)
        return bytes(self.held[begin - self.base : end - self.base])

    def find(self, what: bytes, begin: int, limit: int | None = None) -> int:
        """Place of the next occurrence that begins before begin + limit; -1 if there is none."""
        at = begin
        while True:
            found = self.held.find(what, max(0, at - self.base))
            if found >= 0:
                return self.base + found if limit is None or self.base + found < begin + limit else -1
            at = max(at, self.base + len(self.held) - len(what) + 1)
            if (limit is not None and at > begin + limit) or not self.more():
                return -1

    def forget(self, before: int) -> None:
        if isinstance(self.held, bytearray) and before - self.base > SLICE:
            del self.held[: before - self.base]
            self.base = before


def parse(window: Window, at: int) -> tuple[int, dict[str, str], bytes, bool]:
    """End, header and block of the record at a position, and whether a digest confirms it."""
    if not VERSION.match(window.take(at, at + 10)):
        raise Damaged("no version line")
    stop = window.find(b"\r\n\r\n", at, HEADER)
    if stop < 0:
        raise Damaged("header has no end")
    headers: dict[str, str] = {}
    for line in window.take(at, stop).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("malformed header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers:
        raise Damaged("header lacks a length or a type")
    begin = stop + 4
    end = begin + int(length)
    if not window.reaches(end + 4) or window.take(end, end + 4) != b"\r\n\r\n":
        raise Damaged("block does not end where the header says")
    block, proven = window.take(begin, end), False
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:"):
        if want[5:] != digest(block):
            raise Damaged("block digest differs")
        proven = True
    want = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and want.startswith("sha1:"):
        if want[5:] != digest(payload_of(headers, block)):
            raise Damaged("payload digest differs")
    return end + 4, headers, block, proven


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header of a response; any other block as a whole."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def inflated(data: bytes, start: int):
    """The inflated slices of the gzip member at a position; returns its end, raises Damaged where it does not hold."""
    inflate, view, at, size = zlib.decompressobj(31), memoryview(data), start, 0
    while not inflate.eof:
        raw = inflate.unconsumed_tail
        if not raw:
            raw = view[at : at + SLICE]
            if not len(raw):
                raise Damaged("member is cut short", at)
            at += len(raw)
        try:
            out = inflate.decompress(raw, SLICE)
        except zlib.error as e:
            at, rest = to_fault(view, start, at, size)
            if rest:
                yield rest
            raise Damaged(f"member does not inflate: {str(e)[:60]}", at) from e
        size += len(out)
        if out:
            yield out
    return at - len(inflate.unused_data)


def to_fault(view: memoryview, start: int, stop: int, size: int) -> tuple[int, bytes]:
    """Where a member that fails before stop does so, and what inflates before that beyond the first size bytes."""
    inflate, at, rest = zlib.decompressobj(31), start, bytearray()
    step = SLICE
    while at < stop:
        spare = inflate.copy()
        try:
            out = inflate.decompress(view[at : min(stop, at + step)])
        except zlib.error:
            if step == 1:
                break
            inflate, step = spare, max(1, step // 64)
            continue
        rest += out[max(0, size) :] if size > 0 else out
        size -= len(out)
        at += step
    return min(at, stop), bytes(rest)


def survey(data: bytes, at: int) -> tuple[int | None, str | None, list[bytes] | None, int]:
    """End of the member at a position or None and why, its inflated parts if they are small enough to keep, and the place
    of the damage."""
    parts, size, slices = [], 0, inflated(data, at)
    while True:
        try:
            part = next(slices)
        except StopIteration as end:
            return end.value, None, parts, end.value
        except Damaged as e:
            return None, str(e), parts, e.place
        size += len(part)
        if parts is not None:
            parts.append(part)
        if size > KEEP:
            parts = None


def again(data: bytes, at: int):
    """The inflated parts of a member up to its damage, if it has any."""
    try:
        yield from inflated(data, at)
    except Damaged:
        return


def walk(window: Window, trusted: bool):
    """Records and gaps of a member's inflated bytes: (kind, begin, end, header or reason, block)."""

    def good(at: int):
        end, headers, block, proven = parse(window, at)
        if not (trusted or proven):
            raise Damaged("no digest confirms it in a damaged member")
        return end, headers, block

    at = 0
    while window.reaches(at + 1):
        try:
            end, headers, block = good(at)
        except Damaged as e:
            start, reason = at, str(e)
            while (at := window.find(b"WARC/1.", at + 1)) >= 0:
                try:
                    good(at)
                    break
                except Damaged:
                    window.forget(at)
            else:
                at = window.base + len(window.held)
            yield "gap", start, at, reason, b""
            continue
        yield "record", at, end, headers, block
        window.forget(end)
        at = end


def look(data: bytes, at: int):
    """What is at a position of a file: (end, reason, events, whether there is a record, the place of the damage). The end
    is None for a damaged member; events are as in walk, of a plain record one with the places None."""
    if data[at : at + 3] != MAGIC:
        end, headers, block, _ = parse(Window((), data), at)
        return end, None, iter([("record", None, None, headers, block)]), True, end
    end, reason, parts, place = survey(data, at)
    events = walk(Window(parts if parts is not None else again(data, at)), end is not None)
    head = []
    for event in events:
        head.append(event)
        if event[0] == "record":
            return end, reason, chain(head, events), True, place
    return end, reason, iter(head), False, place


CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")


def salvage(data: bytes):
    """("record", start, end, headers, block, inner) and ("gap", start, end, reason, b"", inner), in order; the spans of the
    file cover all its bytes. Inner is the place in the inflated bytes of a member, None outside of members: records and
    gaps of one member share its span."""
    at = 0
    while at < len(data):
        try:
            end, reason, events, any_record, place = look(data, at)
        except Damaged as e:
            end, reason, events, any_record, place = None, str(e), iter(()), False, at
        stop = end
        if stop is None:
            stop = len(data)
            for m in CANDIDATE.finditer(data, at + 1):
                if any_record and m.start() < place and m[0] != MAGIC:
                    continue  # a version line that was met inside the member, which only stored it
                try:
                    if look(data, m.start())[3]:
                        stop = m.start()
                        break
                except Damaged:
                    continue
        if not any_record and end is None:
            yield "gap", at, stop, reason, b"", None
        else:
            last = 0
            for kind, begin, inner_end, what, block in events:
                if kind == "record":
                    last = inner_end
                if end is not None or kind == "record" or inner_end is None:
                    yield kind, at, stop, what, block, begin
            if end is None:
                yield "gap", at, stop, reason, b"", last
        at = stop


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all files under path (see SCHEMA; kind tells them apart, header names are in lower case)."""

    def parsed(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, start, end, what, block, inner in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((kind, name, start, end, inner, what, None, None, None))
                    else:
                        rows.append((kind, name, start, end, inner, None, what["warc-type"], list(what.items()), payload_of(what, block)))
                        size += len(block)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(parsed, SCHEMA)


TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
NAMES = ("kind", "path", "start", "end", "inner", "reason", "record_type", "headers", "payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=list(NAMES))


def pages(records: DataFrame) -> DataFrame:
    """What the archive says about each row that was written: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Lengths and digests of responses are those of the payloads found; revisits carry them in the header."""
    h = F.col("headers")
    response = F.col("record_type") == "response"
    return records.where("kind = 'record'").select(
        h["x-row-id"].cast("long").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(h["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.substring(h["warc-payload-digest"], 6, 32).alias("payload_digest"),
        "record_type",
        h["x-refers-to-row"].cast("long").alias("refers_to"),
    )
