"""WARC archives of pages: a writer with revisit records, and a reader that salvages what damage leaves.

The writer renders each page as a record in a gzip member of its own, gathers members up to the size of a
file and saves them through the text sink, whose line separator is the zero byte that ends a member; files appear only when their task commits. The
reader checks every record (version line, length, closing line ends, block and payload digests). After
a failed check it searches for the next gzip member or version line from which a record can be read,
goes on from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tesserae.llm._shared import Scratch, map_arrow, ship

ship(__name__)

VERSION, CLOSE = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Records and bytes of a file, at most, so that a reader's task holds files of bounded size; a larger record has a file of its own.
RECORDS_PER_FILE, FILE_BYTES = 4096, 32 << 20
_GZIP = b"\x1f\x8b\x08"
_LENGTH = re.compile("[0-9]{1,18}")
_HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)*)\r\n")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without payload; without its closing line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is zero: that of the length, or of an empty member after one of 16 MiB or more."""
    out = gzip.compress(data, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", mtime=0)
    return out[:-1]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each file in one value, without its last byte."""
    held: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], names=["value"])

    for b in batches:
        for at in range(b.num_rows):
            (r,) = b.slice(at, 1).to_pylist()
            new = member(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "replace"), r["refers_to"]) + CLOSE)
            if held and (size + len(new) > FILE_BYTES or len(held) >= RECORDS_PER_FILE):
                yield out()
                held, size = [], 0
            held.append(new)
            size += len(new) + 1
    if held:
        yield out()


def _key(html: str) -> Column:
    return F.concat(F.unhex(F.sha1(html)), F.encode(F.octet_length(html).cast("string"), "UTF-8"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record for each row of pages (page_id, url, html) to files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is
    the response and the others revisit it; rows that repeat it exactly are responses too. A null html
    is empty, a null page_id is written as such and is never referred to if another has an id. Payloads
    with equal SHA-1 and length count as equal.
    Only ids and digests are grouped; payloads join the revisits by id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = rows.where(F.octet_length("html") >= least_bytes).select("page_id", _key("html").alias("sha"))
    scratch = Scratch(pages.sparkSession, "warc-ids")
    ids = scratch.write(ids, "ids")
    last = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    last = scratch.write(last, "last")
    revisits = ids.join(last, "sha").where("not (page_id <=> refers_to)").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to").distinct()
    revisits = scratch.write(revisits, "revisits")
    rows = rows.withColumn("sha", _key("html"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")
    files = map_arrow(rows, _files, "value binary").select(F.col("value").cast("string"))  # bytes pass as they are
    files.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


# reading


def _record_at(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """(fields, block, end) of the record at an offset if all its checks hold."""
    m = _HEADER.match(data, at)
    if not m:
        return None
    fields = {}
    for line in m[1].split(b"\r\n")[:-1]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not _LENGTH.fullmatch(length) or not fields.get("warc-type"):
        return None
    end = m.end() + int(length)
    if data[end : end + 4] != CLOSE:
        return None
    block = data[m.end() : end]
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        return None
    if fields["warc-type"] == "response" and (want := fields.get("warc-payload-digest", "")).startswith("sha1:"):
        if want[5:] != digest(_payload(fields, block)[0]):
            return None
    return fields, block, end + 4


def _payload(fields: dict, block: bytes) -> tuple[bytes, int]:
    """(payload, its full length): the body of an HTTP block; a revisit has only the length."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(CLOSE)
    if fields["warc-type"] == "revisit":
        m = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", head)
        return b"", int(m[1]) if m else 0
    return body, len(body)


def _plain(data: bytes, base: int = 0) -> Iterator[tuple]:
    """("record", offset, end, fields, block) and ("gap", offset, end, None, None) of uncompressed bytes."""
    at = bad = 0
    while at < len(data):
        got = _record_at(data, at)
        if got:
            if bad < at:
                yield "gap", base + bad, base + at, None, None
            yield "record", base + at, base + got[2], got[0], got[1]
            at = bad = got[2]
        else:
            at = data.find(b"WARC/1.", at + 1)
            if at < 0:
                break
    if bad < len(data):
        yield "gap", base + bad, base + len(data), None, None


def _opened(data: bytes, at: int) -> tuple[list[tuple], int, bool]:
    """(records and gaps, end, whole) of the gzip member at an offset; of a broken one the records before the error.

    Digests do not cover the fields of a record. So if a member can be read to its end, all its records
    hold and yet its checksum fails, then some field is wrong, and none of them is given.
    """
    opened, parts, fed = zlib.decompressobj(31), [], at
    try:
        while fed < len(data) and not opened.eof:
            step = data[fed : fed + 65536]
            parts.append(opened.decompress(step))
            fed += len(step)
        return [x for x in _plain(b"".join(parts)) if opened.eof or x[0] == "record"], fed - len(opened.unused_data), opened.eof
    except zlib.error:
        pass
    unsound = False
    opened = zlib.decompressobj(31)  # a failed step gives nothing: repeat the good ones and take the last byte by byte
    for x in range(at, fed, 65536):
        opened.decompress(data[x : x + 65536])
    try:
        for fed in range(fed, len(data)):
            parts.append(opened.decompress(data[fed : fed + 1]))
    except zlib.error as e:
        unsound = "check" in str(e)
    found = list(_plain(b"".join(parts)))
    good = [x for x in found if x[0] == "record"]
    return [] if unsound and len(good) == len(found) else good, fed, False


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and gaps of a file of plain records, gzip members or both.

    Offsets of compressed records are those of the member; a member that breaks off still gives the
    records before the break, the gap begins there, and the search goes on at the next gzip member or
    version line that can be read.
    """
    at = bad = 0
    ahead = {_GZIP: -1, b"WARC/1.": -1}  # where each is found next
    while at < len(data):
        if data.startswith(_GZIP, at):
            found, end, whole = _opened(data, at)
            if bad < at and (whole or found):
                yield "gap", bad, at, None, None
            for kind, _, _, fields, block in found:
                yield kind, at, end, fields, block
            if whole or found:  # what follows a break may still hold records
                bad = end
            if whole:
                at = end
                continue
        elif got := _record_at(data, at):
            if bad < at:
                yield "gap", bad, at, None, None
            yield "record", at, got[2], got[0], got[1]
            at = bad = got[2]
            continue
        for mark, place in ahead.items():
            if place <= at:
                place = data.find(mark, at + 1)
                ahead[mark] = place if place >= 0 else len(data)
        at = min(ahead.values())
    if bad < len(data):
        yield "gap", bad, len(data), None, None


_SCHEMA = "path string, kind string, offset long, length long, warc_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            rows, path = [], path.as_py()
            for kind, start, end, fields, block in salvage(content.as_py()):
                if kind == "gap":
                    rows.append((path, kind, start, end - start, *[None] * 7))
                else:
                    payload, size = _payload(fields, block)
                    rows.append((path, kind, start, end - start, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, size, payload if with_payload else None))
                if len(rows) >= 512:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record and per quarantined gap (kind) of all files under ``path``.

    An empty file gives nothing; a file without any record is one gap. A task holds the files of one
    input partition (spark.sql.files.maxPartitionBytes) and unpacks one at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return map_arrow(files, partial(_read, with_payload=with_payload), _SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages, written and read back."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archive")
    write(pages, path, least_bytes)
    rows = read(spark, path, with_payload=False).where("kind = 'record'")
    return rows.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        F.expr("try_cast(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("refers_to"),
    )
