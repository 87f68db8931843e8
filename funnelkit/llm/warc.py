"""WARC archives: written by Spark's own committer, read by byte ranges.

Writing: every record is a gzip member of its own, built in the tasks.  Spark's
text source writes the bytes as they are and ends each row with an empty gzip
member, so that a file is an ordinary multi-member gzip stream, on any storage
that Spark writes to, and the files of a lost task never show.

Reading: a file is cut into ranges of bytes.  A task looks for the gzip magic
in its range, takes a place for a member only if it inflates to a WARC header,
reads that member to its end (past the range's end if need be) and goes on
behind it.  A record belongs to the range in which its member starts, so every
record is read once, wherever the cuts fall.  Bytes that only look like a
member (within compressed data) fail the header check or the member's checksum
and are passed over.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import scratch

#: shorter payloads are always responses
LEAST_BYTES = 100
#: bytes of an archive that a task's range holds
RANGE_BYTES = 16 << 20
#: bytes read from storage at once, and given to the inflater at once
READ_BYTES, FEED_BYTES = 1 << 20, 1 << 14

# fixed values of the gzip and WARC formats
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = MAGIC + b"\0\0\0\0\0\0\xff" + b"\x03\0" + b"\0" * 8
VERSION, CRLF = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_URN = re.compile(r"<urn:x-page:(-?\d+)?:\d+>")
#: storage that pyarrow names otherwise than Hadoop
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


# -------------------------------------------------------------------- records

def member(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member without time or name, so equal for equal records."""
    head = CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + CRLF * 2 + block + CRLF * 2) + z.flush()


def _urn(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def page_member(page_id, row, url, payload: bytes, digest: str, first, first_row, date: str) -> bytes:
    """The record of a page: a response with its payload or, where ``first_row``
    names another page's record, a revisit of that one without it."""
    same = first_row is None or first_row == row
    fields = [("WARC-Type", "response" if same else "revisit"), ("WARC-Record-ID", _urn(page_id, row)), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if not same:
        fields += [("WARC-Refers-To", _urn(first, first_row)), ("WARC-Profile", REVISIT_PROFILE)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return member([*fields, ("Content-Type", "application/http; msgtype=response")], http + (payload if same else b""))


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of the records of a member;
    ValueError where it isn't made of WARC records."""
    at = 0
    while at < len(content):
        end = content.find(CRLF * 2, at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError("no WARC header")
        fields: dict[str, str] = {}
        name = None
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and name:  # a folded line
                fields[name] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(content):
            raise ValueError("no right Content-Length")
        at = end + 4 + int(size)
        yield fields, content[end + 4 : at]
        while content.startswith(CRLF, at):
            at += 2


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The entity of an HTTP response, the whole block of anything else."""
    if fields.get("content-type", "").lower().startswith("application/http"):
        return block.partition(CRLF * 2)[2]
    return block


# ------------------------------------------------------------------ the ranges

class _Bytes:
    """Forward reads of a file with a window that is let go behind ``keep``."""

    def __init__(self, f, at: int):
        self.f, self.base, self.data, self.over = f, at, b"", False
        f.seek(at)

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def more(self) -> bool:
        got = b"" if self.over else self.f.read(READ_BYTES)
        self.over = not got
        self.data += got
        return bool(got)

    def keep(self, at: int) -> None:
        if at - self.base >= READ_BYTES:
            self.data, self.base = self.data[at - self.base :], at

    def find(self, what: bytes, at: int, stop: int) -> int:
        """First place of ``what`` in at .. stop - 1, or -1."""
        while True:
            k = self.data.find(what, max(0, at - self.base))
            if k >= 0:
                return self.base + k if self.base + k < stop else -1
            at = max(at, self.end - len(what) + 1)
            self.keep(at)
            if at >= stop or not self.more():
                return -1


def _inflate(src: _Bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the member at ``at`` if it is one of WARC records;
    zlib.error or ValueError if it isn't."""
    z, out, size = zlib.decompressobj(31), [], 0
    head = b""
    while not z.eof:
        if at >= src.end and not src.more():
            raise EOFError(bytes(b"".join(out)[:5]))
        piece = src.data[at - src.base : at - src.base + FEED_BYTES]
        got = z.decompress(piece)
        at += len(piece) - len(z.unused_data)
        if got:
            out.append(got)
            size += len(got)
            if len(head) < 5:
                head = (head + got)[:5]
                if not b"WARC/".startswith(head):
                    raise ValueError("not a WARC record")
    if not size:
        raise ValueError("an empty member")
    return b"".join(out), at


def scan(f, start: int, stop: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, problem) of the members that start in start .. stop - 1.
    A member that begins as a WARC record but ends early has no content."""
    src, at = _Bytes(f, start), start
    while (at := src.find(MAGIC, at, stop)) >= 0:
        src.keep(at)
        try:
            content, end = _inflate(src, at)
        except EOFError as e:
            if e.args[0] == b"WARC/":
                yield at, None, "the file ends within the member"
            end = at + 1
        except (zlib.error, ValueError):
            end = at + 1
        else:
            yield at, content, None
        at = end


def _open(path: str):
    from pyarrow import fs

    scheme, sep, rest = path.partition(":")
    if sep and scheme in _SCHEMES:
        path = f"{_SCHEMES[scheme]}:{rest}"
    # Spark names a local file file:/a, which is file:///a
    path = re.sub(r"^file:/+", "file:///", path)
    if path.startswith("file:///"):
        return fs.LocalFileSystem().open_input_file(unquote(path[7:]))
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


_RECORDS = ("path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, "
            "refers_to long, payload binary, problem string")


def _row(path: str, offset: int, content: bytes, payloads: bool) -> Iterator[dict]:
    for fields, block in records(content):
        kind, payload = fields.get("warc-type"), payload_of(fields, block)
        told = fields.get("warc-payload-digest", "")
        problem = None
        if kind == "revisit":
            digest, size = told.removeprefix("sha256:"), fields.get("x-payload-length", "")
            size = int(size) if size.isdigit() else None
        else:
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
            if told.startswith("sha256:") and told != f"sha256:{digest}":
                problem = "the payload is not that of its digest"
        own, other = _URN.fullmatch(fields.get("warc-record-id", "")), _URN.fullmatch(fields.get("warc-refers-to", ""))
        url = fields.get("warc-target-uri")
        yield {"path": path, "offset": offset, "record_type": kind, "page_id": int(own[1]) if own and own[1] else None,
               "url": url if url is None else unquote(url), "payload_bytes": size, "payload_digest": digest,
               "refers_to": int(other[1]) if other and other[1] else None, "payload": payload if payloads else None, "problem": problem}


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each record of the archives at ``path`` (a folder or pattern).

    Works for any WARC whose records are gzip members: several records in one
    member are all read; records without this module's fields have null page_id
    and refers_to.  A member that is cut off, or a payload that isn't that of
    its digest, shows as a row with ``problem``.  A payload that itself holds an
    archive, stored without compression, can be taken for members where a range
    starts within it.  An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    # a task for each range: as many as the bytes ask for, told by the listing
    tasks = max(1, ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
                            ("problem", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                held: list[dict] = []
                size = 0
                with _open(r["path"]) as f:
                    for offset, content, problem in scan(f, r["start"], min(r["start"] + range_bytes, r["length"])):
                        if content is None:
                            held.append({"path": r["path"], "offset": offset, "problem": problem})
                            continue
                        try:
                            held += _row(r["path"], offset, content, payloads)
                        except ValueError as e:
                            held.append({"path": r["path"], "offset": offset, "problem": str(e)})
                        size += len(content)
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    found = ranges.repartition(tasks).mapInArrow(run, _RECORDS)
    return found if payloads else found.drop("payload")


# ------------------------------------------------------------------ the writer

def write_archives(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, date: str | None = None) -> str:
    """Write a record for each row (page_id, url, html) of ``pages``.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the
    smallest page_id (nulls last; of equal ids the first row by position) is a
    response and the others revisit it.  Rows are told apart by their position,
    so ``pages`` must read the same twice, as a stored table does.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("payload"),
                        F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    large = F.octet_length("payload") >= least_bytes
    # one narrow row for each group of equal payloads; groups of one need none
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = rows.where(large).groupBy("digest").agg(F.min(order).alias("r"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select(F.col("digest").alias("key"), F.col("r.page_id").alias("first"), F.col("r.row").alias("first_row"))
    # small payloads meet nothing: keys of their own keep them from one task
    key = F.when(large, F.col("digest")).otherwise(F.col("row").cast("string").cast("binary"))
    joined = rows.withColumn("key", key).join(first, "key", "left").select("page_id", "row", "url", "payload", "digest", "first", "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, row, url, payload, digest, one, one_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(page_member(page_id, row, url, payload, digest.hex(), one, one_row, date))
                size += len(out[-1])
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    return path


def op12(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    A null html is an empty payload; empty and short payloads are responses,
    repeated or not.  Repeated rows are records of their own: of equal ids with
    equal payloads one row is the response and the others revisit that id.  A
    null page_id stays null, and so does refers_to where the response has none.
    A null url is left out of the record.  Long pages are one record each.  An
    empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    found = read_archives(spark, write_archives(pages, scratch(spark, "warc")), payloads=False)
    broken = F.raise_error(F.concat_ws(" ", F.lit("archive"), "path", F.col("offset").cast("string"), "problem")).cast("boolean")
    return found.where(F.when(F.col("problem").isNotNull(), broken).otherwise(F.lit(True))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
