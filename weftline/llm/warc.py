"""WARC archives: one gzip member per record, read back sequentially.

Writing: rows meet the first row of their payload by its SHA-256; the row with the smallest page_id becomes a response with the payload,
later equal payloads of LEAST_REVISIT bytes or more become revisits that hold the HTTP header only and refer to that response. Each task
writes archives of up to ARCHIVE_BYTES to the shared folder under names of its own attempt; only archives of a manifest that Spark has
committed are read, so a lost executor's half archives do no harm.

Reading: one archive at a time and CHUNK bytes at a time. Each gzip member is decompressed incrementally, its WARC header gives the length of
its block, the block's HTTP header ends the front part, and the payload is hashed as it goes by; it is gathered only if asked for. A record that
breaks the format is a row with its `error` (and fails the query under strict=True): gzip (damaged or cut off; what follows in that
archive cannot be found), header, length, ending, block_digest or payload_digest. Archives of other writers may hold other records
(warcinfo, request, metadata, ...), which are rows without an id.

Defined results: a null html counts as empty. A null url leaves out WARC-Target-URI and is null again; white space, control characters and
`%` of an url are written percent-encoded and decoded on reading. Of rows that repeat page_id and payload one is the
response; a null page_id comes last. A payload of any length is one record; writing takes it whole, reading does not. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ._shared import slices, stored, table

#: Equal payloads under this many bytes are all responses.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
#: Bytes that the headers of a record may take.
HEADER_BYTES = 1 << 20
#: Written as WARC-Date of every record, so that reruns agree.
DATE = "2000-01-01T00:00:00Z"
#: Own header fields, which the format allows.
KEY = "X-Row-Id"
_QUOTED = re.compile(r"[\x00-\x20%\x7f-\x9f]")


def response_id(digest: str) -> str:
    """The record that revisits of this payload refer to."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(digest.encode()).digest()[:16], version=4)}>"


def member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return out.compress(text.encode()) + out.compress(block) + out.compress(b"\r\n\r\n") + out.flush()


def _page_member(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", response_id(row["digest"]) if row["role"] == "first" else f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["page_id"] is not None:
        fields.append((KEY, str(row["page_id"])))
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"])))
    if row["role"] != "again":
        return member("response", fields, http + row["payload"])
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", response_id(row["digest"]))]
    return member("revisit", fields, http)


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done, out, n, size = [], None, 0, 0

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for part in slices([batch], "payload"):
                for row in part.to_pylist():
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                        out, n, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                        out.write(first := member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"software: weftline\r\nformat: WARC File Format 1.1\r\n"))
                        size += len(first)
                    out.write(data := _page_member(row))
                    n, size = n + 1, size + len(data)
                    if size >= most:
                        close()
                        out = None
        if out is not None:
            close()
        columns = zip(*done, strict=True) if done else [()] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, *, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row; archive, records and bytes of each archive. folder: an URI that all executors reach; unset, one in the shared folder."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    none = F.col("page_id").isNull().alias("none")
    by_id = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    leads = stored(by_id.groupBy("digest").agg(F.min(F.struct(none, "page_id", "n")).alias("least"), F.sum("n").alias("n")).where("n > 1").select("digest", F.col("least.page_id").alias("lead_id"), F.col("least.n").alias("n")), "leads")
    if leads.where("n > 1").isEmpty():
        first = F.col("page_id").eqNullSafe(F.col("lead_id"))
    else:  # rows repeat with their page_id: they are told apart by a number, which holds only in a stored table
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        leads = rows.join(leads, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(none, "page_id", "row")).alias("least")).select("digest", F.col("least.row").alias("lead_row"), F.lit(2).alias("n"))
        first = F.col("row") == F.col("lead_row")
    role = F.when(F.col("n").isNull(), "only").when(first, "first").otherwise("again")
    found = rows.join(leads, "digest", "left").select("page_id", "url", "payload", "digest", "size", role.alias("role"))
    return stored(found.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "archives")


class Broken(Exception):
    """A record that breaks the format; the message is its kind."""


class _Member:
    """The decompressed bytes of one gzip member, a bounded piece at a time."""

    def __init__(self, source: _Source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), b""

    def piece(self) -> bytes:
        """Up to CHUNK further bytes; none at the member's end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.source.read()
            if not data:
                raise Broken("gzip")
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error:
                raise Broken("gzip") from None
            if self.inflate.eof:
                self.source.back(self.inflate.unused_data)
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes before `mark`, which are within the next `most`; what follows stays."""
        got = bytearray()
        while (at := got.find(mark)) < 0:
            if len(got) > most or not (more := self.piece()):
                raise Broken("header")
            got += more
        self.held = bytes(got[at + len(mark) :]) + self.held
        return bytes(got[:at])

    def some(self, most: int) -> bytes:
        """At least one and up to `most` bytes; none at the end."""
        out = self.piece()
        if len(out) > most:
            out, self.held = out[:most], out[most:]
        return out


class _Source:
    def __init__(self, stream):
        self.stream, self.rest, self.at = stream, b"", 0

    def read(self) -> bytes:
        out, self.rest = (self.rest, b"") if self.rest else (self.stream.read(CHUNK), b"")
        self.at += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.rest = data
        self.at -= len(data)


def _fields(head: bytes, first: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(first):
        raise Broken("header")
    out: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # goes on from the line before
            out[name] += " " + line.strip().decode(errors="replace")
            continue
        name, colon, value = line.decode(errors="replace").partition(":")
        if not colon:
            raise Broken("header")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _number(text: str | None) -> int:
    if not text or not text.isascii() or not text.isdigit():
        raise Broken("header")
    return int(text)


def _record(part: _Member, gather: bool) -> dict:
    fields = _fields(part.until(b"\r\n\r\n", HEADER_BYTES), b"WARC/1.")
    left = length = _number(fields.get("content-length"))
    kind, out = fields.get("warc-type", "").lower(), {}
    whole, payload, kept, size = hashlib.sha256(), hashlib.sha256(), [], 0
    http: dict[str, str] = {}
    if fields.get("content-type", "").startswith("application/http"):
        front = part.until(b"\r\n\r\n", min(length, HEADER_BYTES)) + b"\r\n\r\n"
        left -= len(front)
        if left < 0:
            raise Broken("length")
        whole.update(front)
        http = _fields(front[:-4], b"HTTP/")
    while left:
        data = part.some(left)
        if not data:
            raise Broken("length")
        left -= len(data)
        size += len(data)
        whole.update(data)
        payload.update(data)
        if gather:
            kept.append(data)
    tail = b""
    while data := part.piece():
        tail += data
        if len(tail) > 4:
            raise Broken("length")
    if tail != b"\r\n\r\n":
        raise Broken("ending")
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:].lower() != whole.hexdigest():
        raise Broken("block_digest")
    said = fields.get("warc-payload-digest", "")
    revisit = kind == "revisit"
    if not revisit and said.startswith("sha256:") and said[7:].lower() != payload.hexdigest():
        raise Broken("payload_digest")
    uri = fields.get("warc-target-uri")
    key = fields.get(KEY.lower())
    out |= {"record_id": fields.get("warc-record-id"), "record_type": kind, "page_id": None if key is None else int(key), "refers_to_id": fields.get("warc-refers-to")}
    out |= {"url": None if uri is None else re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), uri.encode()).decode(errors="replace")}
    # A revisit's payload is its response's: the HTTP header says its length, the WARC header its digest.
    out |= {"payload_bytes": _number(http.get("content-length")) if revisit else size, "payload_digest": said.rpartition(":")[2].lower() if revisit else payload.hexdigest()}
    return out | {"payload": b"".join(kept) if gather and not revisit else None, "error": None}


def records(stream, gather: bool = False) -> Iterator[dict]:
    """All records of one archive, in order; stream has read(n)."""
    source = _Source(stream)
    while True:
        start = source.at
        head = source.read()
        if not head:
            return
        source.back(head)
        part = _Member(source)
        try:
            yield {"offset": start} | _record(part, gather)
        except Broken as broken:
            yield {"offset": start, "error": str(broken)}
            if str(broken) == "gzip":
                return
            try:  # the next member begins where this one ends
                part.held = b""
                while part.piece():
                    pass
            except Broken:
                yield {"offset": source.at, "error": "gzip"}
                return


_READ = "archive string, offset long, record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_id string, payload binary, error string"


def _reader(gather: bool):
    names = [p.split()[0] for p in _READ.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[p.split()[1]] for p in _READ.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = arrow_fs.FileSystem.from_uri(archive)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in records(stream, gather):
                        rows.append(record | {"archive": archive})
                        held += len(record.get("payload") or b"") + 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, *, payload: bool = False, strict: bool = False) -> DataFrame:
    """All records of the archives named in the column `archive`, each archive in one task; strict fails at the first broken one."""
    out = archives.select("archive").repartition(max(1, archives.count())).mapInArrow(_reader(payload), _READ)
    if strict:
        out = out.where(F.assert_true(F.col("error").isNull(), F.concat_ws(" ", F.lit("broken record:"), "archive", "offset", "error")).isNull())
    return out


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"))
    pages = read_archives(archives, strict=True).where("record_type IN ('response', 'revisit')")
    read = stored(pages.select("record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"), "records")
    responses = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"))
    revisits = read.where("record_type = 'revisit'").join(responses, "refers_to_id", "left")
    found = F.assert_true(F.col("_digest") == F.col("payload_digest"), F.lit("a revisit refers to no response of its digest")).isNull()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(revisits.where(found).select(*names))


QUERIES = {"op12_warc": op12_warc}
SQL = {
    "op12_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, payload_bytes >= 100 AND page_id > min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM m"""
}
