"""op5: WARC archives: a writer with payload dedup and a splittable reader.

Writing: every page is a record of its own gzip member. Of pages with equal payloads that of
the smallest id is a ``response``, the others are ``revisit`` records that refer to it and
carry digest and length, not the payload. Each task writes files of its own into the shared
folder under a temporary name and renames them, so a task that runs again replaces its file.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic number,
validates a candidate by decoding its beginning up to a WARC version line, and then reads
member after member. It owns the records that start inside its range, reads past the end to
finish the last one, and leaves what starts beyond to the next range.

Rows: null html is an empty payload; pages with null id never are what others refer to while
an id has the payload; equal pages of one id are all responses if theirs is the smallest.
Record ids are unique: where an id repeats or is null, its records' ids carry a suffix, and a
reference names the page. Null urls give records without target; control characters in urls
are percent-encoded; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import parts_for, shared_dir, stage, table

MIN_PAYLOAD = 0
SPLIT = 8 << 20
FILE_BYTES = 64 << 20
CHUNK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str, write: bool = False):
    if path.startswith("file:"):
        local = "/" + path[5:].lstrip("/")
        return open(local, "wb" if write else "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if write else store.open_input_file(name)


def _rename(a: str, b: str) -> None:
    if a.startswith("file:"):
        os.replace("/" + a[5:].lstrip("/"), "/" + b[5:].lstrip("/"))
    else:
        store, name = fs.FileSystem.from_uri(a)
        store.move(name, fs.FileSystem.from_uri(b)[1])


def _make_dir(path: str) -> None:
    if path.startswith("file:"):
        os.makedirs("/" + path[5:].lstrip("/"), exist_ok=True)
    else:
        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(name, recursive=True)


def page_urn(page_id: int | None, suffix: str = "") -> bytes:
    return f"<urn:x-page:{'none' if page_id is None else page_id}{':' + suffix if suffix else ''}>".encode()


def record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in headers) + b"Content-Length: %d\r\n\r\n" % len(block)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: bytes | None, payload: bytes, digest: str, refers_to: int | None, suffix: str) -> bytes:
    kind = b"response" if refers_to is None else b"revisit"
    headers = [(b"WARC-Type", kind), (b"WARC-Record-ID", page_urn(page_id, suffix)), (b"WARC-Date", DATE)]
    if url is not None:
        headers.append((b"WARC-Target-URI", b"".join(b"%%%02X" % c if c < 33 or c == 127 else bytes([c]) for c in url)))
    headers += [(b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        headers += [(b"WARC-Refers-To", page_urn(refers_to)), (b"WARC-Profile", PROFILE)]
    return record(headers, block)


def _digest(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def write_archives(pages: DataFrame, folder: str, least: int = MIN_PAYLOAD, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages (page_id, url, html, ...) -> manifest (path, bytes, records) of the files."""
    _make_dir(folder)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    same = rows.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    same = stage(same.filter("n > 1").select("sha", "size", "first"), "op5-same")
    rows = rows.join(same, ["sha", "size"], "left")
    twice = stage(rows.filter("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id", F.lit(True).alias("twice")), "op5-twice")
    rows = rows.join(twice, "page_id", "left")

    def write(batches):
        task = TaskContext.get()
        part, salt = task.partitionId() if task else 0, 0
        done, out, number = [], None, 0

        def close():
            nonlocal out
            if out:
                out.close()
                _rename(temp, path)
                done.append((path, size, count))
                out = None

        for batch in batches:
            for page_id, url, payload, sha, first, twice in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha", "first", "twice"))):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
                    temp = f"{path}.{uuid.uuid4().hex}.tmp"
                    out, size, count, number = _open(temp, write=True), 0, 0, number + 1
                    info = record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:x-file:%d-%d>" % (part, number)), (b"WARC-Date", DATE), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                salt += 1
                refers = first if first is not None and page_id != first else None
                member = page_record(page_id, url, payload, _digest(sha), refers, f"{part}-{salt}" if twice or page_id is None else "")
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "bytes": [x[1] for x in done], "records": [x[2] for x in done]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stage(rows.select("page_id", "url", "payload", "sha", "first", "twice").mapInArrow(write, "path string, bytes long, records long"), "op5-manifest")


class _Window:
    """Bytes of a file from any offset on, read ahead in chunks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from ``at`` (fewer at the end of the file)."""
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, CHUNK))
        return self.data[at - self.at : at - self.at + n]


def is_member(w: _Window, at: int) -> bool:
    """Whether a gzip member with a WARC record starts at ``at``."""
    z, step = zlib.decompressobj(31), 512
    head = b""
    try:
        for i in range(16):
            part = w.get(at + i * step, step)
            head += z.decompress(part)
            if len(head) >= 7 or not part or z.eof:
                break
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.")


def first_member(w: _Window, start: int, end: int) -> int | None:
    """The first record that starts in [start, end)."""
    at = start
    while at < end:
        part = w.get(at, min(CHUNK // 2, end - at) + len(MAGIC) - 1)
        spot = part.find(MAGIC)
        while spot >= 0:
            if at + spot < end and is_member(w, at + spot):
                return at + spot
            spot = w.get(at, len(part)).find(MAGIC, spot + 1)
        at += max(1, len(part) - len(MAGIC) + 1)
        if len(part) < len(MAGIC):
            return None
    return None


def read_member(w: _Window, at: int) -> tuple[bytes, int]:
    """The record that starts at ``at`` and the offset after its member."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        part = w.get(pos, CHUNK // 4)
        if not part:
            raise ValueError(f"truncated member at {at}")
        out.append(z.decompress(part))
        pos += len(part)
    return b"".join(out), pos - len(z.unused_data)


def parse(raw: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
    return headers, rest[: int(headers[b"content-length"])]


def _page_of(urn: bytes | None) -> int | None:
    name = (urn or b"").removeprefix(b"<urn:x-page:").removesuffix(b">").partition(b":")[0]
    return int(name) if name.lstrip(b"-").isdigit() else None


def read_archives(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """manifest (path, bytes) -> page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to, for each page record; digests of payloads are checked."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    # A task for each ``split`` bytes there are: the number is given, as the rows themselves
    # are so small that Spark would merge them into one task.
    ranges = ranges.repartition(parts_for(manifest.agg(F.sum("bytes")).first()[0] or 0, split))
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()))))

    def rows(path, size, start):
        with _open(path) as file:
            w, end = _Window(file, size), min(start + split, size)
            at = first_member(w, start, end)
            while at is not None and at < end:
                raw, after = read_member(w, at)
                headers, block = parse(raw)
                kind = headers[b"warc-type"].decode()
                if kind in ("response", "revisit"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path}: payload at {at} does not match its digest")
                    url = headers.get(b"warc-target-uri")
                    yield _page_of(headers[b"warc-record-id"]), url.decode("utf-8", "replace") if url is not None else None, payload if kind == "response" else None, n, digest, kind, _page_of(headers.get(b"warc-refers-to"))
                at = after if after < size else None

    def read(batches):
        for batch in batches:
            for path, size, start in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "start"))):
                held, weight = [], 0
                for row in rows(path, size, start):
                    held.append(row)
                    weight += len(row[2] or b"")
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), schema=schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), schema=schema)

    return ranges.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = MIN_PAYLOAD, split: int = SPLIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, least, file_bytes), split)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, count(*) AS n, min(page_id) AS first FROM p GROUP BY h
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substr(p.h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
