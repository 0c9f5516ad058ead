"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; after the frames come the record
index, in a skippable frame (identifier, frame, offset in the frame's content, length), and the
seek table of the Zstandard seekable format, in the last skippable frame. A record is read with the tail
of the file and one frame. Any Zstandard decoder reads the whole as one WARC file.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, shared_dir, table
from .files import RangeFile, write_file

# Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = 0x184D2A50  # any other skippable magic number
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit names what it repeats and has no payload."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {identifier(refers_to)}",
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def identifier(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.held, self.size, self.total, self.seek, self.index = [], [], 0, 0, [], []

    def add(self, name: str, raw: bytes) -> None:
        self.index.append([name, len(self.seek), self.size, len(raw)])
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.held:
            frame = self.packer.compress(b"".join(self.held))
            self.seek.append((len(frame), self.size))
            self.out.append(frame)
            self.total += len(frame)
            self.held, self.size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        index = self.packer.compress(json.dumps(self.index).encode())
        self.out.append(struct.pack("<II", INDEX, len(index)) + index)
        self.seek.append((len(index) + 8, 0))
        table = b"".join(struct.pack("<II", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0, SEEKABLE)
        self.out.append(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return b"".join(self.out)


class BundleReader:
    """Reads records by identifier, or all of them in order."""

    def __init__(self, uri: str):
        self.file = RangeFile(uri)
        n, _, magic = struct.unpack("<IBI", self.file.read(self.file.size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {uri}")
        at = self.file.size - 9 - 8 * n
        self.frames, start = [], 0
        for packed, plain in struct.iter_unpack("<II", self.file.read(at, 8 * n)):
            self.frames.append((start, packed, plain))
            start += packed
        begin, packed, _ = self.frames.pop()
        self.unpack = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unpack.decompress(self.file.read(begin + 8, packed - 8)))
        self.where = {name: (frame, offset, length) for name, frame, offset, length in self.index}

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return self.unpack.decompress(self.file.read(start, packed), max_output_size=plain)

    def get(self, name: str) -> bytes:
        frame, offset, length = self.where[name]
        return self.frame(frame)[offset : offset + length]

    def __iter__(self) -> Iterator[bytes]:
        held, data = -1, b""
        for _, frame, offset, length in self.index:
            if frame != held:
                held, data = frame, self.frame(frame)
            yield data[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``; others are not read).

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest page id is a
    response and the others revisit it; smaller payloads are all responses. A null html is an empty
    payload, a null url has no target line, null ids never own a payload that a row with an id has; of
    rows that repeat an id and payload each is a response. An empty table gives no bundle. Only digests
    and ids are grouped, pre-aggregated, to find the owners; the join back is one that adaptive execution
    splits where a payload is very common. Returns the manifest (uri, n_records); files of lost task
    attempts are in none.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    owners = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
    owners = owners.where("n > 1").select("digest", "owner")
    rows = rows.join(owners, "digest", "left")
    repeat = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    rows = rows.select(
        "page_id", "url", "digest", "size",
        F.when(repeat, F.lit(None)).otherwise(F.col("html")).alias("html"),
        F.when(repeat, "revisit").otherwise("response").alias("kind"),
        F.when(repeat, F.col("owner")).alias("refers_to"),
    )

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        bundle, n, size = BundleWriter(frame_bytes, level), 0, 0

        def close():
            uri = write_file(folder, f"pages-{part:06d}-{seq:06d}", bundle.finish(), ".warc.zst")
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n]})

        for batch in batches:
            html = batch.column("html")
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "kind", "refers_to")])):
                page, url, digest, length, kind, to = row
                payload = html[i].as_py().encode() if kind == "response" else _Length(length)
                raw = record(page, url or "", payload, digest, kind, to)
                bundle.add(identifier(page), raw)
                n, size = n + 1, size + len(raw)
                if size >= bundle_bytes:
                    yield close()
                    bundle, n, size, seq = BundleWriter(frame_bytes, level), 0, 0, seq + 1
        if n:
            yield close()

    return materialize(rows.mapInArrow(write, "uri string, n_records long"), "bundles")


class _Length(bytes):
    """Stands for a payload that is not here; its length is."""

    def __new__(cls, n: int):
        self = super().__new__(cls)
        self.n = n
        return self

    def __len__(self) -> int:
        return self.n


def read_bundles(manifest: DataFrame) -> DataFrame:
    """One row for each record, from the files: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. Digests of responses are computed from the payload that was read."""

    def number(name: str | None):
        tail = name[10:-1] if name else "none"
        return None if tail == "none" else int(tail)

    def read(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                bundle, out = BundleReader(uri), []
                for raw in bundle:
                    r = parse(raw)
                    response = r["warc-type"] == "response"
                    digest = hashlib.sha256(r["payload"]).hexdigest() if response else r["warc-payload-digest"][7:]
                    if r["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"payload differs from its digest: {r['warc-record-id']} in {uri}")
                    size = len(r["payload"]) if response else int(r["http"]["Content-Length"])
                    out.append((number(r["warc-record-id"]), r.get("warc-target-uri"), size, digest, r["warc-type"], number(r.get("warc-refers-to"))))
                bundle.close()
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    n = max(1, manifest.count())
    files = manifest.select("uri").repartition(min(n, 4 * partitions(manifest.sparkSession)))
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_bundles(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    return read_bundles(manifest).drop("url")


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages
), o as (
  select payload_digest, min(page_id) as owner from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
       case when o.owner < p.page_id then 'revisit' else 'response' end as record_type,
       case when o.owner < p.page_id then o.owner end as refers_to
from p left join o on p.payload_digest = o.payload_digest
"""
