"""Dictionary-compressed WARC archives: written in tasks, then read back.

Each task writes its rows to shards in the shared folder.  A shard begins with
a skippable frame that embeds a Zstandard dictionary, built from the first
records archived in that shard (`sample_bytes`, a bounded buffer); then each
record is one Zstandard frame of its own.  Records with equal payloads become
revisits of the one with the largest page id.

Shards are named by a fresh id and enter the manifest only when the task that
wrote them succeeds, so a retried task leaves unread files, never double rows.

Edge cases: null html is an empty payload (empty payloads are equal too);
a null url gives an empty target; control characters in urls are
percent-encoded; rows with a null page_id take part, and revisit the largest
non-null id if there is one, else are responses; repeated rows of the largest
id are all responses; empty tables give no archives and no rows.  A shard is
closed at `shard_bytes`; one record is held in memory whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, new_path, open_path

SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
DICT_BYTES = 48 << 10
_NAMESPACE = uuid.UUID("7e1d0f5e-6d0f-5b7b-9a57-0f2d0c1b6a10")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or (too little to train on) the records' own bytes as a raw one."""
    try:
        return zstd.train_dictionary(size, records, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(records)[:size]


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict:
    return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if raw.startswith(DICT_MAGIC) else zstd.DICT_TYPE_RAWCONTENT)


class ShardWriter:
    def __init__(self, base: str, sample_bytes: int, shard_bytes: int, level: int):
        self.base, self.sample_bytes, self.shard_bytes, self.level = base, sample_bytes, shard_bytes, level
        self.waiting: list[bytes] = []
        self.held = 0
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= self.sample_bytes:
                self._open()
            return
        self._put(raw)

    def _open(self) -> None:
        words = build_dictionary(self.waiting)
        self.path = f"{self.base}/{uuid.uuid4().hex}.warc.zst"
        where, name = open_path(self.path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(name)
        packed = zstd.ZstdCompressor(level=self.level).compress(words)
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.press = zstd.ZstdCompressor(level=self.level, dict_data=_dictionary(words), write_content_size=True)
        self.records, self.size = 0, len(packed) + 8
        first, self.waiting, self.held = self.waiting, [], 0
        for raw in first:
            self._put(raw)

    def _put(self, raw: bytes) -> None:
        frame = self.press.compress(raw)
        self.out.write(frame)
        self.records += 1
        self.size += len(frame)
        if self.size >= self.shard_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.size))
            self.out = None


def read_records(path: str, chunk: int = 64 << 10) -> Iterator[bytes]:
    """The records of a shard, streamed frame by frame."""
    where, name = open_path(path)
    with where.open_input_stream(name) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no leading dictionary frame")
        unpack = zstd.ZstdDecompressor(dict_data=_dictionary(zstd.ZstdDecompressor().decompress(f.read(size))))
        data = f.read(chunk)
        while data:
            frame, parts = unpack.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data or f.read(chunk)
                    break
                data = f.read(chunk)
                if not data:
                    raise ValueError(f"{path} ends within a record")
            yield b"".join(parts)


def with_roles(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, int]:
    """(page_id, url, payload, is_revisit, refers_to; all payloads' bytes).

    Only digests and ids are grouped, from a table of them that is written
    once; so is the aggregate that they are joined to, so that Spark can split
    a digest that very many pages share.  Pages with their html are shuffled
    once, on (page id, digest).
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    ids = materialise(rows.select("page_id", "digest", F.length("payload").alias("n")), "warc-digests")
    shared = ids.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("refers_to")).filter("copies > 1 and refers_to is not null").drop("copies")
    shared = materialise(shared, "warc-shared", "fewer")
    again = ids.join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = materialise(again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to").distinct(), "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest"))
    out = rows.join(revisits.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload", F.col("r_digest").isNotNull().alias("is_revisit"), "refers_to")
    return out, ids.agg(F.sum("n")).first()[0] or 0


def write_archives(
    pages: DataFrame, base: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
    sample_bytes: int = 768 << 10, shard_bytes: int = 256 << 20, level: int = 3, task_bytes: int = 8 << 20,
) -> DataFrame:
    """Write one record per row; returns the manifest (path, records, bytes), itself a written table.

    A task takes at least about `task_bytes` of payload, so that small inputs
    don't end in many tiny archives.
    """
    rows, size = with_roles(pages, min_bytes)
    tasks = max(1, -(-size // task_bytes))
    base = base or new_path(pages.sparkSession, "warc")

    def run(batches):
        writer = ShardWriter(base, sample_bytes, shard_bytes, level)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, url, payload, again, refers = row
                writer.add(record(page, url, payload, refers, again, date))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*writer.done, strict=True) if writer.done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return materialise(rows.coalesce(tasks).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, check_digest: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every archived record.

    A response whose payload does not match its digest fails the read.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def whole(raw: bytes) -> tuple:
        headers, http, payload = parse(raw)
        number = lambda k: int(headers[k]) if k in headers else None
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = headers["WARC-Type"]
        if check_digest and kind == "response" and digest32(payload) != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID")

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches):
        rows: list = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for raw in read_records(path):
                    rows.append(whole(raw))
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    shards = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(shards).mapInArrow(run, schema)
