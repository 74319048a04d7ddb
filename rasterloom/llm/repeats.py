"""Repeated passages: a depth-limited radix sort of suffixes, most significant digit first.

A byte goes if a string of `threshold` bytes that covers it starts anywhere
else too.  Every suffix with at least `threshold` bytes left enters; suffixes
are told apart only through those bytes, in two digits: the first `digit`
bytes, then all `threshold` bytes.  After each pass groups of one leave, and
the groups that are equal to the full depth are the repeated windows.

A pass: tasks read chunks of texts (about `chunk_bytes`), take a fingerprint
of the digit at every suffix still in, sort the fingerprints and deal them,
packed, into buckets by their leading bits; a fingerprint that a chunk has
more than once goes twice.  A bucket sorts what it gets, finds the
fingerprints that occur again, and returns to each chunk which of its own do
(after the first digit, where most leave) or do not (after the whole depth,
where most stay).  Only fingerprints travel; texts are written once, with
their chunk's number, and never shuffled.  A passage in very many rows costs
at most two entries a chunk, in one bucket for each of its positions.  A pass
over a large input runs in four rounds (2 to the power of `most_part_bits`;
half as many for the whole depth), each for its share of the leading bits: texts are hashed again in each, but
only one round's fingerprints lie on disk.

Fingerprints of the first digit have few bits (five more than the number of
suffixes has): one taken for repeated by chance is found out by the whole
depth, whose fingerprint has twice as many bits as the number of suffixes and
one more.  Where that is more than 64, the whole depth is passed twice, with
independent hashes.  A chunk and a bucket share one row, so rows grow with the
square of the input over chunk and bucket size: both grow with the square root
of the input from `chunk_bytes` on, up to `most_bytes`.

Edge cases: null is the empty text; texts under `threshold` bytes lose nothing;
a text of `threshold` bytes or more that occurs in two rows goes whole in both
(rows count, also repeated ones and those with null or equal doc_ids); matches
never cross documents; a removed run may cut a character; empty tables give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard as zstd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import materialise, open_path

_U = np.uint64
_ONE, _WHOLE = B.Roller(51), (B.Roller(52), B.Roller(53))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, lowest bytes first, compressed."""
    steps = np.diff(values, prepend=values[:1] * _U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstd.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view(_U), dtype=_U)


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """doc_id, text (never null) and the number of the chunk, whose rows follow one another."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for part in B.pieces(batches, "text"):
            size += B.text_buffer(part.column(1))[0].nbytes
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, chunk))], names=["doc_id", "text", "chunk"])
            if size >= chunk_bytes:
                chunk, size = chunk + 1, 0

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string, chunk long")


def _by_chunk(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, piece) for pieces of bounded bytes, each of one chunk."""
    for part in B.pieces(batches, "text"):
        chunk = np.asarray(part.column(part.schema.get_field_index("chunk")))
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(chunk[a]), part.slice(a, b - a)


def _starts(off: np.ndarray, threshold: int) -> np.ndarray:
    """Positions of the suffixes with at least `threshold` bytes of their document left."""
    inside = np.zeros(int(off[-1]), dtype=bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        inside[a : max(a, b - threshold + 1)] = True
    return np.flatnonzero(inside)


class Returned:
    """The fingerprints that a pass has returned to each chunk, read from their tables (one a round) as chunks come by."""

    def __init__(self, paths: list[str]):
        self.paths, self.chunk = paths, None

    def load(self, chunk: int) -> None:
        if chunk == self.chunk:
            return
        packed = []
        for path in self.paths:
            where, name = open_path(f"{path}/chunk={chunk}")
            files = [f.path for f in where.get_file_info(fs.FileSelector(name, allow_not_found=True)) if f.path.endswith(".parquet")]
            packed += [x for f in files for x in pq.ParquetFile(where.open_input_file(f)).read(columns=["packed"]).column(0).to_pylist()]
        self.values = np.sort(np.concatenate([unpack(x) for x in packed])) if packed else np.zeros(0, _U)
        self.low = _U((1 << (len(self.values).bit_length() + 4)) - 1)
        self.screen = np.zeros(int(self.low) + 1, bool)
        self.screen[(self.values & self.low).astype(np.int64)] = True
        self.chunk = chunk

    def perhaps(self, keys: np.ndarray) -> np.ndarray:
        """Which keys were returned; a few more by chance."""
        return self.screen[(keys & self.low).astype(np.int64)]

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which keys were not returned."""
        out = np.ones(len(keys), bool)
        at = np.flatnonzero(self.perhaps(keys))
        if len(at):
            where = np.minimum(np.searchsorted(self.values, keys[at]), len(self.values) - 1)
            out[at] = self.values[where] != keys[at]
        return out


class _Digits:
    """Suffixes of a piece that are still in, and their fingerprints for the next pass."""

    def __init__(self, threshold: int, digit: int, suffixes: int, bucket_bits: int):
        size = suffixes.bit_length()
        self.threshold, self.digit, self.bucket_bits = threshold, digit, bucket_bits
        self.bits = [min(64, max(24, size + 5, bucket_bits)), min(64, max(24, 2 * size + 1))]
        if 2 * size + 1 > 64:
            self.bits.append(64)

    def alive(self, buf: np.ndarray, off: np.ndarray, known: list[Returned]) -> tuple[np.ndarray, np.ndarray]:
        """(positions that the passes in `known` left in, their fingerprints for the pass after these; none after the last)."""
        at, keys = _starts(off, self.threshold), np.zeros(0, _U)
        for k in range(len(known) + 1):
            if not len(at) or k == len(self.bits):
                return at, np.zeros(0, _U)
            if k == 0:
                keys = _ONE.windows(_ONE.prefix(buf), self.digit)[at]
            else:
                keys = _WHOLE[k - 1].spans(_WHOLE[k - 1].prefix(buf), at, at + self.threshold)
            keys >>= _U(64 - self.bits[k])
            if k < len(known):
                at = at[known[k].missing(keys) if k else known[k].perhaps(keys)]
        return at, keys


def _capped(values: np.ndarray) -> np.ndarray:
    """Sorted values, each at most twice."""
    keep = np.ones(len(values), bool)
    keep[2:] = values[2:] != values[:-2]
    return values[keep]


def _dealt(base: DataFrame, digits: _Digits, held: int, paths: list[list[str]], part_bits: int, part_no: int) -> DataFrame:
    """The pass after those whose returns lie in `paths`, outward: bucket, chunk, packed fingerprints whose leading bits are `part_no`."""
    down = digits.bits[len(paths)] - digits.bucket_bits
    leading = _U(digits.bits[len(paths)] - part_bits)

    def rows_of(chunk: int, parts: list) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(parts)
        keys.sort()
        keys = _capped(keys)
        edges = np.searchsorted(keys, np.arange(1, 1 << digits.bucket_bits, dtype=_U) << _U(down))
        out = [(n, pack(k)) for n, k in enumerate(np.split(keys, edges)) if len(k)]
        for lo in range(0, len(out), 256):
            some = out[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int32()), pa.array(np.full(len(some), chunk)), pa.array([p for _, p in some], pa.binary())], names=["bucket", "chunk", "packed"])

    def run(batches):
        known = [Returned(p) for p in paths]
        parts, now, size = [], None, 0
        for chunk, part in _by_chunk(batches):
            if parts and (chunk != now or size >= held):
                yield from rows_of(now, parts)
                parts, size = [], 0
            now = chunk
            for k in known:
                k.load(chunk)
            _, keys = digits.alive(*B.text_buffer(part.column(1)), known)
            if part_bits:
                keys = keys[keys >> leading == _U(part_no)]
            if len(keys):
                parts.append(keys)
                size += len(keys)
        if parts:
            yield from rows_of(now, parts)

    return base.select("doc_id", "text", "chunk").mapInArrow(run, "bucket int, chunk long, packed binary")


def _returned(dealt: DataFrame, name: str, tasks: int, again: bool) -> str:
    """One pass back: the path of a table, by chunk, of the fingerprints that occur again in their bucket (or those that do not)."""

    def group(rows: pa.Table) -> pa.Table:
        each = [unpack(x) for x in rows.column("packed").to_pylist()]
        every = np.sort(np.concatenate(each))
        twice = every[1:][every[1:] == every[:-1]]
        twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
        chunks, packed = [], []
        for chunk, keys in zip(rows.column("chunk").to_pylist(), each, strict=True):
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
            hit = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys if len(twice) else np.zeros(len(keys), bool)
            keys = keys[hit == again]
            if len(keys):
                chunks.append(chunk)
                packed.append(pack(keys))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "packed": pa.array(packed, pa.binary())})

    found = dealt.groupBy("bucket").applyInArrow(group, "chunk long, packed binary")
    return materialise(found.repartition(tasks, "chunk"), name, by="chunk")._rl_path


def _cut(base: DataFrame, digits: _Digits, paths: list[list[str]]) -> DataFrame:
    threshold = digits.threshold

    def run(batches):
        known = [Returned(p) for p in paths]
        for chunk, part in _by_chunk(batches):
            buf, off = B.text_buffer(part.column(1))
            for k in known:
                k.load(chunk)
            at, _ = digits.alive(buf, off, known) if known else (np.zeros(0, np.int64), None)
            # runs of removed bytes; none goes on into the next document
            doc = np.searchsorted(off, at, side="right") - 1
            new = np.flatnonzero(np.concatenate([[True], (at[1:] > at[:-1] + threshold) | (doc[1:] != doc[:-1])])) if len(at) else at
            lo, hi = at[new], (at[np.append(new[1:], len(at)) - 1] + threshold) if len(at) else at
            owner = doc[new] if len(at) else doc
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
            raw, out = buf.tobytes(), []
            for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                x, y = lo[bounds[d] : bounds[d + 1]].tolist(), hi[bounds[d] : bounds[d + 1]].tolist()
                rest = b"".join(raw[s:e] for s, e in zip([a, *y], [*x, b], strict=True))
                out.append((b - a, b - a - len(rest), len(x), [{"start": s - a, "end": e - a} for s, e in zip(x, y, strict=True)], hashlib.sha256(rest).hexdigest()))
            n, gone, k, spans, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(spans, _SPANS), pa.array(sha)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
            )

    key = base.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "text", "chunk").mapInArrow(run, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def repeated_passages(docs: DataFrame, threshold: int = 200, digit: int = 100, chunk_bytes: int = 8 << 20, most_bytes: int = 256 << 20, most_part_bits: int = 2) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans (bytes, end exclusive), kept_sha256."""
    if not 0 < digit <= threshold:
        raise ValueError("the first digit lies within the threshold")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = min(max(chunk_bytes, int((total * 2048) ** 0.5)), most_bytes)
    base = materialise(_chunked(docs, chunk_bytes), "passage-chunks", compression="zstd")
    suffixes = base.agg(F.sum(F.greatest(F.octet_length("text") - (threshold - 1), F.lit(0)).cast("long")), F.count_distinct("chunk")).first()
    bucket_bits = max(0, (int(suffixes[0] or 0) // (chunk_bytes // 2)).bit_length())
    digits, paths = _Digits(threshold, digit, int(suffixes[0] or 0), bucket_bits), []
    tasks = max(1, min(int(suffixes[1]), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    part_bits = min(most_part_bits, max(0, bucket_bits - 3))
    for k in range(len(digits.bits) if suffixes[0] else 0):
        shares = max(0, part_bits - (k > 0))  # fewer are in for the whole depth
        rounds = (_dealt(base, digits, 2 * chunk_bytes, paths, shares, i) for i in range(1 << shares))
        paths.append([_returned(dealt, f"digit-{k}", tasks, again=k == 0) for dealt in rounds])
    return _cut(base, digits, paths)
