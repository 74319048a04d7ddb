"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in blocks of `BLOCK` ids.  A
block stores its minimum, the differences from it packed at one width, and an
exception list for those that need more bits: their places and the bits above
the width.  The width is that of a percentile of the block's differences, the
one of `PERCENTILES` that makes the block smallest.  The footer indexes where
every block starts and where every document does, so that any document is read
without what lies before it.

Layout, little-endian: magic; blocks; footer = for each document its id (int64),
a null flag (uint8) and number of ids (uint32), then for each block its start
(uint64); trailer = footer's start (uint64), documents, blocks, ids (uint64
each), block size (uint32), CRC-32 of the footer (uint32), magic.
A block = minimum (uint32), ids (uint32), exceptions (uint32), width (uint8),
bytes of an exception's upper bits (uint8), packed differences, places
(uint16), upper bits.

Documents are dealt by ranges of doc_id (then of a hash of the text), ordered
within each range, encoded and written: file follows file in ascending order,
and a document's `start` is the files' running total plus its place in its own.
Rows of equal id and text stay in one range.

Edge cases: a null text is empty, and has the end id alone; null doc_ids come
first; equal doc_ids come in the order of their texts' hashes; special tokens'
strings are ordinary text; repeated rows are written again; empty tables give
no files and no rows.  Other columns are ignored.  A file is written under a
new name by each attempt of a task and counts once it is in the manifest, so a
lost executor leaves no wrong file behind.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import materialise, new_path, open_path

BLOCK = 4096
PERCENTILES = (50, 75, 90, 95, 99, 100)
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<IIIBB")
_TAIL = struct.Struct("<QQQQII8s")
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
CACHE_WORDS = 700_000  # twice as many are remembered, by the worker, not by the task
CACHED_CHARS = 64
# fixed values: the byte-level pre-tokenizer's pattern, and the same for Latin letters, where re has classes of the same members
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_SPLIT_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+").findall
_ODD_LATIN = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
_BEYOND_LATIN = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def _is_latin(text: str) -> bool:
    """Only letters that both patterns see alike?"""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)
    return len(raw.translate(None, _ODD_LATIN)) == len(raw)


# blocks


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers (blocks x ids, under 2^width) as rows of packed bytes."""
    size = 2 if width <= 16 else 4
    raw = np.ascontiguousarray(values, f"<u{size}").view(np.uint8).reshape(*values.shape, size)
    if width == 8 * size:
        return raw.reshape(len(values), -1)
    return np.packbits(np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, ids: int, width: int) -> np.ndarray:
    size = 2 if width <= 16 else 4
    if width < 8 * size:
        bits = np.zeros((len(packed), ids, 8 * size), np.uint8)
        bits[:, :, :width] = np.unpackbits(packed, axis=1, count=ids * width, bitorder="little").reshape(len(packed), ids, width)
        packed = np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(f"<u{size}").reshape(len(packed), ids).astype("<u4")


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Rows of ids (blocks x ids, uint32), each as a block."""
    n = ids.shape[1]
    low = ids.min(axis=1)
    diff = ids - low[:, None]
    bits = _BITS[diff].astype(np.int64) if diff.max() < len(_BITS) else np.frexp(diff.astype(np.float64))[1].astype(np.int64)  # the bit length of each
    count = np.bincount((bits + 33 * np.arange(len(ids))[:, None]).ravel(), minlength=33 * len(ids)).reshape(-1, 33)
    within = np.cumsum(count, axis=1)  # of how many ids the bit length is at most this
    top = bits.max(axis=1)
    best, cost = top, np.full(len(ids), np.iinfo(np.int64).max)
    for q in PERCENTILES:
        width = np.argmax(within >= -(-q * n // 100), axis=1)
        rest = (top - width + 7) // 8
        size = (n * width + 7) // 8 + (n - within[np.arange(len(ids)), width]) * (2 + rest)
        best, cost = np.where(size < cost, width, best), np.minimum(size, cost)
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(best).tolist():
        rows = np.flatnonzero(best == width)
        body = _pack(diff[rows] & np.uint32((1 << width) - 1), width) if width else np.zeros((len(rows), 0), np.uint8)
        for r, packed in zip(rows.tolist(), body, strict=True):
            at = np.flatnonzero(bits[r] > width)
            above = (diff[r, at] >> np.uint32(width)).astype("<u4") if len(at) else np.zeros(0, "<u4")
            rest = (int(top[r]) - width + 7) // 8
            out[r] = b"".join((
                _HEAD.pack(int(low[r]), n, len(at), width, rest), packed.tobytes(), at.astype("<u2").tobytes(), np.ascontiguousarray(above.view(np.uint8).reshape(-1, 4)[:, :rest]).tobytes(),
            ))
    return out


def decode_blocks(raw: bytes, starts: list[int]) -> list[np.ndarray]:
    """The ids of the blocks that begin at `starts` of `raw`."""
    heads = [_HEAD.unpack_from(raw, s) for s in starts]
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(starts)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, _, width, _) in enumerate(heads):
        shapes.setdefault((n, width), []).append(i)
    for (n, width), rows in shapes.items():
        size = (n * width + 7) // 8
        packed = np.stack([np.frombuffer(raw, np.uint8, size, starts[i] + _HEAD.size) for i in rows])
        values = _unpack(packed, n, width) if width else np.zeros((len(rows), n), "<u4")
        for i, v in zip(rows, values, strict=True):
            low, _, extra, _, rest = heads[i]
            if extra:
                places = starts[i] + _HEAD.size + size
                above = np.zeros((extra, 4), np.uint8)
                above[:, :rest] = np.frombuffer(raw, np.uint8, extra * rest, places + 2 * extra).reshape(extra, rest)
                v[np.frombuffer(raw, "<u2", extra, places)] |= above.view("<u4").ravel() << np.uint32(width)
            out[i] = v + np.uint32(low)
    return out


# files


class FileWriter:
    """Writes documents' ids, one after the other; holds at most `held` blocks of them."""

    def __init__(self, path: str, block: int = BLOCK, held: int = 64):
        if not 0 < block <= 1 << 16:
            raise ValueError("an exception's place takes 16 bits")
        self.path, self.block, self.held = path, block, held
        where, name = open_path(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(name)
        self.out.write(MAGIC)
        self.at, self.ids, self.starts, self.entries = len(MAGIC), 0, [], []
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.size += len(ids)
        self.ids += len(ids)
        if self.size >= self.held * self.block:
            self._put(last=False)

    def _put(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) // self.block * self.block
        groups = [ids[k : min(k + self.held * self.block, whole)].reshape(-1, self.block) for k in range(0, whole, self.held * self.block)]
        if last and len(ids) > whole:
            groups.append(ids[whole:].reshape(1, -1))
        for group in groups:
            for raw in encode_blocks(group):
                self.starts.append(self.at)
                self.out.write(raw)
                self.at += len(raw)
        self.waiting = [] if last else [ids[whole:].copy()]
        self.size = 0 if last else len(ids) - whole

    def close(self) -> tuple[str, int, int, int]:
        """(path, documents, ids, bytes)"""
        self._put(last=True)
        footer = np.array(self.entries, _ENTRY).tobytes() + np.array(self.starts, "<u8").tobytes()
        tail = _TAIL.pack(self.at, len(self.entries), len(self.starts), self.ids, self.block, zlib.crc32(footer), MAGIC)
        self.out.write(footer + tail)
        self.out.close()
        return self.path, len(self.entries), self.ids, self.at + len(footer) + len(tail)


class FileReader:
    """The documents of a file, all in order or any one by its place."""

    def __init__(self, path: str):
        where, name = open_path(path)
        self.file = where.open_input_file(name)
        end = self.file.size()
        if end < len(MAGIC) + _TAIL.size:
            raise ValueError(f"{path} is too short")
        self.file.seek(end - _TAIL.size)
        self.body, docs, blocks, self.ids, self.block, check, magic = _TAIL.unpack(self.file.read(_TAIL.size))
        self.file.seek(self.body)
        footer = self.file.read(end - _TAIL.size - self.body)
        if magic != MAGIC or zlib.crc32(footer) != check:
            raise ValueError(f"{path} is damaged")
        self.entries = np.frombuffer(footer, _ENTRY, docs)
        self.starts = np.append(np.frombuffer(footer, "<u8", blocks, docs * _ENTRY.itemsize).astype(np.int64), self.body)
        self.first = np.concatenate([[0], np.cumsum(self.entries["n"], dtype=np.int64)])

    def ids_between(self, lo: int, hi: int) -> np.ndarray:
        """The ids [lo, hi) of the file: reads the blocks that hold them, no others."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        a, b = lo // self.block, -(-hi // self.block)
        self.file.seek(int(self.starts[a]))
        raw = self.file.read(int(self.starts[b] - self.starts[a]))
        ids = np.concatenate(decode_blocks(raw, (self.starts[a:b] - self.starts[a]).tolist()))
        return ids[lo - a * self.block : hi - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids_between(int(self.first[i]), int(self.first[i + 1]))

    def documents(self, most: int = 64 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids) of all, in runs of about `most` ids."""
        lo = 0
        while lo < len(self.entries):
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + most, side="right")) - 1)
            ids = self.ids_between(int(self.first[lo]), int(self.first[hi]))
            for i in range(lo, hi):
                a, b = int(self.first[i] - self.first[lo]), int(self.first[i + 1] - self.first[lo])
                e = self.entries[i]
                yield None if e["null"] else int(e["id"]), int(self.first[i]), ids[a:b]
            lo = hi


# encoding


class Encoder:
    """Texts to ids by the tokenizers library, special tokens' strings as ordinary text.

    A byte-level tokenizer treats each match of its pattern alone, so texts are
    cut by that pattern and each distinct match is encoded once while it is
    remembered.  Other tokenizers get whole texts.
    """

    def __init__(self, serialised: str):
        self.tokenizer = tokenizers.Tokenizer.from_str(serialised)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(serialised)
        cut = said.get("pre_tokenizer") or {}
        self.by_match = not said.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 20_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)]
            out += [struct.pack(f"<{len(ids)}I", *ids) for ids in found]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_match:
            return self._ids(texts)
        cut = [(_SPLIT_LATIN if _is_latin(t) else _SPLIT)(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older, long = self.known, self.older, {}
        new = []
        for w in set().union(*cut).difference(known):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        for w, ids in zip(new, self._ids(new), strict=True):
            (known if len(w) <= CACHED_CHARS else long)[w] = ids
        get = {**known, **long}.__getitem__ if long else known.__getitem__
        return [b"".join(map(get, words)) for words in cut]


_LOADED: dict[str, Encoder] = {}  # the encoder that a worker has loaded


def _encoder(shared) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: the library's threads only wait for one another
    if (key := str(zlib.crc32(shared.value.encode()))) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(shared.value)
    return _LOADED[key]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, base: str | None = None, file_ids: int = 64 << 20) -> DataFrame:
    """Write all documents' ids, each followed by `end_id`; returns the manifest.

    The manifest has a row a file (path, docs, n_ids, bytes), with `base`, the
    number of ids in all files before it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    base = base or new_path(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        encoder, writer, done = _encoder(shared), None, []
        end = np.array([end_id], "<u4").tobytes()
        for part in B.pieces(batches, "text"):
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                writer = writer or FileWriter(f"{base}/{uuid.uuid4().hex}.ids")
                writer.add(doc, np.frombuffer(ids + end, "<u4"))
                if writer.ids >= file_ids:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        part_no = TaskContext.get().partitionId()
        cols = [[part_no] * len(done), list(range(len(done))), *(zip(*done, strict=True) if done else ((),) * 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "no", "path", "docs", "n_ids", "bytes"])

    files = materialise(rows.mapInArrow(run, "part long, no long, path string, docs long, n_ids long, bytes long"), "id-files")
    # running totals in two steps: groups of ranges, then files within a group
    files = files.withColumn("many", F.floor(F.col("part") / 1024))
    groups = files.groupBy("many").agg(F.sum("n_ids").alias("all_ids"))
    before = groups.withColumn("before", F.coalesce(F.sum("all_ids").over(Window.orderBy("many").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("many").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = files.withColumn("inside", inside).join(before.select("many", "before"), "many")
    return materialise(out.select("path", "docs", "n_ids", "bytes", (F.col("before") + F.col("inside")).alias("base")), "id-manifest", "few")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document in the files."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for doc, at, ids in FileReader(path).documents():
                    rows.append((doc, base + at, len(ids), ids.tobytes()))
                    size += len(ids)
                    if size >= 64 * BLOCK:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "base").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
