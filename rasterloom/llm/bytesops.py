"""Vectorised helpers over the UTF-8 bytes of Arrow text columns.

All operators of this subpackage that run Python work on Arrow batches inside
Spark tasks.  A batch is cut into pieces of bounded bytes (one long document
is the only thing that can exceed the bound), so a task's memory does not
depend on how many rows Spark puts in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20  # of an Arrow batch between Spark and a worker
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values from a fixed seed (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x632BE59BD9B4E019)) * _U(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; returns a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, for a Python stage, with Arrow batches of about BATCH_BYTES unless the session has a limit of its own.

    Spark's default of 10,000 rows up to 64 MB makes each task of whole texts hold a batch in the executor's direct
    memory, whose buffers double as they fill, and once more in its worker.  Spark reads the limit as a stage starts,
    so it stays set in the session; results do not depend on it.
    """
    conf = rows.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return rows


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `limit` bytes of `column`.

    After each batch, Arrow gives back the memory of those before it; a worker would keep it from task to task.
    """
    pa.default_memory_pool().release_unused()
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        off = _offsets(arr)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
        batch = arr = None
        pa.default_memory_pool().release_unused()


def with_text(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, str, int]:
    """The columns `keep` and the text for a Python stage, which gets it once; the text's name and place."""
    if "text" in keep:
        return docs.select(*keep), "text", list(keep).index("text")
    return docs.select(*keep, F.col("text").alias("_rl_text")), "_rl_text", len(keep)


def _offsets(arr: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    raw = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    off = _offsets(arr)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_rows(arr: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null counts as empty."""
    buf, off = text_buffer(arr)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


class Roller:
    """Substring hashes in constant time each from prefix sums modulo 2^64."""

    def __init__(self, seed: int = 1):
        self.table = splitmix(256, seed)
        self.base = int(splitmix(1, seed + 1000)[0]) & ~7 | 5  # 5 mod 8: long period in the low bits
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n += n // 8
            self.up = np.full(n, self.base, dtype=_U)
            self.down = np.full(n, self.inverse, dtype=_U)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        n = len(buf)
        self._grow(n + 1)
        out = np.zeros(n + 1, dtype=_U)
        np.cumsum(self.table[buf] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, _U)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the range of its words.

    Words are maximal runs of bytes outside `breaks`; none crosses a document.
    """
    inside = ~breaks[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside documents, and each document's range.

    A document of fewer words, but not none, is one shingle of all its words.
    """
    count = np.diff(bounds)
    full = np.maximum(count - width + 1, 0)
    short = np.flatnonzero((count > 0) & (count < width))
    n = np.maximum(full, (count > 0).astype(full.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], n) + np.repeat(bounds[:-1], n)
    odd = splitmix(width, 77) | _U(1)
    out = np.zeros(len(at), dtype=_U)
    padded = np.concatenate([words, np.zeros(width, dtype=_U)])
    for j in range(width):
        out += padded[at + j] * odd[j]
    out[out_bounds[short]] = 0
    for d in short.tolist():
        own = words[bounds[d] : bounds[d + 1]]
        out[out_bounds[d] : out_bounds[d] + 1] += (own * odd[: len(own)]).sum(dtype=_U, keepdims=True) + odd[-1:] * _U(len(own))
    return mix(out), out_bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values within each [bounds[i], bounds[i + 1])."""
    total = np.cumsum(values)
    total = np.concatenate([np.zeros(1, total.dtype), total])
    return total[bounds[1:]] - total[bounds[:-1]]
