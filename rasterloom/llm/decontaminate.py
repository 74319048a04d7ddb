"""Benchmark decontamination by Wu-Manber multi-pattern search.

Items and documents become words (A-Z lower-cased, a word is a run of ASCII
letters, digits and all non-ASCII characters) joined by single spaces.  Every
window of 10 consecutive item words is a pattern ` w1 ... w10 `; an item of
fewer words is one pattern.  The search reads one block of the text at a time
from each of many lanes at once: a shift table says how far a lane may jump,
a block that ends some pattern's prefix opens its suffix-hash bucket, and a
direct comparison of bytes confirms the occurrence.  A bucket holds its patterns
by length, so a stop costs one look-up a length, however many patterns begin
alike.

Pairs of pattern and item are made by Spark and written once, a row each.  A
set of up to `block_bytes` is broadcast; a larger one is dealt into blocks of
about that size by hash, and every document meets every block: a worker reads
a group of texts (`group_bytes`), then searches it with one block after the
other, so any number of items is searched in bounded memory, and a block is
loaded once for a group (one that is still loaded is not loaded again).

Edge cases: null or word-free texts have no words and no hits; null or
word-free items have no windows; repeated items count once per item_id;
a null item_id counts in n_items' list as an empty string; repeated document
rows are judged separately; empty tables give empty or clean results.
Columns other than the named ones are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import materialise, open_path

WINDOW = 10
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_U = np.uint64


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def patterns_of(text: bytes, window: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


class WuManber:
    """One automaton for patterns of at least `m` bytes; blocks of up to 8 bytes."""

    LANE = 1024

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = _U((1 << (8 * b)) - 1)
        self.far = m - b + 1
        bits = max(12, min(22, int(len(patterns) * self.far).bit_length() + 2))
        self.down = _U(64 - bits)
        self.shift = np.full(1 << bits, self.far, dtype=np.int32)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), dtype=np.uint8).reshape(-1, m)
        weight = _U(1) << (np.arange(b, dtype=_U) * _U(8))
        for j in range(self.far):
            slot = self._slot((heads[:, j : j + b].astype(_U) * weight).sum(axis=1, dtype=_U))
            np.minimum.at(self.shift, slot, m - b - j)
        self.bucket: dict[int, dict[int, set[bytes]]] = {}
        for p, slot in zip(patterns, slot.tolist(), strict=True):  # of the last block of the prefix
            self.bucket.setdefault(slot, {}).setdefault(len(p), set()).add(p)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * _U(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def search(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence in `raw`."""
        n = len(raw)
        if n < self.m:
            return
        view = np.ndarray((n,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
        lead = self.m - self.block  # from an occurrence's start to its prefix's last block
        begin = np.arange(0, n - self.m + 1, self.LANE, dtype=np.int64)
        end = np.minimum(begin + self.LANE, n - self.m + 1)
        at, found = begin, []
        while len(at):
            slot = self._slot(view[at + lead] & self.mask)
            jump = self.shift[slot]
            stop = jump == 0
            if stop.any():
                found.append(np.stack([at[stop], slot[stop]]))
            at = at + np.maximum(jump, 1)
            alive = at < end
            at, end = at[alive], end[alive]
        if found:
            for start, slot in np.concatenate(found, axis=1).T.tolist():
                for size, patterns in self.bucket.get(slot, {}).items():
                    if (p := raw[start : start + size]) in patterns:
                        yield start, p


class Block:
    """A bounded share of the items: automata by length class, and who owns each pattern."""

    def __init__(self, owners: dict[bytes, list[str]]):
        self.owners = owners
        classes = defaultdict(list)
        for p in sorted(owners):
            classes[min(len(p).bit_length(), 5)].append(p)
        self.automata = [WuManber(ps) for ps in classes.values()]


def _patterns(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """pattern, item: every window of every item once."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for part in B.pieces(batches, "text"):
            found = [sorted(patterns_of(t, window)) for t in B.byte_rows(part.column(1))]
            take = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p for f in found for p in f], pa.binary()), part.column(0).take(take)], names=["pattern", "item"])

    return B.bounded(rows).mapInArrow(run, "pattern binary, item string").distinct()


def _block(table: pa.Table) -> Block:
    owners = defaultdict(list)
    for pattern, item in zip(table.column("pattern").to_pylist(), table.column("item").to_pylist(), strict=True):
        owners[pattern].append(item)
    return Block(dict(owners))


def pattern_blocks(spark, benchmark: DataFrame, window: int, block_bytes: int, item: str, text: str) -> list:
    """The items' patterns as one broadcast, or as folders of the written table if they exceed a block."""
    found = materialise(_patterns(benchmark, window, item, text), "patterns", "few")
    size = found.agg(F.sum(F.length("pattern") + F.lit(160))).first()[0]
    if not size:
        return []
    if size <= block_bytes:
        return [spark.sparkContext.broadcast(_block(found.toArrow()))]
    n = -(-size // block_bytes)
    path = f"{found._rl_path}-blocks"
    number = F.pmod(F.xxhash64("pattern", "item"), F.lit(n)).alias("block")  # the items of one pattern may lie in several
    found.select("pattern", "item", number).repartition(min(n, 2000), "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={i}" for i in range(n)]


_LOADED: dict[str, Block | None] = {}  # the block that a worker has loaded last


def _load(path: str) -> Block | None:
    if path not in _LOADED:
        where, name = open_path(path)
        files = [f.path for f in where.get_file_info(fs.FileSelector(name, allow_not_found=True)) if f.path.endswith(".parquet")]
        _LOADED.clear()
        _LOADED[path] = _block(pa.concat_tables([pq.ParquetFile(where.open_input_file(f)).read() for f in files])) if files else None
    return _LOADED[path]


def _blocks(blocks: list) -> Iterator[Block]:
    # one that is loaded comes first
    for b in sorted(blocks, key=lambda b: not (isinstance(b, str) and b in _LOADED)):
        block = _load(b) if isinstance(b, str) else b.value
        if block is not None:
            yield block


def _hits(groups: list[list[bytes]], blocks: list) -> Iterator[list[tuple[int, np.ndarray, set[str]]]]:
    """For each group, per text: number of words, which of them are hit, items with occurrences.

    Every block searches all groups before the next one is loaded.
    """
    ready = []
    for texts in groups:
        norm, base, counts = [], [0], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            norm.append(b" " + b" ".join(words) + b" \n")
            base.append(base[-1] + len(norm[-1]))
        ready.append((b"".join(norm), np.array(base), counts, defaultdict(list), defaultdict(set)))
    for block in _blocks(blocks):
        for raw, base, _, found, items in ready:
            for automaton in block.automata:
                hits = list(automaton.search(raw))
                docs = np.searchsorted(base, [h[0] for h in hits], side="right") - 1
                for (at, p), d in zip(hits, docs.tolist(), strict=True):
                    found[d].append((at - base[d], len(p)))
                    items[d].update(block.owners[p])
    for raw, base, counts, found, items in ready:
        out = []
        for d, n in enumerate(counts):
            hit = np.zeros(n, dtype=bool)
            if d in found:
                gaps = np.flatnonzero(np.frombuffer(raw[base[d] : base[d + 1]], dtype=np.uint8) == 32)
                at = np.array(found[d])
                lo, hi = np.searchsorted(gaps, at[:, 0]), np.searchsorted(gaps, at[:, 0] + at[:, 1] - 1)
                step = np.zeros(n + 1, dtype=np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, hi, -1)
                hit = np.cumsum(step)[:n] > 0
            out.append((n, hit, items.get(d, set())))
        yield out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 64 << 20, group_bytes: int = 24 << 20, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Per document row: the columns `keep`, words, hit words, items found, `contaminated`.

    Adds `items` (array of item ids, sorted as strings) beside the digest.
    """
    spark = docs.sparkSession
    blocks = pattern_blocks(spark, benchmark, window, block_bytes, "item_id", "text")
    kept, name, at = B.with_text(docs, keep)
    extra = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_text").dtypes), extra])

    def judged(parts):
        found = _hits([B.byte_rows(p.column(at)) for p in parts], blocks)
        for part, rows in zip(parts, found, strict=True):
            out = defaultdict(list)
            for n, hit, items in rows:
                names = sorted(items)
                out["n_words"].append(n)
                out["n_hit"].append(int(hit.sum()))
                out["n_items"].append(len(names))
                out["items"].append(names)
                out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
                out["contaminated"].append(bool(hit.any()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(keep)], *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(),) * 3 + (pa.list_(pa.string()), pa.string(), pa.bool_()), strict=True))],
                names=[*part.schema.names[: len(keep)], *out],
            )

    def run(batches):
        held, size = [], 0
        for part in B.pieces(batches, name):
            held.append(part)
            size += B.text_buffer(part.column(at))[0].nbytes
            if len(blocks) < 2 or size >= group_bytes:  # one block needs no waiting
                yield from judged(held)
                held, size = [], 0
        yield from judged(held)

    return B.bounded(kept).mapInArrow(run, schema)
