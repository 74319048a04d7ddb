"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file is serialised as a sentencepiece BPE model: each byte is one
character (U+0100 + byte), the score of a piece is minus its rank, the
normaliser is the identity.  Texts are cut by the vocabulary's pattern and
each match is encoded on its own; decoding maps every id back to its bytes.

Edge cases: a null text is empty (no ids); special-token strings are ordinary
text; a repeated row is encoded again; empty tables give empty results; the
longest match may be the whole text.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

CACHE_WORDS = 200_000
CACHED_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _mapped(raw: bytes) -> str:
    return "".join(chr(0x100 + b) for b in raw)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the unknown piece comes last."""
    by_id = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_id] != list(range(len(by_id))):
        raise ValueError("ranks must be 0..n-1")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no piece for bytes {missing[:5]}")
    out = bytearray()
    for i, piece in enumerate(by_id):
        out += _field(1, _field(1, _mapped(piece).encode()) + b"\x15" + struct.pack("<f", -float(i)))
    out += _field(1, _field(1, b"<unknown>") + b"\x15" + struct.pack("<f", -float(len(by_id))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_id) + 1) + _field(40, len(by_id)) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, b"<unknown>")
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normal))


class Codec:
    """Encoder and decoder; one lives in each task."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.bytes_map = {b: 0x100 + b for b in range(256)}
        n = self.sp.get_piece_size() - 1
        self.pieces = [bytes(ord(c) - 0x100 for c in self.sp.id_to_piece(i)) for i in range(n)]
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(set().union(*cut).difference(self.cache))
        long: dict[str, bytes] = {}
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            coded = self.sp.encode([w.encode().decode("latin-1").translate(self.bytes_map) for w in part], out_type=int, num_threads=1)
            for w, ids in zip(part, coded, strict=True):
                (self.cache if len(w) <= CACHED_CHARS else long)[w] = struct.pack(f"<{len(ids)}I", *ids)
        if long:
            return [b"".join([self.cache.get(w) or long[w] for w in ws]) for ws in cut]
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _codec(spark, vocab_path: str, pattern: str):
    return spark.sparkContext.broadcast((model_bytes(load_ranks(vocab_path)), pattern))


def _map(docs: DataFrame, keep: tuple[str, ...], vocab_path: str, pattern: str, extra: str, types: list, row) -> DataFrame:
    shared = _codec(docs.sparkSession, vocab_path, pattern)
    kept = docs.select(*keep, F.col("text").alias("_rl_text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_text").dtypes), extra])
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches):
        codec = Codec(*shared.value)
        for part in B.pieces(batches, "_rl_text"):
            coded = codec.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
            cols = zip(*(row(codec, ids) for ids in coded), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*part.schema.names[:-1], *names])

    return B.bounded(kept).mapInArrow(run, schema)


def encode(docs: DataFrame, vocab_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens and the ids of each text."""
    return _map(
        docs, keep, vocab_path, pattern, "n_tokens long, ids array<int>", [pa.int64(), pa.list_(pa.int32())],
        lambda _, ids: (len(ids) // 4, np.frombuffer(ids, dtype="<i4")),
    )


def decode(encoded: DataFrame, vocab_path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns `keep` and the decoded bytes of each id list; null ids give empty bytes, unknown ids fail."""
    pieces = encoded.sparkSession.sparkContext.broadcast([p for p, _ in sorted(load_ranks(vocab_path).items(), key=lambda x: x[1])])
    kept = encoded.select(*keep, F.col(ids).alias("_rl_ids"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_ids").dtypes), "decoded binary"])

    def run(batches):
        get = pieces.value.__getitem__
        for part in batches:
            out = [b"".join(map(get, row or ())) for row in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*part.schema.names[:-1], "decoded"])

    return B.bounded(kept).mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass: token count, digest of the ids, digest of the decoded bytes."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _map(
        docs, keep, vocab_path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()],
        lambda codec, ids: (len(ids) // 4, sha(ids), sha(codec.decode(ids))),
    )
