"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, one bit per language; an
n-gram's slots combined by AND return all languages that contain it.  Letters
only count (A-Z lower-cased, everything else a space), n-grams are four bytes.
Per-language popcounts over a text's n-grams, corrected for each language's
false-positive rate, decide.

An n-gram enters a language's filter if it makes up at least `least_rate` of
that language's n-grams in the sample, so a language holds at most
1 / least_rate of them; filters of all languages together take at most
`filter_bytes` (smaller ones give more false positives, which the correction
takes off).  Learning reads about `sample_rows` documents of each language
(picked by hash of doc_id; rows with a null doc_id are not learned from).

Edge cases: `und` with score 0 for null texts and texts without a letter; with
nothing learned every text is `und`; null lang is not learned from; ties go to
the first language in sort order; repeated rows are judged again; empty tables
give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import materialise

UNKNOWN = "und"
PROBES = 3
_NORM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_SPACES = 0x20202020


@dataclass
class LanguageFilters:
    languages: list[str]
    slices: list[np.ndarray]  # of up to 64 languages each
    bits: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], filter_bytes: int = 256 << 20) -> LanguageFilters:
        languages = sorted(grams)
        most = max([len(g) for g in grams.values()] + [1])
        fits = int(filter_bytes // (8 * max(1, -(-len(languages) // 64)))).bit_length() - 1
        bits = max(12, min(24, int(most * 12).bit_length(), fits))
        slices, rates = [], []
        for lo in range(0, len(languages), 64):
            part = languages[lo : lo + 64]
            kind = np.uint8 if len(part) <= 8 else np.uint64
            table = np.zeros(1 << bits, dtype=kind)
            for j, lang in enumerate(part):
                for slot in _slots(grams[lang], bits):
                    table[slot] |= kind(1 << j)
                rates.append(float(((table >> kind(j)) & kind(1)).mean()) ** PROBES)
            slices.append(table)
        return cls(languages, slices, bits, np.array(rates))

    def counts(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per text and language: n-grams of the language, less the expected false ones."""
        out = []
        slots = _slots(grams, self.bits)
        for k, table in enumerate(self.slices):
            mask = table[slots[0]]
            for slot in slots[1:]:
                mask = mask & table[slot]
            for j in range(min(64, len(self.languages) - 64 * k)):
                out.append(B.sums((mask >> table.dtype.type(j)) & table.dtype.type(1), bounds))
        seen, total = np.array(out, dtype=float).reshape(len(self.languages), -1).T, np.diff(bounds)[:, None]
        return np.maximum(seen - total * self.false_rate, 0.0) / np.maximum(1 - self.false_rate, 1e-9)


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((grams * np.uint32(m)) >> np.uint32(32 - bits)).astype(np.int64) for m in _MULT]


def ngrams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of each text (two spaces around it), and each text's range."""
    parts = [b"  " + t.translate(_NORM) + b"  " for t in raw]
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size)
    data = b"".join(parts)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(raw) + 1, np.int64)
    grams = np.ndarray((len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    inside = np.ones(len(data), dtype=bool)
    for back in (1, 2, 3):
        inside[end - back] = False
    inside = inside[: len(grams)] & (grams != np.uint32(_SPACES))
    kept = np.concatenate([[0], np.cumsum(inside)])
    return grams[inside], kept[np.minimum(np.concatenate([[0], end]), len(grams))]


def fit(docs: DataFrame, sample_rows: int = 1500, least_rate: float = 2e-5, filter_bytes: int = 256 << 20) -> LanguageFilters:
    """Learn from the rows of `docs` (doc_id, text, lang) that have a lang."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("count")).alias("share")
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) / float(1 << 20)
    few = sizes.select("lang", share).collect()  # one row per language
    if not few:
        return LanguageFilters([], [], 12, np.zeros(0))
    limits = docs.sparkSession.createDataFrame([tuple(r) for r in few], "lang string, share double")
    picked = rows.join(F.broadcast(limits), "lang").filter(hashed < F.col("share")).select("lang", "text")

    def run(batches):
        for part in B.pieces(batches, "text"):
            grams, bounds = ngrams(B.byte_rows(part.column(1)))
            langs = part.column(0).to_pylist()
            owner = np.repeat(np.array([hash_at[x] for x in langs], dtype=np.uint64), np.diff(bounds))
            key, n = np.unique((owner << np.uint64(32)) | grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["l", "gram", "n"])

    names = sorted(r.lang for r in few)
    hash_at = {x: i for i, x in enumerate(names)}
    counts = materialise(picked.mapInArrow(run, "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")), "language-ngrams", "fewer")
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), "l").filter(F.col("n") >= F.greatest(F.lit(2), F.col("total") * least_rate))
    found = common.select("l", "gram").toArrow()  # at most 1 / least_rate a language
    owner, gram = (np.asarray(found.column(c).combine_chunks()) for c in ("l", "gram"))
    order = np.argsort(owner, kind="stable")
    parts = np.split(gram[order].astype(np.uint32), np.searchsorted(owner[order], np.arange(1, len(names))))
    return LanguageFilters.build(dict(zip(names, parts, strict=True)), filter_bytes)


def predict(docs: DataFrame, filters: LanguageFilters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns `keep`, lang_pred, score (the winner's share of all languages' counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kept = docs.select(*keep, F.col("text").alias("_rl_text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_text").dtypes), "lang_pred string, score double"])

    def run(batches):
        f = shared.value
        for part in B.pieces(batches, "_rl_text"):
            texts = part.column(part.num_columns - 1)
            raw = B.byte_rows(texts)
            buf, off = B.text_buffer(texts)
            lettered = B.sums(_ASCII_LETTER[buf], off) > 0
            for d in np.flatnonzero(~lettered).tolist():
                lettered[d] = raw[d] != b"" and _LETTER.search(raw[d].decode()) is not None
            if f.languages:
                counts = f.counts(*ngrams(raw))
                best = counts.argmax(axis=1)
                total = counts.sum(axis=1)
                score = np.where(lettered & (total > 0), counts.max(axis=1) / np.maximum(total, 1e-9), 0.0)
                names = [f.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            else:
                score, names = np.zeros(part.num_rows), [UNKNOWN] * part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names), pa.array(np.clip(score, 0, 1))], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
