"""Quality rules: base counts, then hashed n-gram logistic regression.

The model sees hashed word n-grams (one and two words) and character 3-grams (code points) as
relative frequencies, is fitted by Spark ML on at most `sample_rows` labelled
rows (those with the smallest hash of doc_id), and its margin is turned into a
probability by logistic calibration on a quarter of them kept out of the fit.
Documents are scored in Arrow batches against the fixed threshold `accept`.

Edge cases: null text has no words; rows without a label, with a label whose
document is missing, or with repeated doc_ids are ignored or used once in
training (of conflicting labels the larger counts; of several texts of one
doc_id the one with the smallest hash); with labels of one class only, or none, the probability is that
class's (or 1); repeated rows are judged again; empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import bytesops as B
from .storage import materialise

BITS = 12
SLOTS = 1 << BITS  # of each of the three families
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_U = np.uint64


@dataclass
class QualityModel:
    weights: np.ndarray  # 3 * SLOTS
    intercept: float
    slope: float  # calibration: p = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float


def _characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each code point as one number, and each document's range."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(at) == len(buf):
        return buf.astype(np.uint32), off
    size, padded = np.diff(np.append(at, len(buf))), np.concatenate([buf, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, np.searchsorted(at, off)


def _families(buf: np.ndarray, off: np.ndarray, words: np.ndarray, bounds: np.ndarray):
    """(slots, bounds) of word unigrams, word bigrams and character 3-grams."""
    down = _U(64 - BITS)
    yield (words >> down).astype(np.int64), bounds
    pairs, pb = B.shingle_hashes(words, bounds, 2)
    yield (pairs >> down).astype(np.int64) + SLOTS, pb
    char, off = _characters(buf, off)
    n = len(char)
    tri = char[: n - 2] * np.uint32(0x9E3779B1) + char[1 : n - 1] * np.uint32(0x85EBCA77) + char[2:] * np.uint32(0xC2B2AE3D) if n > 2 else np.zeros(0, np.uint32)
    inside = np.ones(len(tri), dtype=bool)
    for back in (1, 2):  # starts whose 3-gram would cross into the next document
        edge = off[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(tri))]] = False
    slots = ((tri[inside] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64) + 2 * SLOTS
    kept = np.concatenate([[0], np.cumsum(inside)])
    yield slots, kept[np.minimum(off, len(tri))]


_ROLLER = B.Roller(11)
#: How a vector column is stored: read back under that type, no second Python worker has to build the vectors.
_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
_SAMPLE = StructType([StructField("label", DoubleType()), StructField("fold", IntegerType()), StructField("features", VectorUDT())])


def base_counts(buf: np.ndarray, off: np.ndarray, raw: list[bytes]):
    """Word hashes and ranges, and per document the base counts."""
    starts, ends, bounds = B.word_spans(buf, off)
    words = _ROLLER.spans(_ROLLER.prefix(buf), starts, ends)
    n_words = np.diff(bounds)
    chars = B.sums(((buf & 0xC0) != 0x80) & ~B.SPACE[buf], off)
    symbols = B.sums(_SYMBOL[buf], off)
    dup = np.zeros(len(raw), dtype=np.int64)
    for d, t in enumerate(raw):
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup[d] = len(lines) - len(set(lines))
    triples, tb = B.shingle_hashes(words, bounds, 3)
    doc = np.repeat(np.arange(len(raw)), np.diff(tb))
    key = triples + B.splitmix(len(raw), 5)[doc]
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(words) + 3, dtype=np.int64)
    if len(again):
        at = np.searchsorted(again, key)
        hit = again[np.minimum(at, len(again) - 1)] == key
        first = np.arange(len(key))[hit] - tb[doc[hit]] + bounds[doc[hit]]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + 3, -1)
    repeat = B.sums(np.cumsum(covered)[: len(words)] > 0, bounds)
    return words, bounds, {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def _features(rows: DataFrame) -> DataFrame:
    """label, fold, features of labelled rows (few: the bounded sample)."""

    def run(batches):
        for part in B.pieces(batches, "text"):
            buf, off = B.text_buffer(part.column(2))
            starts, ends, bounds = B.word_spans(buf, off)
            words = _ROLLER.spans(_ROLLER.prefix(buf), starts, ends)
            rows = [([], []) for _ in range(part.num_rows)]
            for slots, b in _families(buf, off, words, bounds):
                for d, (index, value) in enumerate(rows):
                    s, c = np.unique(slots[b[d] : b[d + 1]], return_counts=True)
                    index += s.tolist()
                    value += (c / max(1, b[d + 1] - b[d])).tolist()
            sparse = [{"type": 0, "size": 3 * SLOTS, "indices": i, "values": v} for i, v in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sparse, _SPARSE)], names=["label", "fold", "features"])

    return rows.mapInArrow(run, "label double, fold int, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, label: str = "quality") -> QualityModel:
    some = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), F.length("text"))).alias("r")).select("doc_id", "r.*")
    data = materialise(_features(rows.select("label", fold.alias("fold"), "text")), "quality-sample", "few", _SAMPLE)
    seen = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zero = np.zeros(3 * SLOTS)
    if len(seen) < 2:
        return QualityModel(zero, 0.0, 0.0, -30.0 if 0.0 in seen else 30.0)
    classifier = LogisticRegression(maxIter=40, regParam=2e-3, aggregationDepth=2, maxBlockSizeInMB=16)
    train = data.filter("fold > 0")
    if train.select("label").distinct().count() < 2:
        train = data
    m = classifier.fit(train)
    model = QualityModel(m.coefficients.toArray(), m.intercept, 1.0, 0.0)
    margin = vector_to_array("rawPrediction")[1]
    aside = m.transform(data.filter("fold = 0")).select("label", array_to_vector(F.array(margin)).alias("features"))
    if aside.select("label").distinct().count() == 2:
        platt = LogisticRegression(maxIter=30, regParam=1e-3, standardization=False).fit(aside)
        model.slope, model.shift = float(platt.coefficients[0]), platt.intercept
    return model


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def judge(docs: DataFrame, model: QualityModel, accept: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns `keep`, base counts, base_failed, kept, probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col("text").alias("_rl_text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_text").dtypes), SCHEMA])

    def run(batches):
        m = shared.value
        for part in B.pieces(batches, "_rl_text"):
            texts = part.column(part.num_columns - 1)
            buf, off = B.text_buffer(texts)
            words, bounds, base = base_counts(buf, off, B.byte_rows(texts))
            margin = np.full(part.num_rows, m.intercept)
            for slots, b in _families(buf, off, words, bounds):
                margin += B.sums(m.weights[slots], b) / np.maximum(np.diff(b), 1)
            p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -50, 50)))
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            cols = [*base.values(), failed, ~failed & (p >= accept), p]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, cols)], names=[*part.schema.names[:-1], *(x.split()[0] for x in SCHEMA.split(", "))])

    return kept.mapInArrow(run, schema)
