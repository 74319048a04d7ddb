"""Toxicity by maximal scoring segments over token log-odds.

Tokens are runs of ASCII letters and non-ASCII characters, A-Z lower-cased;
longer ones also stand for their stems, the first 4, 6 and 8 bytes.  Log-odds
of words and stems between toxic and clean labelled texts (each counted once a
text, so that what one text repeats isn't telling), under an informative
Dirichlet prior (the pooled frequencies, with `prior` times as many
pseudo-tokens as tokens), are drawn towards 0 by `confidence` standard errors
and bounded below by -`floor`; both signs count.  A token has the best score
of its word and stems; one that was not seen, or too seldom to tell its sign,
costs `DRIFT`.  A linear-time scan (Ruzzo and Tompa) over all tokens finds all
maximal scoring segments; extreme-value statistics (Karlin and Altschul:
lambda from the clean score distribution, K from clean texts) say how unlikely
a segment's score is in a clean text of that length.  A text's evidence, its
best segment's and the sum over all significant ones, becomes a probability by
logistic calibration: each labelled row is scored by counts of the other folds
only.  `tune` compares settings in the same way, on rows to learn from alone.

Learning uses at most `sample_rows` labelled rows (the smallest hashes of
doc_id).  Edge cases: a null text is empty and gets the probability of a text
without evidence; without labels of both classes no token scores and every
probability is the share of toxic labels (0 without labels); conflicting or
repeated labels of an id count as toxic, once; rows with a null doc_id are
scored but not learned from; repeated rows are scored again; empty tables give
no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import materialise

_BREAK = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_U = np.uint64
_ROLLER = B.Roller(23)
DRIFT = 0.1
PRIOR, CONFIDENCE, FLOOR = 0.5, 2.0, 0.3  # the best of eleven settings by log loss on folds of the rows to learn from (`tune`)
LEAST_COUNT = 4
FOLDS = 3
STEMS = (4, 6, 8)
SCAN_BYTES = 256 << 10  # of text that a task scans at once
BINS_PER_UNIT = 10


@dataclass
class ToxicityModel:
    tokens: np.ndarray  # sorted hashes of the tokens with a score
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    coefficients: tuple[float, float]
    intercept: float

    def __post_init__(self):
        self.screen = np.zeros(1 << 20, dtype=bool)
        self.screen[(self.tokens >> _U(44)).astype(np.int64)] = True

    def score(self, forms: list[np.ndarray]) -> np.ndarray:
        """Each token's score, given its word and stems."""
        score = np.full(len(forms[0]), -np.inf)
        for tokens in forms:
            at = np.flatnonzero(self.screen[(tokens >> _U(44)).astype(np.int64)])
            if len(at):
                where = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
                same = self.tokens[where] == tokens[at]
                score[at[same]] = np.maximum(score[at[same]], self.scores[where[same]])
        return np.where(np.isinf(score), -self.drift, score)

    def evidence(self, score: float, n_tokens: int) -> float:
        """-ln of the expected number of such segments in a clean text: above 0, unlikely."""
        return self.lam * score - np.log(max(self.k * max(n_tokens, 1), 1e-12))


def maximal(at: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past-last token, score), in linear time.

    `at` are the positions of the tokens with a positive score, `before` and
    `after` the sums of all scores up to each of them, without and with it.
    """
    found: list[list] = []  # [first, past last, sum before, sum after, index of the nearest earlier one with a smaller sum before]
    for p, b, a in zip(at, before, after, strict=True):
        new = [p, p + 1, b, a, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence of token scores of both signs."""
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    return maximal(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist())


def _tokens(texts: pa.Array):
    buf, off = B.text_buffer(texts)
    buf = _LOWER[buf]
    starts, ends, bounds = B.word_spans(buf, off, _BREAK)
    prefix = _ROLLER.prefix(buf)
    forms = [_ROLLER.spans(prefix, starts, ends)]
    for i, n in enumerate(STEMS):
        stem = _ROLLER.spans(prefix, starts, np.minimum(ends, starts + n)) + B.splitmix(i + 1, 31)[i]
        stem[ends - starts <= n] = 0
        forms.append(stem)
    return buf, off, starts, ends, bounds, forms


def _counts(rows: DataFrame) -> DataFrame:
    """Toxic and clean rows (toxic int, fold int, text string) with each token, by fold."""

    def run(batches):
        for part in B.pieces(batches, "text"):
            *_, bounds, forms = _tokens(part.column(2))
            toxic, fold = np.asarray(part.column(0)), np.asarray(part.column(1))
            for k in range(FOLDS):
                own = np.repeat(fold == k, np.diff(bounds))
                text = np.tile(np.repeat(np.arange(part.num_rows), np.diff(bounds))[own], len(forms))
                tokens = np.concatenate([f[own] for f in forms])
                order = np.lexsort((text, tokens))
                text, tokens = text[order], tokens[order]
                first = tokens != 0
                first[1:] &= (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
                kinds, inv = np.unique(tokens[first], return_inverse=True)
                n_bad = np.bincount(inv, weights=toxic[text[first]] == 1, minlength=len(kinds)).astype(np.int64)
                n_all = np.bincount(inv, minlength=len(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.full(len(kinds), k, np.int32)), pa.array(n_bad), pa.array(n_all - n_bad)], names=["token", "fold", "bad", "good"])

    return B.bounded(rows).mapInArrow(run, "token long, fold int, bad long, good long").groupBy("token", "fold").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _by_token(counts: DataFrame) -> DataFrame:
    """A row a token: bad0, good0 and so on, its counts by fold."""
    return counts.groupBy("token").agg(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("bad", "good")])


def _told(by_token: DataFrame, prior: float, confidence: float, floor: float, left_out: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fold left out (None: none is), the tokens whose sign is told by the counts of the others, and their scores.

    All are found in one pass; at most those seen LEAST_COUNT times, n_all / LEAST_COUNT of the bounded sample.
    """
    total = by_token.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by_token.columns[1:]]).first()
    parts = []
    for i, out in enumerate(left_out):
        folds = [k for k in range(FOLDS) if k != out]
        n_bad, n_good = (sum(total[f"{c}{k}"] for k in folds) for c in ("bad", "good"))
        bad, good = (reduce(add, [F.col(f"{c}{k}") for k in folds]) for c in ("bad", "good"))
        a, pseudo = F.nullif(bad + good, F.lit(0)) * prior, float(n_bad + n_good) * prior
        odds = lambda y, n, a=a, pseudo=pseudo: F.log((y + a) / (float(n) + pseudo - y - a))
        z, e = odds(bad, n_bad) - odds(good, n_good), confidence * F.sqrt(1 / (bad + a) + 1 / (good + a))
        score = F.when((bad >= LEAST_COUNT) & (z > e), z - e).when((good >= LEAST_COUNT) & (z < -e), F.greatest(z + e, F.lit(-floor)))
        parts.append((score if n_bad and n_good else F.lit(None).cast("double")).alias(f"score{i}"))
    rated = by_token.select("token", *parts)
    picked = rated.filter(" or ".join(f"{c} is not null" for c in rated.columns[1:])).toArrow()
    tokens = np.asarray(picked.column("token").combine_chunks()).view(np.uint64)
    order, found = np.argsort(tokens), []
    for c in rated.columns[1:]:
        scores = picked.column(c).combine_chunks()
        own = order[scores.is_valid().to_numpy(zero_copy_only=False)[order]]
        found.append((tokens[own], np.asarray(scores.take(pa.array(own)))))
    return found


def _scoring_tokens(counts: DataFrame, prior: float, confidence: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose sign is told, by all counts (token, fold, bad, good) given, and their scores."""
    return _told(_by_token(counts), prior, confidence, floor, (None,))[0]


def _by_fold(part: pa.RecordBatch, models: list[ToxicityModel]):
    """The rows of each fold with the model that has not seen them."""
    fold = np.asarray(part.column(1))
    for k, m in enumerate(models):
        own = np.flatnonzero(fold == k)
        if len(own):
            yield m, part.take(pa.array(own))


def _histogram(rows: DataFrame, models: list[ToxicityModel]) -> DataFrame:
    """How often tokens of the rows (toxic, fold, text) have a score, by bin."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for piece in B.pieces(batches, "text", SCAN_BYTES):
            for m, part in _by_fold(piece, shared.value):
                *_, forms = _tokens(part.column(2))
                bins, n = np.unique(np.ceil(m.score(forms) * BINS_PER_UNIT).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    return B.bounded(rows).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def _scan(texts: pa.Array, model: ToxicityModel):
    """Per text: tokens, starts and ends in bytes, segments."""
    buf, off, starts, ends, bounds, forms = _tokens(texts)
    score = model.score(forms)
    total, at = np.cumsum(score), np.flatnonzero(score > 0)
    lo = np.searchsorted(at, bounds)
    for d in range(len(texts)):
        own = at[lo[d] : lo[d + 1]]
        n = int(bounds[d + 1] - bounds[d])
        found = maximal((own - bounds[d]).tolist(), (total[own] - score[own]).tolist(), total[own].tolist())
        yield n, found, buf, off[d], starts[bounds[d] : bounds[d + 1]], ends[bounds[d] : bounds[d + 1]]


def _evidence(model: ToxicityModel, n: int, found: list) -> tuple[float, float]:
    """-ln of the chance that a clean text has as good a best segment (0 without segments), and the sum over significant ones."""
    each = [model.evidence(s, n) for *_, s in found]
    best = -np.log(-np.expm1(-np.exp(-np.clip(max(each), -5, 30)))) if each else 0.0
    return float(best), float(min(sum(max(e, 0.0) for e in each), 120.0))


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int, label: str) -> DataFrame:
    """toxic, fold, text of the labelled rows to learn from, written."""
    some = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    # a text that was copied counts once, so that copies of one text don't make its words telling
    return materialise(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", fold, "text"), "toxicity-sample", "few")


def _calibrated(rows: DataFrame, by_token: DataFrame, prior: float, confidence: float, floor: float) -> tuple[ToxicityModel, DataFrame, object]:
    """(the model, evidence of the rows by the other folds' models, the calibration)."""
    told = _told(by_token, prior, confidence, floor, (None, *range(FOLDS)))
    model, *others = [ToxicityModel(*t, DRIFT, 1.0, 1.0, (0.0, 0.0), 0.0) for t in told]
    bins = {r.bin: r.n for r in _histogram(rows.filter("toxic = 0"), others).collect()}
    rates = np.array(list(bins.values()), dtype=float) / max(sum(bins.values()), 1)
    lam = _lambda(np.array(list(bins)) / BINS_PER_UNIT, rates)
    for m in (model, *others):
        m.lam = lam
    # K: so that clean texts have the expected number of segments at the score that one in ten of them reaches
    clean = statistics(rows, others).filter("toxic = 0 and n > 0").agg(F.percentile_approx(F.col("best") * lam - F.log("n"), 0.9, 10_000).alias("q")).first()
    k = float(np.exp(np.clip(clean.q if clean.q is not None else 0.0, -30, 30)) * 0.105)
    for m in (model, *others):
        m.k = k
    data = statistics(rows, others).select(F.col("toxic").cast("double").alias("label"), array_to_vector(F.array("evidence", "total")).alias("features"))
    data = materialise(data, "toxicity-calibration", "few")
    return model, data, LogisticRegression(maxIter=60, regParam=1e-4, lowerBoundsOnCoefficients=Matrices.dense(1, 2, [0.0, 0.0])).fit(data)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, prior: float = PRIOR, confidence: float = CONFIDENCE, floor: float = FLOOR, label: str = "toxic") -> ToxicityModel:
    """Learn from `labels` (doc_id, toxic 0/1) and the texts of those documents."""
    rows = _sample(docs, labels, sample_rows, label)
    shares = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_rows = sum(shares.values())
    share = shares.get(1, 0) / n_rows if n_rows else 0.0
    if len(shares) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), DRIFT, 1.0, 1.0, (0.0, 0.0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    counts = materialise(_by_token(_counts(rows)), "toxicity-counts", "fewer")
    model, _, fitted = _calibrated(rows, counts, prior, confidence, floor)
    model.coefficients, model.intercept = tuple(map(float, fitted.coefficients)), fitted.intercept
    return model


def tune(docs: DataFrame, labels: DataFrame, settings: list[tuple[float, float, float]], sample_rows: int = 16_000, label: str = "toxic") -> list[tuple]:
    """For each (prior, confidence, floor): log loss, share of toxic rows found, of clean rows rejected, each row by the other folds' model."""
    rows = _sample(docs, labels, sample_rows, label)
    counts, out = materialise(_by_token(_counts(rows)), "toxicity-counts", "fewer"), []
    for setting in settings:
        _, data, fitted = _calibrated(rows, counts, *setting)
        p = vector_to_array("probability")[1]
        truth = F.col("label") == 1
        loss = -F.avg(F.log(F.greatest(F.when(truth, p).otherwise(1 - p), F.lit(1e-9))))
        out.append((setting, *fitted.transform(data).agg(loss, F.avg(F.when(truth, (p >= 0.5).cast("double"))), F.avg(F.when(~truth, (p >= 0.5).cast("double")))).first()))
    return out


def _lambda(scores: np.ndarray, rates: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1 over a clean text's token scores."""
    if not len(scores) or (rates * scores).sum() >= 0:
        return 0.05
    f = lambda x: (rates * np.exp(x * scores)).sum() - 1
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def statistics(rows: DataFrame, models: list[ToxicityModel]) -> DataFrame:
    """toxic, number of tokens, best score and the evidence of rows (toxic, fold, text), each by its fold's model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for piece in B.pieces(batches, "text", SCAN_BYTES):
            for m, part in _by_fold(piece, shared.value):
                out = [(n, max((s for *_, s in found), default=0.0), *_evidence(m, n, found)) for n, found, *_ in _scan(part.column(2), m)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*out, strict=True))], names=["toxic", "n", "best", "evidence", "total"])

    return B.bounded(rows).mapInArrow(run, "toxic int, n long, best double, evidence double, total double")


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), passages: bool = False) -> DataFrame:
    """Per row: the columns `keep`, score, predicted.

    With `passages`, also the significant toxic passages (start and end in
    code points, end exclusive, and evidence).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, name, at = B.with_text(docs, keep)
    spans = "passages array<struct<start:long,end:long,evidence:double>>"
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_text").dtypes), "score double, predicted int", *[spans] * passages])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        m = shared.value
        for part in B.pieces(batches, name, SCAN_BYTES):
            p, where = np.zeros(part.num_rows), []
            for d, (n, found, buf, base, starts, ends) in enumerate(_scan(part.column(at), m)):
                best, total = _evidence(m, n, found)
                p[d] = 1 / (1 + np.exp(-np.clip(m.coefficients[0] * best + m.coefficients[1] * total + m.intercept, -50, 50)))
                if passages:
                    chars = lambda b, base=base: int(((buf[base:b] & 0xC0) != 0x80).sum())
                    where.append([{"start": chars(starts[a]), "end": chars(ends[b - 1]), "evidence": e} for a, b, s in found if (e := float(m.evidence(s, n))) > 0])
            cols = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))] + [pa.array(where, span_type)] * passages
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *cols], names=[*part.schema.names[: len(keep)], "score", "predicted", *["passages"] * passages])

    return B.bounded(kept).mapInArrow(run, schema)
