"""Quality, toxicity and language ID: exact base counts, held-out accuracy, odd rows."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from rasterloom.llm import langid, quality, queries, toxicity

from tests.llm.test_text_ops import ODD, _docs, _real

SF = "/root/testdata/sf0.01"
SPACES = re.compile("[^\x20\x09-\x0d]+")


def _base(t):
    t = t or ""
    words = SPACES.findall(t)
    lines = [x for x in t.split("\n") if SPACES.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts_and_odd_rows(spark):
    texts = ODD + _real(60) + ["a b c a b c d", "x\n x\nx\n\n \nx", "a a a a", "é#é # *", "a\x1cb c"] * 2
    model = quality.QualityModel(np.zeros(3 * quality.SLOTS), 0.0, 1.0, 1.0)
    for r in quality.judge(_docs(spark, texts), model).collect():
        want = _base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(texts[r.doc_id])[:60]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.fit(_docs(spark, texts), empty)
    assert quality.judge(_docs(spark, []), m).count() == 0 and quality.judge(_docs(spark, texts), m).filter("kept").count() > 0


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("aside", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
    got = quality.judge(docs, quality.fit(docs, labels.filter("not aside"))).withColumnRenamed("quality", "p").join(labels, "doc_id").filter("aside")
    right = got.filter("(p >= 0.5) = (quality = 1)").count()
    assert right >= 0.95 * got.count()


def _plain_segments(scores):
    """All maximal scoring segments by recursion on the best one."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1]))
    _, _, i, j = best
    return _plain_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in _plain_segments(scores[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 24))
        s = [float(rng.choice([1.37, 2.11, 3.73])) * (1 + 0.01 * rng.random()) if rng.random() < 0.3 else -float(rng.choice([0.11, 1.0, 1.7])) for _ in range(n)]
        got = [(a, b) for a, b, _ in toxicity.segments(np.array(s))]
        assert got == _plain_segments(s)


def test_toxicity_held_out_and_odd_rows(spark):
    got = queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 0.1 * counts[0, 0] and counts.get((1, 1), 0) >= counts.get((1, 0), 0)
    docs = _docs(spark, ODD)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).filter("score between 0 and 1 and predicted = 0").count() == len(ODD)
    train = [(i, f"calm word{i} text " * 9 + ("é awful vile" if i % 3 == 0 else "fine"), int(i % 3 == 0)) for i in range(300)]
    rows = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    m = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    out = toxicity.score(_docs(spark, ["ü calm text, awful vile.", "calm text"] + ODD), m, passages=True).collect()
    assert out[0].predicted == 1 and out[1].predicted == 0
    assert [(p.start, p.end) for p in out[0].passages] == [(13, 23)]
    assert toxicity.score(_docs(spark, []), m).count() == 0


def test_language_filters_against_plain_sets():
    """No n-gram of a language is missed, counts are the Bloom filters' own, and the correction brings them near the true ones."""
    rng = np.random.default_rng(1)
    grams = {f"l{i:02d}": rng.choice(1 << 31, 3000, replace=False).astype(np.uint32) for i in range(70)}
    f = langid.LanguageFilters.build(grams)
    assert len(f.slices) == 2 and f.languages == sorted(grams)
    small = langid.LanguageFilters.build(grams, filter_bytes=2 * 8 << 13)
    assert small.bits == 13 and small.false_rate.mean() > f.false_rate.mean()
    text = np.concatenate([grams["l03"][:400], grams["l66"][:100], rng.choice(1 << 31, 500).astype(np.uint32)])
    for g in (f, small):
        bits = [np.zeros(1 << g.bits, bool) for _ in g.languages]
        for j, lang in enumerate(g.languages):
            for x in grams[lang].tolist():
                for m in langid._MULT:
                    bits[j][((x * m) & 0xFFFFFFFF) >> (32 - g.bits)] = True
        slots = [[((x * m) & 0xFFFFFFFF) >> (32 - g.bits) for m in langid._MULT] for x in text.tolist()]
        seen = np.array([sum(all(b[s] for s in ss) for ss in slots) for b in bits], float)
        rate = np.array([b.mean() ** langid.PROBES for b in bits])
        got = g.counts(text, np.array([0, 0, len(text)]))
        assert (got[0] == 0).all() and np.allclose(got[1], np.maximum(seen - len(text) * rate, 0) / (1 - rate))
        assert abs(got[1][3] - 400) < 40 and abs(got[1][66] - 100) < 40 and got[1].argmax() == 3


def test_quality_scores_against_plain_features(spark):
    """Margin and verdict from features counted character by character, with random weights."""
    rng = np.random.default_rng(2)
    texts = ODD + _real(30) + ["été 你好 ab"]
    model = quality.QualityModel(rng.normal(size=3 * quality.SLOTS), 0.1, 1.3, -0.2)
    got = {r.doc_id: r for r in quality.judge(_docs(spark, texts), model, accept=0.4).collect()}
    number = lambda c: int.from_bytes(c.encode(), "little")
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        words = SPACES.findall(t or "")
        slots = [[], [], []]
        for k in (1, 2):
            for j in range(len(words) - k + 1 if len(words) >= k else int(k == 2 and len(words) == 1)):
                part = " ".join(words[j : j + k]).encode()
                buf, off = np.frombuffer(part, np.uint8), np.array([0, len(part)])
                own = list(quality._families(buf, off, *_words(buf, off)))[k - 1]
                slots[k - 1] += own[0].tolist()
        for j in range(len(t or "") - 2):
            a, b, c = (number(x) for x in t[j : j + 3])
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F & 0xFFFFFFFF
            slots[2].append((h >> (32 - quality.BITS)) + 2 * quality.SLOTS)
        margin = 0.1 + sum(model.weights[s].sum() / max(len(s), 1) for s in slots)
        p = 1 / (1 + np.exp(-np.clip(1.3 * margin - 0.2, -50, 50)))
        assert abs(got[i].quality - p) < 1e-9 and got[i].kept == (not got[i].base_failed and got[i].quality >= 0.4), raw[:40]


def _words(buf, off):
    starts, ends, bounds = quality.B.word_spans(buf, off)
    return quality._ROLLER.spans(quality._ROLLER.prefix(buf), starts, ends), bounds


def test_toxicity_scores_against_plain_log_odds(spark):
    """Token scores of both signs, lambda and evidence against the formulas."""
    rows = [("vile word text", 1, i % 3) for i in range(9)] + [("calm word text", 0, i % 3) for i in range(40)] + [("vile calm", 0, 0)]
    counts = toxicity._counts(spark.createDataFrame([(t, f, x) for x, t, f in rows], "toxic int, fold int, text string"))
    prior, confidence, floor = 0.3, 1.5, 0.8
    tokens, scores = toxicity._scoring_tokens(counts, prior, confidence, floor)
    words = {w: [sum(y == s and w in t.split() for t, y, _ in rows) for s in (1, 0)] for w in ("vile", "word", "text", "calm")}
    n = [sum(c[s] for c in words.values()) for s in (0, 1)]
    want = {}
    for w, (bad, good) in words.items():
        a, pseudo = (bad + good) * prior, sum(n) * prior
        z = np.log((bad + a) / (n[0] + pseudo - bad - a)) - np.log((good + a) / (n[1] + pseudo - good - a))
        e = confidence * np.sqrt(1 / (bad + a) + 1 / (good + a))
        if bad >= toxicity.LEAST_COUNT and z > e:
            want[w] = z - e
        elif good >= toxicity.LEAST_COUNT and z < -e:
            want[w] = max(z + e, -floor)
    assert want["vile"] > 0 > want["calm"]
    m = toxicity.ToxicityModel(tokens, scores, toxicity.DRIFT, 0.7, 0.2, (1.0, 0.0), 0.0)
    import pyarrow as pa

    *_, forms = toxicity._tokens(pa.array(["vile unseen calm word"]))
    assert np.allclose(m.score(forms), [want.get(w, -toxicity.DRIFT) for w in ("vile", "unseen", "calm", "word")])
    s, p = np.array([1.5, -0.5, -0.1]), np.array([0.05, 0.45, 0.5])
    lam = toxicity._lambda(s, p)
    assert abs((p * np.exp(lam * s)).sum() - 1) < 1e-9 and lam > 0
    assert abs(m.evidence(3.0, 50) - (0.7 * 3.0 - np.log(0.2 * 50))) < 1e-12


def test_language_held_out_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    f = langid.fit(docs.select("doc_id", "text", "lang"))
    out = {r.doc_id: r for r in langid.predict(_docs(spark, ODD + ["12 34", "é"]), f).collect()}
    assert {out[i].lang_pred for i in (0, 1, 2, 6, 8, 9)} == {"und"} and out[10].lang_pred != "und"
    assert langid.predict(_docs(spark, ["text"]), langid.fit(docs.limit(0))).first().lang_pred == "und"
    many = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 20, f"l{i:03d}") for i in range(70)], "doc_id long, text string, lang string")
    assert langid.predict(many.withColumn("want", F.col("lang")), langid.fit(many), keep=("want",)).filter("want = lang_pred").count() == 70


def test_stages_get_the_text_once(spark):
    """A kept text isn't sent beside itself, and the roller's tables exceed what is asked for by an eighth at most."""
    docs = _docs(spark, ["calm text", None, "a vile word"])
    model = toxicity.ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.1, 1.0, 1.0, (0.0, 0.0), 0.0)
    out = toxicity.score(docs, model, keep=("text", "doc_id"))
    assert "_rl_text" not in str(out._jdf.queryExecution().optimizedPlan()) and out.columns == ["text", "doc_id", "score", "predicted"]
    both = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, model, keep=k).collect()) for k in (("doc_id",), ("text", "doc_id"))]
    assert both[0] == both[1] and {r.text for r in out.collect()} == {"calm text", None, "a vile word"}
    roller = quality.B.Roller(1)
    for n in (1000, 1100, 1200):
        roller.prefix(np.zeros(n, np.uint8))
        assert n < len(roller.up) <= (n + 1) * 9 // 8


def test_folds_are_told_in_one_pass(spark):
    """Each fold left out gives the tokens and scores of the other folds' counts alone; a token of that fold only has none."""
    rows = [("vile word text", 1, i % 3) for i in range(30)] + [("calm word text", 0, i % 3) for i in range(60)] + [("lonely vile", 1, 1)] * 9
    counts = toxicity._counts(spark.createDataFrame([(t, f, x) for x, t, f in rows], "toxic int, fold int, text string"))
    told = toxicity._told(toxicity._by_token(counts), 0.3, 0.5, 0.8, (None, 0, 1, 2))
    assert len(told) == 4 and len(told[0][0]) > len(told[2][0]) > 0
    for k, (tokens, scores) in zip((None, 0, 1, 2), told, strict=True):
        plain = toxicity._scoring_tokens(counts if k is None else counts.filter(f"fold <> {k}"), 0.3, 0.5, 0.8)
        assert np.array_equal(tokens, plain[0]) and np.array_equal(scores, plain[1]) and (np.diff(tokens.astype(float)) >= 0).all()
    one = toxicity._told(toxicity._by_token(counts.filter("fold = 1")), 0.3, 0.5, 0.8, (None, 1))
    assert len(one[0][0]) and not len(one[1][0])
