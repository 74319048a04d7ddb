"""Near-duplicates, repeated passages, URL filter and the pipeline against plain versions."""

import hashlib
import os
import random
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from rasterloom.llm import bpe, decontaminate, neardup, queries, repeats, secrets, urlfilter

from tests.llm.test_text_ops import ODD, _docs, _plain_hits

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _set(text, width):
    w = (text or "").encode().translate(LOW).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def _plain_components(rows, width, percent):
    sets = [_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def _family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(words[:60])
    texts = ODD + _family(rng, words, 40, 4) + _family(rng, words, 25, 12) + [f"{common} x{i} y{i} z{i}" for i in range(12)]
    texts += [texts[12].upper(), texts[12] + "\n", texts[12], "a b", "A  b", "b a"] + [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    rows = list(enumerate(texts)) + [(3, "a"), (None, texts[14]), (None, "lone words only here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    want = _plain_components(rows, width, percent)
    got = neardup.near_duplicates(docs, width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(docs.limit(0), width, percent).count() == 0


def test_sequential_limits_keep_similar_pairs():
    for percent in (80, 85, 95):
        bands, rows = neardup.plan(percent, 1e-6)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6 and bands * rows <= neardup.SIGNATURE
        limits = neardup.least_matches(percent, 1e-6)
        assert limits == sorted(limits) and limits[-1] < percent / 100 * neardup.SIGNATURE


def _plain_cut(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + size] for b in raw for s in range(len(b) - size + 1))
    out = []
    for (doc, _), b in zip(rows, raw, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s : s + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    p, q = text(450), text(199)
    base = text(1500)
    edited = [base[:k] + "#" + base[k + 1 :] for k in (100, 300, 301, 700, 1400)]
    texts = ODD + [text(300) + p + text(90), p, text(20) + p[:260] + text(20), text(80) + p[120:] + text(1), q + text(50), text(50) + q, base, *edited, base[400:900], base[300:499]]
    texts += ["same" * 100, "same" * 100, "z" * 900, "ab" * 150, "abc" * 70 + text(10), text(700) * 2, p + "x" + p, text(200), text(199)]
    rows = list(enumerate(texts)) + [(None, texts[11]), (None, "short"), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = repeats.repeated_passages(docs)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == _plain_cut(rows, 200)
    assert got.filter("n_removed <> coalesce(aggregate(spans, 0L, (s, x) -> s + x.end - x.start), 0)").count() == 0
    assert repeats.repeated_passages(docs.limit(0)).count() == 0
    small = repeats.repeated_passages(docs.repartition(3), threshold=90, digit=30, chunk_bytes=70, most_bytes=90).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in small.collect()), key=str) == _plain_cut(rows, 90)
    plan = repeats._Digits
    assert plan(200, 100, 1 << 29, 8).bits == [35, 61] and plan(200, 100, 1 << 40, 18).bits == [46, 64, 64]
    class Wide(plan):  # a third pass, as for very many suffixes
        def __init__(self, *a):
            super().__init__(*a)
            self.bits.append(64)

    monkeypatch.setattr(repeats, "_Digits", Wide)
    thrice = repeats.repeated_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in thrice.collect()), key=str) == _plain_cut(rows, 200)


def test_packed_numbers():
    rng = random.Random(1)
    import numpy as np

    for values in ([0], [5, 5, 5], sorted(rng.getrandbits(64) for _ in range(999)), [2**64 - 1], [0, 2**63, 2**64 - 1]):
        a = np.array(values, dtype=np.uint64)
        assert (repeats.unpack(repeats.pack(a)) == a).all()


def test_url_parts_rules_and_sql(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.NET/en/x?q", "x://example.net/en", "http://net", "http://a.net#f/", "http://badnet/", "http://org/fr/1", "http://b.org/fr",
        "http://example.com/de/1", "http://www.example.com/de/2.html", "http://example.com/en/3", "http://É.com/de/4://x", "http://h.com/a/b/c/d/e/f", "http://h.com//a/",
    ]
    urls += [f"http://m.example.com/{lang}/{i}" for lang in ("de", "en") for i in range(12)] + [f"http://big.com/s{i}/t" for i in range(40)] + ["http://big.com/s1/t"] * 3
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    want = {3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.net", "/en", "net/", "block"), 5: ("net", "", None, "allow"), 6: ("a.net", "", None, "allow"), 7: ("badnet", "/", None, "allow"), 8: ("org", "/fr/1", "org/fr/", "allow"), 9: ("b.org", "/fr", None, "allow"), 10: ("example.com", "/de/1", "example.com/de/", "block"), 13: ("É.com", "/de/4://x", None, "allow")}
    for i in (0, 1, 2):
        want[i] = ("", "", None, "allow")
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == w, urls[i]
    assert got[14].template == "/=a/=b/=c/=d/=e/=f" and got[60].template.startswith("/*")
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    sql = {r[0]: tuple(r[1:]) for r in db.execute(f"select page_id, host, path, rule, verdict, template from ({urlfilter.oracle()})").fetchall()}
    assert sql == {i: (r.host, r.path, r.rule, r.verdict, r.template) for i, r in got.items()}
    assert urlfilter.judge(pages.limit(0)).count() == 0


def _judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urlfilter.judge(pages, rules=rules).collect()
    db = duckdb.connect()
    db.execute("create table pages as select page_id, url from (select unnest(?) as page_id, unnest(?) as url)", [list(range(len(urls))), urls])
    sql = db.execute(f"select page_id, verdict, template from ({urlfilter.oracle(rules)})").fetchall()
    assert {r[0]: r[1:] for r in sql} == {r.page_id: (r.verdict, r.template) for r in rows}
    return {urls[r.page_id]: r for r in rows}


def _tree(host):
    """Per host: one branch all labelled, two alike that are labelled in part, others of another shape, labels or support."""
    tag = [f"http://{host}/{s}/p{i:02d}/{k}" for s in ("tag", "topic") for i in range(24) for k in range(3)]
    lone = [f"http://{host}/{s}/p{i:02d}/{k}" for s in ("wiki", "free") for i in range(24) for k in range(3)]
    flat = [f"http://{host}/de/{i}" for i in range(60)] + [f"http://{host}/en/{i}" for i in range(60)] + [f"http://{host}/deep/{i:02d}/a/b/c/d/{i % 2}" for i in range(8)]
    rules = {f"{host}/de/": "block", f"{host}/wiki/": "allow"}
    rules |= {f"{host}/{s}/p{i:02d}/": "block" for s in ("tag", "topic") for i in range(12)}
    return tag + lone + flat, rules


def test_templates_merge_and_reject_on_evidence(spark):
    urls, rules = _tree("h.org")
    got = _judged(spark, urls, rules)
    # two branches alike in shape and labels are one, and half of its paths, all blocked, speak for the rest
    assert got["http://h.org/tag/p19/1"].template == got["http://h.org/topic/p18/2"].template
    assert got["http://h.org/tag/p19/1"].template.startswith("/~")
    assert {got[f"http://h.org/{s}/p{i:02d}/{k}"].verdict for s in ("tag", "topic") for i in range(12, 24) for k in range(3)} == {"block"}
    # no label reaches a branch about which nothing is known, of whatever shape
    assert got["http://h.org/en/7"].verdict == "allow" and got["http://h.org/en/7"].template == "/=en/*"
    assert got["http://h.org/de/7"].template == "/=de/*" and got["http://h.org/de/7"].verdict == "block"
    assert got["http://h.org/free/p01/1"].verdict == "allow" and got["http://h.org/wiki/p01/1"].template.startswith("/=wiki/")
    # down to the last segment
    assert got["http://h.org/deep/03/a/b/c/d/1"].template == "/=deep/*/=a/=b/=c/=d/*"


def test_verdicts_are_stable_under_repetition(spark):
    """Pages that are there ten times, and ten more hosts of the same form, change no verdict."""
    urls, rules = _tree("h.org")
    once = {u: (r.verdict, r.template) for u, r in _judged(spark, urls, rules).items()}
    many, more = list(urls) * 10, {}
    for i in range(10):
        u, r = _tree(f"h{i}.org")
        many += u
        more |= r
    pages = spark.createDataFrame(list(enumerate(many)), "page_id long, url string")
    rows = urlfilter.judge(pages, rules=rules | more).collect()
    assert {many[r.page_id]: (r.verdict, r.template) for r in rows if r.host == "h.org"} == once
    for i in range(10):
        assert {many[r.page_id].replace(f"h{i}.org", "h.org"): (r.verdict, r.template) for r in rows if r.host == f"h{i}.org"} == once


def test_production_rules(spark):
    """What the rules decide, and that the pages of a host whose one language is blocked are not blocked with it."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    judged = urlfilter.judge(pages).cache()
    said = {(r.by, r.verdict): r.pages for r in urlfilter.decisions(judged).collect()}
    assert sum(said.values()) == pages.count() and {v for by, v in said if by != "template"} == {"allow", "block"}
    free = judged.filter("rule is null and verdict = 'block'").select("host", "template").distinct().collect()
    assert not [r for r in free if r.template.startswith("/=en")]


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_bpe"]
    docs, at = spark.read.parquet(f"{SF}/documents.parquet"), {}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = _plain_components([(d, r.text) for d, r in at["toxicity"].items()], 5, 80)
    assert set(at["minhash_near_dedup"]) == {d for d, _, c in kept if d == c}
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    some = list(at["minhash_near_dedup"])[:40]
    for d in some:
        assert (d in at["benchmark_decontamination"]) == (_plain_hits(before[d].text, items)[1] == 0)
    for d, r in at["secret_scans"].items():
        spans = secrets.find(before[d].text)
        assert r.text == secrets.redact(before[d].text, spans) and r.n_chars == len(r.text)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for d, r in at["byte_bpe"].items():
        assert list(r.ids) == plain.encode_ordinary(at["secret_scans"][d].text)
    assert set(at["byte_bpe"]) == set(at["benchmark_decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(at["byte_bpe"])


@pytest.mark.parametrize("stage", [corpus_pipeline.remove_contaminated, corpus_pipeline.redact_secrets, corpus_pipeline.tokenize])
def test_stages_bound_arrow_batches(spark, stage):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    rows = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('many words ', 400) as text", "'en' as lang", "'s' as source", "4400L as n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).nbytes])], names=["n"])

    try:
        stage(spark, rows.limit(0), SF)  # 17.6 MB of text in one task; Spark alone makes one batch of it
        found = [r.n for r in rows.select("text").mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 17_000_000 and max(found) < 5_000_000
        spark.conf.set(limit, "1m")
        stage(spark, rows.limit(0), SF)
        assert spark.conf.get(limit) == "1m"  # the user's own limit holds
    finally:
        spark.conf.unset(limit)


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "a b c d e f", "en", "s", 11), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == len(rows)
    empty = docs.limit(0)
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert empty.count() == 0 and all(stage(spark, none, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_small_sql_agrees(spark):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        cur = db.execute(sql)
        columns = [d[0] for d in cur.description]
        got = queries.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(cur.fetchall(), key=str), name


def test_decontamination_is_words_only():
    assert decontaminate.words_of("Don't É-x_y".encode()) == [b"don", b"t", "É".encode(), b"x", b"y"]
    assert os.path.exists(public_tokenizers.path("byte_bpe_50k.tiktoken"))
