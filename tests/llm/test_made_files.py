"""Spelling variants, fill-in-middle and token files against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from rasterloom.llm import infill, spelling, tokenfile
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, word string, node string"
ODD = ["", None, " ", "a", "\n", "\n\nx", "no end", "a\nb\n", "<P>x\ny", "x<M", "<S\n>y\nz\n", "é\n你好\r\n\x85 \x1c", "line\n" * 3000, "z" * 50_000]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "e", "f") for i, t in enumerate(texts)], DOCS)


def _real(n=80):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '/root/testdata/sf0.001/documents.parquet' limit {n}").fetchall()]


# spelling variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(counts, times=10):
    near = {w: [o for o in counts if _near(w, o)] for w in counts}
    form = {w: f for w, ns in near.items() if ns and counts[f := min(ns, key=lambda o: (-counts[o], o))] >= times * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


@pytest.mark.parametrize("trie_chars", [48, 3])
def test_spelling_groups(spark, trie_chars):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(260)} | {"a" * k for k in range(1, 12)}
    counts = {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in sorted(words)}
    long = "".join(rng.choice("abcdefg") for _ in range(70))
    counts |= {long: 40, long[:30] + long[31:]: 3, long[:5] + "é" + long[6:]: 4, long + "x": 400, long[::-1]: 1, long[:49]: 7, long[:48]: 70, long[:47]: 700}
    found = spelling.group(spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long"), trie_chars=trie_chars)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == _grouped(counts)


def test_spelling_survives_hash_clashes(spark, monkeypatch):
    # many prefixes share a node: more candidates, the same pairs
    clash = lambda chars: spelling.F.pmod(spelling.F.xxhash64(spelling.F.substring(spelling.F.col("s"), spelling.F.lit(1), chars.cast("int")), spelling.F.col("reversed")), spelling.F.lit(7))
    monkeypatch.setattr(spelling, "_node", clash)
    rng = random.Random(6)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))): rng.randint(1, 90) for _ in range(40)}
    found = spelling.group(spark.createDataFrame([*counts.items()], "word string, n long"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == _grouped(counts)


def test_spelling_counts(spark):
    texts = [*ODD, *_real(), "Letters LETTERS letters×÷ ÀÉletters éÉ" * 3, "x1seven_sevenly", "seven" * 3000]
    counts = {}
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.count_words(_docs(spark, texts)).collect()} == want
    assert len(want) > 50
    assert spelling.group(spelling.count_words(_docs(spark, []))).count() == 0
    with pytest.raises(ValueError):
        spelling.group(spelling.count_words(_docs(spark, [])), times=1)


# fill-in-middle


def _plain_fim(i, text, seed=7, fim=100, spm=50):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    s = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not t or any(x in t for x in infill.SENTINELS) or h[2] % 100 >= fim:
        return len(lines), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("fim", [100, 40])
def test_fill_in_middle(spark, fim):
    texts = [*ODD, *_real()] * 2
    rows = infill.transform(_docs(spark, texts), fim_percent=fim).withColumn("back", infill.restored()).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == _plain_fim(i, t, fim=fim)
        assert got[i].back == (t or "")
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert infill.transform(_docs(spark, [])).count() == 0


def test_fill_in_middle_checks_sentinels_and_units(spark):
    docs = _docs(spark, ["ab"])
    for bad in (("", "b", "c"), ("aa", "a", "c"), ("ab", "ba", "c"), ("x", "x", "y"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            infill.transform(docs, sentinels=bad)
    with pytest.raises(ValueError):
        infill.cuts(regex.compile("(a)*"), "ab", 0, 0)
    by_char = infill.transform(docs, unit="[ab]").first()
    assert by_char.n == 2


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60_000), max_size=400), st.sampled_from([1, 7, 64]))
def test_blocks_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    whole = len(ids) // block * block
    for group in (ids[:whole].reshape(-1, block), ids[whole:].reshape(1, -1)):
        if group.size:
            raw = tokenfile.encode_blocks(group)
            starts = np.cumsum([0, *map(len, raw)])[:-1].tolist()
            assert [b.tolist() for b in tokenfile.decode_blocks(b"".join(raw), starts)] == group.tolist()


def test_outliers_go_to_the_exception_list():
    ids = np.random.default_rng(1).integers(100, 108, (1, 1024), dtype=np.uint32)
    ids[0, [5, 900]] = (40_000_000, 70_000)
    (raw,) = tokenfile.encode_blocks(ids)
    low, n, extra, width, rest = tokenfile._HEAD.unpack_from(raw)
    assert (low, n, extra, width, rest) == (100, 1024, 2, 3, 3)
    assert len(raw) == tokenfile._HEAD.size + 1024 * 3 // 8 + 2 * (2 + 3)


def test_file_reads_any_document(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(i if i % 5 else None, rng.integers(0, 50_257, int(n), dtype=np.uint32)) for i, n in enumerate(rng.integers(0, 5000, 60))]
    writer = tokenfile.FileWriter(str(tmp_path / "a.ids"), block=100, held=3)
    for doc, ids in docs:
        writer.add(doc, ids)
    path, n, total, size = writer.close()
    assert (n, total, size) == (60, sum(len(i) for _, i in docs), (tmp_path / "a.ids").stat().st_size)
    reader = tokenfile.FileReader(path)
    for i in (59, 0, 17, 30):
        assert reader.document(i).tolist() == docs[i][1].tolist()
    assert [(d, i.tolist()) for d, _, i in reader.documents(most=700)] == [(d, i.tolist()) for d, i in docs]
    raw = bytearray((tmp_path / "a.ids").read_bytes())
    raw[-tokenfile._TAIL.size - 3] ^= 1
    (tmp_path / "b.ids").write_bytes(raw)
    with pytest.raises(ValueError):
        tokenfile.FileReader(str(tmp_path / "b.ids"))


def _tokenizer():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    ENCODER = tokenfile.Encoder(f.read())
WHOLE = _tokenizer()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab  \n\t'sé1.,  \x1c\x85你<|>")), max_size=30), max_size=4))
def test_matches_encode_like_whole_texts(texts):
    want = [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in ENCODER.encode(texts)] == want


def test_token_files(spark):
    texts = [*ODD, *_real(), "<|endoftext|> x", "a" * 70 + " b", " lead", "x  y   z \n q "]
    rows = [(7 * i % 1000, t) for i, t in enumerate(texts)] + [(None, "none"), (3, "tie"), (3, "tie"), (3, "knot")]
    docs = spark.createDataFrame([(*r, "e", "f") for r in rows], DOCS)
    manifest = tokenfile.write_ids(docs, P.path("byte_bpe_50k.json"), 2, file_ids=3000)
    got = tokenfile.read_ids(manifest).orderBy("start").collect()
    assert manifest.count() > 4
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    ids = lambda t: [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]
    found = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got)
    assert found == sorted((d is not None, d or 0, ids(t)) for d, t in rows)
    none = tokenfile.write_ids(_docs(spark, []), P.path("byte_bpe_50k.json"), 2)
    assert tokenfile.read_ids(none).count() == 0


def test_latin_pattern_is_the_pattern():
    every = [chr(c) for c in range(0x250) if tokenfile._is_latin(chr(c))]
    assert all(tokenfile._is_latin(chr(c)) == (not tokenfile._BEYOND_LATIN.search(chr(c))) for c in range(0x300))
    text = "".join(f"{c}a{c}{c}1 {c}'{c}" for c in every)
    assert tokenfile._SPLIT_LATIN(text) == tokenfile._SPLIT(text) == regex.findall(P.PATTERN, text) and len(every) > 570


def test_other_tokenizers_get_whole_texts():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    assert not encoder.by_match
    assert len(np.frombuffer(encoder.encode(["Two words"])[0], "<u4")) == 2


def test_encoder_starts_no_threads():
    """A worker's encoder stays on its task's core; in a process of its own, where no threads were started before."""
    code = """
import os
from rasterloom.llm import tokenfile
with open({!r}, encoding="utf-8") as f:
    encoder = tokenfile._encoder(type("Shared", (), {{"value": f.read()}}))
n = len(os.listdir("/proc/self/task"))
encoder.encode([f"word{{i}} x{{i}}y" for i in range(20_000)])
assert len(os.listdir("/proc/self/task")) == n
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    subprocess.run([sys.executable, "-c", code.format(P.path("byte_bpe_50k.json"))], check=True, env=env, timeout=60)
