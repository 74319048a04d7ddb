"""Secrets, BPE, decontamination and WARC against plain versions."""

import base64
import hashlib
import json
import os
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from rasterloom.llm import bpe, decontaminate, secrets, storage, warc

DOCS = "doc_id long, text string, extra string"
ODD = ["", None, " ", "a", "A" * 5000, "été ΑΒΓ 你好　x\x1cy\x85z \x0b\x0c'll <|endoftext|>", "\n\n  \n", "x" * 70 + " y", "0" * 64]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], DOCS)


def _real(n=120):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '/root/testdata/sf0.001/documents.parquet' limit {n}").fetchall()]


VOCAB = P.path("byte_bpe_50k.tiktoken")


def test_bpe_matches_tiktoken_and_round_trips(spark):
    texts = ODD + _real() + ["".join(map(chr, range(i, i + 512))) for i in range(0, 0xD800, 512)]
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(VOCAB), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(_docs(spark, texts), VOCAB, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == plain.encode_ordinary(t or ""), repr(t)[:80]
    back = bpe.decode(bpe.encode(_docs(spark, texts), VOCAB, P.PATTERN), VOCAB)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.digests(_docs(spark, texts), VOCAB, P.PATTERN).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in got[r.doc_id].ids)).hexdigest()
    assert bpe.digests(_docs(spark, []), VOCAB, P.PATTERN).count() == 0


def _base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def _der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_secret_spans(spark):
    number = lambda k: _der(2, b"\x01" + os.urandom(k))
    rsa = _der(0x30, _der(2, b"\0") + b"".join(number(64) for _ in range(8)))
    pkcs8 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(4, rsa))
    b64 = base64.b64encode(pkcs8).decode()
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256'})}.{url({'sub': 'x'})}.c2ln"
    fake = f"{url({'typ': 'none'})}.{url({'sub': 'x'})}.c2ln"
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64)) + "\n-----END PRIVATE KEY-----"
    texts = ODD + _real() + [
        f"é {b64} x", f"see {jwt}.", f"see {fake}", f"ü{pem}\nend", "k " + rsa.hex() + " e", "q " + base64.b64encode(os.urandom(90)).decode().replace("+", "A"),
        "PassWord: 'hunter22', token=abc, ſecret=abcdefgh API_KEY = abcdef", "AKIA" + "A" * 16 + " AKIASHORT", "password=\x20\x20" * 3000, "eyJ" * 20000,
    ]
    got = {r.doc_id: r for r in secrets.scan(_docs(spark, texts), redacted=True).collect()}
    for i, t in enumerate(texts):
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in _base(t))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), repr(t)[:80]
        assert ",".join(s for s in got[i].spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")) == said
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[1] == k for x in _base(t)) for k in range(3)]
    n = len(ODD) + len(_real())
    assert got[n].spans == f"key:2:{2 + len(b64)}"
    assert got[n].redacted == "é [KEY] x"
    assert got[n + 1].spans == f"jwt:4:{4 + len(jwt)}" and got[n + 2].spans == ""
    assert got[n + 3].spans.startswith(f"key:1:{1 + len(pem)}") and got[n + 3].redacted == "ü[KEY]\nend"
    assert f"key:2:{2 + 2 * len(rsa)}" in got[n + 4].spans
    assert "key" not in got[n + 5].spans
    assert not secrets.is_key(rsa + b"\0") and secrets.is_key(rsa)
    assert got[1].redacted is None and secrets.scan(_docs(spark, [])).count() == 0


def _string(x):
    return len(x).to_bytes(4, "big") + x


def _vectors():
    """Fixed key encodings: (name, bytes or PEM text, is it a private key)."""
    number = lambda k, seed=7: _der(2, bytes([1]) + bytes((seed * i * i + 3 * i + 1) % 256 for i in range(k)))
    zero, one = _der(2, b"\0"), _der(2, b"\1")
    rsa, dsa = _der(0x30, zero + b"".join(number(64, s) for s in range(8))), _der(0x30, zero + b"".join(number(40, s) for s in range(5)))
    sec1 = _der(0x30, one + _der(4, bytes(range(32))) + _der(0xA0, _der(6, b"\x2a\x86\x48\xce")))
    algorithm = _der(0x30, _der(6, b"\x2a\x86\x48\x86") + _der(0x30, _der(4, b"saltsalt") + _der(2, b"\x08")))
    public = _string(b"ssh-ed25519") + _string(bytes(32))
    openssh = b"openssh-key-v1\0" + _string(b"none") + _string(b"none") + _string(b"") + (1).to_bytes(4, "big") + _string(public) + _string(b"abcdabcd" + public + _string(bytes(64)))
    locked = b"openssh-key-v1\0" + _string(b"aes256-ctr") + _string(b"bcrypt") + _string(b"salt") + (1).to_bytes(4, "big") + _string(public) + _string(bytes(range(64)))
    yield from [("rsa", rsa, True), ("dsa", dsa, True), ("sec1", sec1, True), ("pkcs8", _der(0x30, zero + _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(4, rsa)), True)]
    yield from [("encrypted", _der(0x30, algorithm + _der(4, bytes(range(96)))), True), ("openssh", openssh, True), ("openssh locked", locked, True)]
    yield from [("rsa public", _der(0x30, number(64) + _der(2, b"\1\0\1")), False), ("public", _der(0x30, _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(3, b"\0" + bytes(40))), False)]
    yield from [("openssh junk", b"openssh-key-v1\0" + b"some prose that is no key at all, " * 3, False), ("openssh longer", openssh + b"\0", False), ("openssh checks", openssh.replace(b"abcdabcd", b"abcdabce"), False)]
    yield from [("rsa cut", rsa[:-1], False), ("five numbers", _der(0x30, zero + b"".join(number(40, s) for s in range(4))), False)]


def test_key_encodings(spark):
    cases = list(_vectors())
    for name, raw, want in cases:
        assert secrets.is_key(raw) == want, name
    texts = [f"see {base64.b64encode(raw).decode()} here" for _, raw, _ in cases] + [f"see {raw.hex()} here" for _, raw, _ in cases]
    got = {r.doc_id: r.spans for r in secrets.scan(_docs(spark, texts)).collect()}
    for i in range(2 * len(cases)):
        name, _, want = cases[i % len(cases)]
        assert ("key:4:" in got[i]) == want, name
    lines = lambda raw: "\n".join(base64.b64encode(raw).decode()[i : i + 64] for i in range(0, 4 * len(raw) // 3 + 4, 64))
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n\n"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n{}{}\n-----END RSA PRIVATE KEY-----"
    block = bytes(range(160))
    said = [secrets.find(pem.format(h, lines(b))) for h, b in ((head.format("0" * 32), block), (head.format("0" * 8), block), (head.format("0" * 32), block[:-1]), ("Comment: x\n\n", cases[0][1]), ("", block))]
    assert [any(k == 3 and a == 0 for a, k, _ in x) for x in said] == [True, False, False, True, False]


def _plain_hits(text, items):
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for key, body in items:
        ws = decontaminate.words_of((body or "").encode())
        k = min(10, len(ws))
        for i in range(max(0, len(ws) - k + 1) if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == ws[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(key))
    return len(words), len(hit), sorted(found)


def test_secrets_as_they_are_written():
    """Escaped, quoted, wrapped, adjoined, with colons; headers with white space: spans of the original text."""
    number = lambda k: _der(2, b"\x01" + os.urandom(k))
    rsa = _der(0x30, _der(2, b"\0") + b"".join(number(64) for _ in range(8)))
    b64 = base64.b64encode(rsa).decode()
    lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    url = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    body = url('{"sub": 1}')
    spaced = ":".join(f"{x:02x}" for x in rsa)
    openssl = ":\n    ".join(":".join(f"{x:02x}" for x in rsa[i : i + 15]) for i in range(0, len(rsa), 15))
    cases = {
        "key": [
            pem.replace("\n", "\\n"), pem.replace("\n", "\\r\\n"), pem.replace("\n", "\n> "), lines, b64, spaced, openssl, rsa.hex().upper(),
            pem.replace("\n", "\\n").replace("/", "\\/"),
        ],
        "jwt": [url(h) + f".{body}.c2ln" for h in ('{"alg":"none"}', '{ "alg": "HS256"}', '\n{"alg":"RS256"}', '{\n  "typ": "JWT",\n  "alg": "ES256"\n}')],
    }
    around = {"key": [("é {'k': '", "\\n'} "), ("key/", " x"), ("key=", "\nthe end"), ("> ", "\n> so"), ("\n", "\n")], "jwt": [("é token ", " x"), ("Bearer-", "\n"), ("a=", "&b")]}
    for kind, texts in cases.items():
        for secret in texts:
            for left, right in around[kind]:
                if secret in (spaced, openssl, rsa.hex().upper()) and left == "key=":
                    left = "key "
                text = left + secret + right
                found = [(a, b) for a, k, b in secrets.find(text) if secrets.KINDS[k] == kind]
                assert found == [(len(left), len(left) + len(secret))], (kind, text[:60], found)
                raw = [text.encode()]
                assert secrets.suspects(raw, np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])])).all()
    public = base64.b64encode(_der(0x30, _der(0x30, _der(6, b"\x2a\x86")) + _der(3, b"x" * 200))).decode()
    for text in (public, "key/" + public, base64.b64encode(os.urandom(5000)).decode(), os.urandom(3000).hex(), b64[:200], spaced[:600], url('{"typ":"x"}') + f".{body}.x"):
        assert not [s for s in secrets.find(text) if s[1] > 2]


def test_many_patterns_with_one_head():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    head = " please answer the following question about "
    patterns = sorted({(head + word() + " " + word() + " ").encode() for _ in range(5000)} | {head.encode()})
    search = decontaminate.WuManber(patterns)
    raw = (" x ".join(head + word() + " " + word() for _ in range(300)) + patterns[7].decode()).encode()
    known = set(patterns)
    want = sorted({(i, p) for i in range(len(raw)) for size in {len(p) for p in patterns} if (p := raw[i : i + size]) in known})
    assert sorted(search.search(raw)) == want and len(want) > 300
    assert max(map(len, search.bucket.values())) <= 30  # look-ups a stop: lengths, not patterns


def test_decontamination(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Solo"), (3, None), (4, "..."), (5, "w5 w6 w7"), (5, "w5 w6 w7"), (6, " ".join(["aa"] * 12)), (10, long.upper())]
    texts = ODD + [f"x {long}, y", "W5--w6;w7", "solo", "solos", "aa " * 11, "aa " * 9, " ".join(f"w{i}" for i in range(9)), "é" + long, long + " " + long] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (64 << 20, 500):  # one broadcast block, many blocks in files
        got = {r.doc_id: r for r in decontaminate.decontaminate(_docs(spark, texts), bench, block_bytes=size).collect()}
        for i, t in enumerate(texts):
            n, h, found = _plain_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].n_items) == (n, h, found, len(found)), repr(t)[:60]
            assert got[i].contaminated == (h > 0)
    monkeypatch.setattr(storage, "_home", lambda spark: f"file:{tmp_path}")  # as Spark writes it
    many = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(_docs(spark, texts), bench, block_bytes=500, group_bytes=2000).collect()}
    monkeypatch.undo()
    assert many == {i: r.n_hit for i, r in got.items()}
    none = decontaminate.decontaminate(_docs(spark, texts), bench.limit(0)).filter("n_hit > 0 or contaminated")
    assert none.count() == 0 and decontaminate.decontaminate(_docs(spark, []), bench).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "", None, "x" * 300_000, "a\r\n\r\nb", "same", "same", "same", "WARC/1.1\r\n\r\n"]
    rows = [(i, f"http://e/{i}\n é", h, "z") for i, h in enumerate(html)] + [(7, "http://e/7", "same", "z"), (None, None, "same", "z"), (None, "u", "lone", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages, sample_bytes=20_000, shard_bytes=30_000)
    got = sorted((tuple(r) for r in warc.read_archives(manifest).collect()), key=str)
    keep = {}
    for i, _, h, _ in rows:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        k = keep[h or ""]
        b = (h or "").encode()
        again = k >= 0 and i != k
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", k if again else None))
    assert got == sorted(want, key=str)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    bodies = [warc.parse(raw) for r in manifest.collect() for raw in warc.read_records(r.path)]
    assert any(p == b"a\r\n\r\nb" for _, _, p in bodies)
    assert all("\n" not in h["WARC-Target-URI"] for h, _, _ in bodies)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
