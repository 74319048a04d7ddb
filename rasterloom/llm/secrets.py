"""Secret scans with structural confirmation.

Base kinds are patterns: assign, access, hex.  The method adds kinds that are
reported only if their structure holds: `key` (base64 or hex text, also as a
PEM body, that decodes to a private key: RSA, DSA, SEC1, PKCS#8 or encrypted
PKCS#8 whose nested DER lengths add up, or an OpenSSH key whose length-prefixed
fields do; or a PEM body encrypted as its headers say) and `jwt` (three base64url parts whose header is a JSON
object with an algorithm and whose payload is a JSON object).

Candidates are read as they are written in practice: with line breaks, tabs and
slashes escaped by a backslash (JSON, .env files), behind quote marks at the
start of lines, wrapped into lines without armour, as hex digits with colons or
spaces.  A key is looked for at every place of a base64 or hex run where a
private key's first bytes stand, and takes as many characters as its outer
length says (up to 64 KB), which must be where its run or line ends, so text
before or after it does no harm.  A signed
token's header may begin with white space, and anywhere in its run (in its last
8,192 characters, if not at the start).  Spans are those of the original text.

Whole batches are first screened by vectorised byte tests that cannot miss a
match (a run of enough characters of a class, a keyword); only documents that
pass are searched by pattern.  Public keys are no secrets and not reported.

Edge cases: a null text is empty; offsets are code points, end exclusive;
matches of one kind do not overlap, of different kinds may; repeated rows are
scanned again; empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

KINDS = ("assign", "access", "hex", "key", "jwt")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
_B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}+={0,2}(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++={0,2}(?=\s|$|[^A-Za-z0-9]))*+")
_BIGHEX = re.compile(r"[0-9a-fA-F][0-9a-fA-F:\s]{46,}+")
_ESCAPE = re.compile(r"\\[nrt/]|^[ \t]*(?:[>|#*][>|#* \t]*)", re.M)
_KEY_HEAD = re.compile(rb"\x30(?:[\x18-\x7f]|\x81[\x80-\xff]|\x82..)(?:\x02\x01[\x00\x01]|\x30[\x05-\x7f]\x06)", re.S)
_B64_HEAD = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
_HEX_HEAD = re.compile(r"30(?:[1-7][0-9a-f]|81[89a-f][0-9a-f]|82[0-9a-f]{4})(?:02010[01]|30[0-7][0-9a-f]06)|6f70656e7373682d6b65792d763100")
_JSON_HEAD = re.compile(rb'\s*\{\s*"[^"\\]{1,32}"\s*:')
_HEX_CHARS, _B64_CHARS = (frozenset(string.hexdigits), frozenset(string.ascii_letters + string.digits + "+/_-="))
_MOST = 1 << 16  # characters of an OpenSSH key, and bytes of a key of two length bytes
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)KEY-----((?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n)*+)([A-Za-z0-9+/=\s]++)-----END \1KEY-----")
_DEK = re.compile(r"^DEK-Info: *([A-Z0-9-]+),([0-9A-F]+)\s*$", re.M)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,}+)\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]*+")
_JWT_BYTES = re.compile(rb"[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]++\.")
_JWT_HEAD = re.compile(r"e[w-z]|I[A-P]|C[Q-Za-v]|D[Q-Za-f]")  # of an opening brace, or of white space
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")


def _table(pattern: bytes) -> np.ndarray:
    return np.array([bool(re.match(pattern, bytes([b]))) for b in range(256)])


_IS_HEX, _IS_B64, _IS_SPACED_HEX = _table(rb"[0-9a-f]"), _table(rb"[A-Za-z0-9+/_-]"), _table(rb"[0-9a-fA-F:\s]")


def _long_runs(mask: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """Documents that hold a run of `least` or more true bytes (runs across documents may add some)."""
    width = 1
    while width * 2 <= least and len(mask) > width:
        mask = mask[:-width] & mask[width:]
        width *= 2
    if width < least and len(mask) > least - width:
        mask = mask[: -(least - width)] & mask[least - width :]
    at = np.flatnonzero(mask)
    out = np.zeros(len(off) - 1, dtype=bool)
    out[np.unique(np.searchsorted(off, at, side="right") - 1)] = True
    return out


def _der(raw: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, first and past-last byte of the body) of the elements in raw[at:end] if all nested lengths add up, else None."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size == 0x80:
            return None
        if size > 0x80:
            n = size & 0x7F
            if n > 4 or end - at < n or raw[at] == 0:
                return None
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if size > end - at or depth > 12 or tag & 0x1F == 0x1F:
            return None
        if tag & 0x20 and _der(raw, at, at + size, depth + 1) is None:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


_OPENSSH = b"openssh-key-v1\x00"


def _openssh_end(raw: bytes) -> int | None:
    """Where an OpenSSH key ends, if cipher, derivation and its options, number of keys, public keys and the private part are in order."""
    at = len(_OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4], "big")
        if len(raw) - at < 4 + size:
            return None
        at += 4 + size
        return raw[at - size : at]

    cipher, derivation, options = field(), field(), field()
    if not cipher or not derivation or options is None or not (cipher + derivation).isascii() or (cipher == b"none") != (derivation == b"none"):
        return None
    keys, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if not 1 <= keys <= len(raw):
        return None
    for _ in range(keys):
        public = field()
        if public is None or not public[4 : 4 + int.from_bytes(public[:4], "big")].startswith((b"ssh-", b"ecdsa-", b"sk-")):
            return None
    private = field()
    if not private or len(private) < 8:
        return None
    return at if cipher != b"none" or private[:4] == private[4:8] else None  # unencrypted: both check numbers agree


def is_key(raw: bytes) -> bool:
    """True for a private key: PKCS#1, DSA, SEC1 or PKCS#8 (also encrypted) DER whose lengths add up, or an OpenSSH key."""
    if raw.startswith(_OPENSSH):
        return _openssh_end(raw) == len(raw)
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    outer = _der(raw, 0, len(raw))
    if outer is None or len(outer) != 1:
        return False
    parts = _der(raw, *outer[0][1:]) or []
    tags = [t for t, *_ in parts]
    first = raw[parts[0][1] : parts[0][2]] if parts else b""
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: an algorithm (object identifier and parameters), then octets
        return [t for t, *_ in _der(raw, *parts[0][1:]) or []] in ([0x06], [0x06, 0x30], [0x06, 0x05])
    if set(tags) == {0x02}:
        return len(tags) == 9 and first in (b"\x00", b"\x01") or len(tags) == 6 and first == b"\x00"  # RSA, DSA
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        return first in (b"\x00", b"\x01")
    return tags[:2] == [0x02, 0x04] and first == b"\x01"  # SEC1


def _is_pem(headers: str, body: str) -> bool:
    raw = _b64("".join(body.split())) or b""
    dek = _DEK.search(headers)
    if dek and "ENCRYPTED" in headers:  # whole cipher blocks, and an initial vector of one block
        block = 8 if dek[1].startswith("DES") else 16
        return len(dek[2]) == 2 * block and len(raw) >= 24 and len(raw) % block == 0
    return is_key(raw)


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(_b64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _key_size(head: bytes) -> int | None:
    """Bytes of the key that may begin with `head`, by its outer length."""
    if not _KEY_HEAD.match(head):
        return None
    n = max(0, head[1] - 0x80)
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _b64_keys(run: str):
    """(start, end) of the keys in a run of base64 characters."""
    done = 0
    for m in _B64_HEAD.finditer(run):
        i = m.start()
        if i < done:
            continue
        if m[0][0] == "b":
            raw = _b64(run[i : i + _MOST // 4 * 4][: (len(run) - i) // 4 * 4 or None].rstrip("=")) or b""
            size = _openssh_end(raw)
        else:
            size = _key_size(_b64(run[i : i + 12]) or b"")
        chars = -(-4 * size // 3) if size else 0
        if size and i + chars <= len(run) and is_key((_b64(run[i : i + chars]) or b"")[:size]):
            done = i + chars
            while done < len(run) and run[done] == "=" and (done - i) % 4:
                done += 1
            yield i, done


def _hex_keys(digits: str):
    """(start, end) of the keys in a run of lower-case hex digits."""
    done = 0
    for m in _HEX_HEAD.finditer(digits):
        i = m.start()
        if i < done:
            continue
        if m[0][0] == "6":
            size = _openssh_end(bytes.fromhex(digits[i : i + min(2 * _MOST, (len(digits) - i) // 2 * 2)]))
        else:
            size = _key_size(bytes.fromhex(digits[i : i + 14]))
        if size and i + 2 * size <= len(digits) and is_key(bytes.fromhex(digits[i : i + 2 * size])):
            done = i + 2 * size
            yield i, done


def _plain(text: str) -> tuple[str, list[int], list[int]]:
    """The text without escapes and quote marks, and which place of the text each piece of it begins at."""
    out, mine, theirs, at, size = [], [0], [0], 0, 0
    for m in _ESCAPE.finditer(text):
        new = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\/": "/"}.get(m[0], "")
        out += [text[at : m.start()], new]
        size += m.start() - at
        mine += [size, size + len(new)]
        theirs += [m.start(), m.end()]
        size += len(new)
        at = m.end()
    out.append(text[at:])
    return "".join(out), mine, theirs


def _keys(text: str) -> list[tuple[int, int, int]]:
    plain, mine, theirs = _plain(text) if "\\" in text or "\n" in text else (text, [0], [0])

    def back(i: int) -> int:
        k = bisect.bisect_right(mine, i) - 1
        return theirs[k] + i - mine[k]

    spans = [(m.start(), m.end()) for m in _PEM.finditer(plain) if _is_pem(m[2], m[3])]
    for pattern, skip, keys, more in ((_B64, "\r\n\t ", _b64_keys, _B64_CHARS), (_BIGHEX, "\r\n\t\x0b\x0c :", _hex_keys, _HEX_CHARS)):
        for m in pattern.finditer(plain):
            run = m[0] if keys is _b64_keys else m[0].lower()
            if not (_B64_HEAD if keys is _b64_keys else _HEX_HEAD).search(dense := run.translate({ord(c): None for c in skip})):
                continue
            place = [m.start() + i for i, c in enumerate(run) if c not in skip]
            found = [(place[a], place[b - 1] + 1) for a, b in keys(dense)]
            spans += [(a, b) for a, b in found if b == len(plain) or plain[b] not in more]
    out, end = [], -1
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((back(a), 3, back(b - 1) + 1))
            end = b
    return out


def _tokens(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _JWT.finditer(text):
        head, body = m[1], None
        for i in (0, *(h.start() for h in _JWT_HEAD.finditer(head, max(1, len(head) - 8192)))):
            first = head[i : i + 64]
            if not _JSON_HEAD.match(_b64(first[: len(first) // 4 * 4]) or b""):
                continue
            said = _json_object(head[i:])
            if said and isinstance(said.get("alg"), str):
                body = _json_object(m[2]) if body is None else body
                if body is not None:
                    out.append((m.start() + i, 4, m.end()))
                break
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every confirmed span, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out + _keys(text) + _tokens(text))


def suspects(raw: list[bytes], buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents in which find() can find anything."""
    may = _long_runs(_IS_HEX[buf], off, 24) | _long_runs(_IS_B64[buf], off, 40) | _long_runs(_IS_SPACED_HEX[buf], off, 71)
    for d in np.flatnonzero(~may).tolist():
        t = raw[d]
        may[d] = b"AKIA" in t or b"KEY-----" in t or _JWT_BYTES.search(t) is not None or any(w in low for low in (t.lower(),) for w in _WORDS)
    return may


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[{}]") -> str:
    """The text with each span (overlaps merged, named by the first kind) replaced."""
    out, done, open_ = [], 0, None
    for a, k, b in spans:
        if open_ and a < open_[2]:
            open_ = (open_[0], open_[1], max(b, open_[2]))
            continue
        if open_:
            out += [text[done : open_[0]], mark.format(KINDS[open_[1]].upper())]
            done = open_[2]
        open_ = (a, k, b)
    if open_:
        out += [text[done : open_[0]], mark.format(KINDS[open_[1]].upper())]
        done = open_[2]
    return "".join(out) + text[done:]


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """Per row: the columns `keep`, counts and spans of the base kinds, all spans.

    With `redacted`, also the text in which every span is replaced by its kind
    (`redacted`; null stays null).
    """
    kept = docs.select(*keep, F.col("text").alias("_rl_text"))
    extra = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long" + ", redacted string" * redacted
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.drop("_rl_text").dtypes), extra])
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * redacted
    names = [x.split()[0] for x in extra.split(", ")]

    def row(text: str | None, spans: list) -> tuple:
        base = [s for s in spans if s[1] < 3]
        said = lambda ss: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in ss)
        found = (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(spans), len(spans))
        return found + ((redact(text, spans) if spans else text),) * redacted

    def run(batches):
        nothing = row(None, [])
        for part in B.pieces(batches, "_rl_text"):
            texts = part.column(part.num_columns - 1)
            buf, off = B.text_buffer(texts)
            may = suspects(B.byte_rows(texts), buf, off).tolist()
            rows = []
            for i, m in enumerate(may):
                if m or redacted:
                    t = texts[i].as_py()
                    rows.append(row(t, find(t) if m else []))
                else:
                    rows.append(nothing)
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*part.schema.names[:-1], *names])

    return B.bounded(kept).mapInArrow(run, schema)
