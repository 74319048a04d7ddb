"""The numbered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, infill, langid, neardup, quality, repeats, secrets, spelling, tokenfile, toxicity, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id has the remainder -1, so it is in no fold and never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(_fold(5) != 0))
    return toxicity.score(docs.withColumn("held_out", _fold(5) == 0), model, keep=("doc_id", "held_out"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_read(spark, sf_dir, "pages")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(_read(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    filters = langid.fit(docs.filter(_fold(4) != 2).select("doc_id", "text", "lang"))
    return langid.predict(docs.withColumn("held_out", _fold(4) == 2), filters, keep=("doc_id", "held_out"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85).drop("th", "component")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_read(spark, sf_dir, "documents")).drop("spans")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.count_words(_read(spark, sf_dir, "documents"), least_chars=7, least_count=2, slip_every=31), times=10)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(_read(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_ids(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_files": op13_token_files,
}

_OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((instr('0123456789abcdef', substr(x, 1 + (5 * i) // 4, 1)) - 1) * 16
         + (instr('0123456789abcdef', substr(x || '0', 2 + (5 * i) // 4, 1)) - 1)) >> (3 - i % 4)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""

_OP6 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS p, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)
), hit AS (SELECT doc_id, i, k, item_id FROM dwin JOIN win USING (k, p)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)
), size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT r, r AS other FROM w UNION SELECT reach.r, link.y FROM reach JOIN link ON link.x = reach.other),
comp AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.other GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN comp USING (r) LEFT JOIN size USING (r)
"""

_OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT r, 1000 * j AS lo, least(1000, len(h) // 2 - 199 - 1000 * j) AS n, substr(h, 2000 * j + 1, 2400) AS p FROM (SELECT r, h, unnest(range(0, (len(h) // 2 + 800) // 1000)) AS j FROM d)),
win AS (SELECT r, lo + i AS i, md5_number(substr(p, 2 * i + 1, 400)) AS k FROM (SELECT r, lo, p, unnest(range(0, n)) AS i FROM piece)),
again AS (SELECT r, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
run AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again)),
span AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, run),
edge AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM (SELECT r, a, b FROM span UNION ALL SELECT r, len(h) // 2, len(h) // 2 FROM d)
), kept AS (
  SELECT r, sum(b - a) AS n_removed, count(*) - 1 AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS h FROM edge JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM d JOIN kept USING (r)
"""

# CRC-32 a byte at a time, with the table of the reflected polynomial made by its rule
_OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, word, count(*) AS k
  FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS word FROM documents
  )
  WHERE length(word) >= 7 GROUP BY ALL
), bytes AS (SELECT doc_id, word, k, hex(encode(doc_id || ':' || word)) AS b FROM runs),
hashed AS (
  SELECT word, k, xor(list_reduce(
      list_transform(range(1, len(b), 2), lambda i: ('0x' || substr(b, i, 2))::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, crc
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2) ELSE word END AS word, k FROM hashed
), w AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pair AS (
  SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN w b ON a.rest = b.word
), near AS (
  SELECT x AS word, count(*) AS n_near, first(struct_pack(y := y, n := n) ORDER BY n DESC, y) AS best FROM pair JOIN w ON w.word = y GROUP BY x
), form AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 10 * n THEN best.y END AS form, CASE WHEN best.n >= 10 * n THEN best.n END AS form_n FROM w LEFT JOIN near USING (word)
), path AS (
  SELECT word, form AS root, 1 AS step FROM form WHERE form IS NOT NULL
  UNION ALL SELECT path.word, form.form, step + 1 FROM path JOIN form ON form.word = path.root WHERE form.form IS NOT NULL
), root AS (SELECT word, arg_max(root, step) AS root FROM path GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM form LEFT JOIN root USING (word)
"""

_OP12 = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS s FROM documents
), g AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM h
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), p AS (SELECT *, array_to_string(u[:i], '') AS a, array_to_string(u[i + 1:j], '') AS b, array_to_string(u[j + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": urlfilter.oracle(),
    "op5_warc": _OP5,
    "op6_decontamination": _OP6,
    "op9_near_duplicates": _OP9,
    "op10_repeated_passages": _OP10,
    "op11_spelling_variants": _OP11,
    "op12_fill_in_middle": _OP12,
}
