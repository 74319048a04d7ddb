"""Fill-in-middle transformation by repeated-capture matching.

One `fullmatch` of `(unit)*` keeps the end of every repetition, so `ends(1)`
gives the number of units and every possible cut at once.  A text is cut at two
of these places into prefix, middle and suffix, and written in one of three
forms: `plain` (the text itself), `psm` (prefix, suffix, middle) or `spm`
(suffix, prefix, middle), each part behind its sentinel.

The choice depends on `seed` and doc_id alone: the first four groups of eight
digits of the hex SHA-256 of `<seed>:<doc_id>` are h1 to h4.  The prefix ends
after the smaller of h1 and h2 modulo n + 1 units, the middle after the larger;
h3 modulo 100 under `fim_percent` takes part at all, h4 modulo 100 under
`spm_percent` takes the form spm.

Edge cases: a null text is empty; an empty text, or one that contains a
sentinel, stays plain; prefix_chars and middle_chars are then null.  A null
doc_id counts as an empty string.  Repeated rows give repeated results; empty
tables give no rows.  A text that the units don't cover as a whole fails.
Only the columns `keep`, text and doc_id are read; columns of other names
don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

LINE = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")  # of prefix, suffix, middle


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be found again: none is empty, lies in another, or begins as one ends."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")
    return sentinels


def cuts(units: regex.Pattern, text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(number of units, end of the prefix, end of the middle) of a text."""
    found = units.fullmatch(text)
    if found is None:
        raise ValueError("the units don't cover the text")
    ends = found.ends(1)
    n = len(ends)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def transform(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, unit: str = LINE,
    sentinels: tuple[str, str, str] = SENTINELS, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns `keep`, n (units), form, prefix_chars, middle_chars and output of every row."""
    p, s, m = _checked(sentinels)
    kept = docs.select(*keep, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_rl_id"), F.col("text").alias("_rl_text"))
    extra = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.drop("_rl_id", "_rl_text").dtypes), extra])
    names = [x.split()[0] for x in extra.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def row(units: regex.Pattern, key: str, text: str) -> tuple:
        h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        n, a, b = cuts(units, text, h1, h2)
        if not text or h3 % 100 >= fim_percent or any(x in text for x in sentinels):
            return n, "plain", None, None, text
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))

    def run(batches):
        units = regex.compile(f"({unit})*")
        for part in B.pieces(batches, "_rl_text"):
            key, text = (part.column(part.num_columns - k).to_pylist() for k in (2, 1))
            cols = zip(*(row(units, k, t or "") for k, t in zip(key, text, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*part.schema.names[:-2], *names])

    return kept.mapInArrow(run, schema)


def restored(sentinels: tuple[str, str, str] = SENTINELS, output: str = "output", form: str = "form") -> Column:
    """The text, rebuilt from output and form alone."""
    p, s, m = map(F.lit, _checked(sentinels))
    out = F.col(output)

    def between(left: Column, right: Column) -> Column:
        start = F.instr(out, left) + F.length(left)
        return F.substring(out, start, F.instr(out, right) - start)

    middle = F.substring(out, F.instr(out, m) + F.length(m), F.length(out))
    return (
        F.when(F.col(form) == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(F.col(form) == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(out)
    )
