"""Spelling variant grouping by a relational trie frontier.

All words form a trie that is a table of edges (node, character, child); a
node is the hash of its prefix.  A frontier of states (word, position, node,
edits) is joined to the edges of one level after the other.  A state without
an edit follows its word's own path, and at each node takes one edit into the
other edges: a character replaced, or left out of the word.  A state with an
edit follows equal characters only.  A state that has used its edit when word
and path end together names a neighbour.  Edits are taken where word and path
part, so each is tried once; an inserted character is a deletion seen from the
other word, so pairs are mirrored in the end.

Two tries are walked at once, of words and of reversed words, each for the
edits in the second half of its word: states enter half-way down, where few
edges leave a node, and no word is ever compared with all first letters.  An
edge knows which characters follow it and which lengths of words lie below;
states that can't end are not written.

A node's hash may stand for two prefixes by chance; that only adds candidates,
and the distance of every pair is checked on the words themselves.

Words of up to `trie_chars` code points meet in the trie, so the number of
levels doesn't grow with the longest word.  Pairs of which both are longer are
found by one join on hashes of the words with a code point left out; a hash is
shared by words that are equal but there, so its group is as small as the
alphabet.

Edge cases: null words and null texts have no results; empty tables give none;
repeated rows count again; a null doc_id counts as an empty string; ties of
the largest count go to the smallest word in code-point order.  Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import drop, materialise

RUN = "[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


def count_words(docs: DataFrame, least_chars: int = 7, least_count: int = 2, slip_every: int = 31, letters: str = RUN) -> DataFrame:
    """word, n: the words of at least `least_chars` code points, lower-cased, that occur `least_count` times or more.

    A word is a run of `letters`.  Where the CRC-32 of `<doc_id>:<word>` is a
    multiple of `slip_every`, one of its code points is left out (0: nowhere).
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"{letters}{{{max(1, least_chars)},}}"), F.lit(0))).alias("word"))
    word = F.translate("word", _UPPER, _LOWER)
    if slip_every:
        runs = runs.select(word.alias("word"), F.crc32(F.concat("doc", F.lit(":"), word)).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        word = F.when(F.col("h") % slip_every == 0, less).otherwise(F.col("word"))
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _char(at: Column) -> Column:
    """The code point of `s` at a place counted from 0, as a string; empty past the end."""
    return F.substring(F.col("s"), (at + 1).cast("int"), F.lit(1))


def _node(chars: Column) -> Column:
    return F.xxhash64(F.substring(F.col("s"), F.lit(1), chars.cast("int")), F.col("reversed"))


def _bit(of: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), of.bitwiseAND(63).cast("int"))


def _ways(words: DataFrame) -> DataFrame:
    """Each word as it is and reversed: s, reversed, len, n, and the depth `enter` from which edits are taken."""
    each = words.select("n", F.explode(F.array(F.struct(F.col("word").alias("s"), F.lit(0).alias("reversed")), F.struct(F.reverse("word").alias("s"), F.lit(1).alias("reversed")))).alias("w"))
    each = each.select("w.*", "n", F.length("w.s").alias("len"))
    half = F.when(F.col("reversed") == 0, F.floor(F.col("len") / 2)).otherwise(F.ceil(F.col("len") / 2))
    return each.withColumn("enter", F.least(half, F.greatest(F.col("len") - 2, F.lit(0))).cast("int"))


def _edges(ways: DataFrame) -> DataFrame:
    """depth, node, ch, child, ends (is the child a word?), follow and lengths (bits: next characters, lengths of the words below)."""
    steps = ways.filter("len > enter").select("s", "reversed", "len", F.explode(F.sequence("enter", F.col("len") - 1)).alias("depth"))
    next_char = _char(F.col("depth") + 1)
    steps = steps.select(
        "depth", _node(F.col("depth")).alias("node"), _char(F.col("depth")).alias("ch"), _node(F.col("depth") + 1).alias("child"), (F.col("len") == F.col("depth") + 1).alias("ends"),
        F.when(next_char != "", _bit(F.ascii(next_char))).otherwise(F.lit(0).cast("long")).alias("follow"), _bit(F.col("len")).alias("lengths"),
    )
    return steps.groupBy("depth", "node", "ch", "child").agg(F.bool_or("ends").alias("ends"), F.bit_or("follow").alias("follow"), F.bit_or("lengths").alias("lengths"))


def _trie_pairs(words: DataFrame) -> DataFrame | None:
    """word, n, reversed, node: the words' neighbours as nodes of the trie; None without words."""
    ways = materialise(_ways(words), "spelling-ways")
    span = ways.agg(F.min("enter"), F.max("len")).first()
    if span[0] is None:
        return None
    edges = materialise(_edges(ways), "spelling-edges", by="depth")
    state = ["s", "reversed", "len", "n", "pos", "node", "edits"]
    frontier, found, old = None, [], []
    for depth in range(span[0], span[1]):
        here = edges.filter(F.col("depth") == depth).select(F.col("node").alias("from"), "ch", "child", "ends", "follow", "lengths")
        own = ways.filter(F.col("enter") == depth).select("s", "reversed", "len", "n", F.lit(depth).alias("pos"), _node(F.lit(depth)).alias("node"), F.lit(0).alias("edits"))
        if frontier is not None:
            own = own.unionByName(frontier.filter("edits = 0 and not found").select(*state))
        same, skipped = F.col("ch") == _char(F.col("pos")), F.col("ch") == _char(F.col("pos") + 1)
        # of two words that differ by one character each would find the other: one way is enough
        kind = F.when(same, 0).when(skipped & (F.col("ch") > _char(F.col("pos"))), 3).when(skipped, 2).when(F.col("ch") > _char(F.col("pos")), 1)
        branched = own.join(here, F.col("node") == F.col("from")).withColumn("kind", kind).filter("kind is not null")
        # 0 goes on, 1 replaces, 2 leaves out, 3 does either
        ways_on = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("kind"))
        branched = branched.withColumn("kind", F.explode(ways_on))
        branched = branched.select("s", "reversed", "len", "n", (F.col("pos") + F.when(F.col("kind") == 2, 2).otherwise(1)).alias("pos"), (F.col("kind") > 0).cast("int").alias("edits"), "child", "ends", "follow", "lengths")
        if frontier is not None:
            late = frontier.filter("edits = 1 and not found").select(*state).withColumn("want", _char(F.col("pos")))
            late = late.join(here, (F.col("node") == F.col("from")) & (F.col("want") == F.col("ch")))
            branched = branched.unionByName(late.select("s", "reversed", "len", "n", (F.col("pos") + 1).alias("pos"), "edits", "child", "ends", "follow", "lengths"))
        target = F.col("len") - (F.col("pos") - depth - 1)  # length of the word at the path's end: one less where a character was left out
        over = (F.col("edits") == 1) & (F.col("pos") == F.col("len"))
        last_out = (F.col("edits") == 0) & (F.col("pos") == F.col("len") - 1) & F.col("ends")  # the last character left out
        open_ = (F.col("pos") < F.col("len")) & ((F.col("edits") == 0) | ((F.col("follow").bitwiseAND(_bit(F.ascii(_char(F.col("pos"))))) != 0) & (F.col("lengths").bitwiseAND(_bit(target)) != 0)))
        results = F.concat(F.when((over & F.col("ends")) | last_out, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")), F.when(open_, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
        step = branched.select("s", "reversed", "len", "n", "pos", F.col("child").alias("node"), "edits", F.explode(results).alias("found"))
        frontier = materialise(step, "spelling-frontier")
        old.append(frontier)
        found.append(frontier.filter("found"))
    if not old:
        return None
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    out = materialise(every.select(F.when(F.col("reversed") == 0, F.col("s")).otherwise(F.reverse("s")).alias("word"), "n", "reversed", "node").distinct(), "spelling-found")
    drop(*old, edges, ways)
    return out


def _left_out(batches):
    """For each word and place, hashes of the word without that code point; `place` is -1 where any place counts."""
    base = int(B.splitmix(1, 2024)[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    for part in B.pieces(batches, "word"):
        for i in range(part.num_rows):
            s = np.frombuffer(part.column(0)[i].as_py().encode("utf-32-le"), "<u4").astype(_U)
            up = np.full(len(s) + 1, base, _U)
            up[0] = 1
            np.cumprod(up, out=up)
            prefix = np.concatenate([np.zeros(1, _U), np.cumsum(B.mix(s + _U(1)) * up[:-1], dtype=_U)])
            without = B.mix(prefix[:-1] + (prefix[-1] - prefix[1:]) * _U(inverse) + _U(len(s) - 1))
            last = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # of equal neighbours, one is enough
            whole = B.mix(prefix[-1:] + _U(len(s)))
            keys = np.concatenate([without, without[last], whole]).view(np.int64)
            place = np.concatenate([np.arange(len(s)), np.full(len(last) + 1, -1)])
            cut = np.concatenate([np.ones(len(s) + len(last), bool), np.zeros(1, bool)])
            take = pa.array(np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(place), pa.array(cut), *(part.slice(i, 1).column(k).take(take) for k in (1, 2))], names=["key", "place", "cut", "id", "n"])


def _long_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: candidates among long words."""
    named = materialise(words.withColumn("id", F.xxhash64("word")), "spelling-long")
    keys = materialise(named.select("word", "id", "n").mapInArrow(_left_out, "key long, place long, cut boolean, id long, n long"), "spelling-left-out")
    other = keys.select("key", "place", F.col("cut").alias("cut_b"), F.col("id").alias("id_b"))
    replaced = (F.col("place") >= 0) & (F.col("id") < F.col("id_b"))
    shorter = (F.col("place") < 0) & F.col("cut") & ~F.col("cut_b")
    pairs = keys.join(other, ["key", "place"]).filter(replaced | shorter).select("id", "id_b").distinct()
    left = pairs.join(named.select("id", F.col("word").alias("a"), F.col("n").alias("na")), "id")
    return left.join(named.select(F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("nb")), "id_b").select("a", "na", "b", "nb")


def neighbours(words: DataFrame, trie_chars: int = 48) -> DataFrame:
    """word, other, n_other: all ordered pairs of words (word, n; distinct) one edit apart."""
    if not 0 < trie_chars < 62:
        raise ValueError("an edge tells lengths apart up to 63")
    short = words.filter(F.length("word") <= trie_chars + 1)
    pairs = _long_pairs(words.filter(F.length("word") > trie_chars))
    near = _trie_pairs(short)
    if near is not None:
        ends = _ways(short).select(_node(F.col("len")).alias("node"), "reversed", F.when(F.col("reversed") == 0, F.col("s")).otherwise(F.reverse("s")).alias("b"), F.col("n").alias("nb"))
        pairs = pairs.union(near.join(ends, ["node", "reversed"]).select(F.col("word").alias("a"), F.col("n").alias("na"), "b", "nb"))
    pairs = pairs.filter(F.levenshtein("a", "b", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("n_other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("n_other"))))
    return pairs.select(both.alias("p")).select("p.*").distinct()


def group(words: DataFrame, times: int = 10, trie_chars: int = 48) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n; distinct).

    `form` is the neighbour of largest count, if that is `times` the word's or
    more; `root` the last of the forms that follow one another.
    """
    if times < 2:
        raise ValueError("forms must have larger counts, or they could go in circles")
    words = materialise(words.filter("word is not null").select("word", "n"), "spelling-words")
    near = neighbours(words, trie_chars).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    near = materialise(near, "spelling-near")
    form_n = -F.col("best.less")
    out = words.join(near, "word", "left").withColumn("form_n", F.when(form_n >= times * F.col("n"), form_n)).withColumn("form", F.when(F.col("form_n").isNotNull(), F.col("best.other")))
    out = materialise(out.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "spelling-forms")
    # who has a form looks up the form's root so far; the way left halves each time
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    out = out.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
