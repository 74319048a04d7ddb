"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

Words are maximal runs of other than ASCII white space, A-Z lower-cased; a
document's set holds its distinct shingles of `width` words (a document of
fewer words, but not none, is one shingle).  Two documents are linked if
100 * |intersection| >= `percent` * |union|; links join documents to
components.

1. Equal sets are one class from here on (128-bit keys of the sets); every
   class gets a number of its own.
2. Each class gets a MinHash signature; `rows` hashes form a band, as many
   bands as keep the chance that a link shares no band under `miss`.
3. In each band bucket every class is compared with the bucket's best connected
   one (most classes over all its buckets): among many copies of a text that is
   the text itself.  A comparison reads the signatures in batches and stops as soon as the
   posterior probability that the pair reaches the threshold falls under
   `miss`; survivors are confirmed on the texts' full sets.
4. Only classes of one bucket that are then in different components can add to
   a component.  Among all of these an exact prefix filter finds the partners:
   two sets at the threshold share one of each one's rarest shingles (all but
   the `percent` % that must be shared, and one more).  A shingle that only one
   of them has rules out nothing else but itself, so a text whose edits are its
   own needs no comparison, however many copies surround it.

Edge cases: null, empty or word-free texts have the empty set, are linked with
nothing and kept; equal texts are linked; rows with null doc_id take part (a
component's id is its smallest non-null doc_id); repeated rows share their
fate; empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .storage import drop, materialise

_U = np.uint64
_ROLLER = B.Roller(41)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
BATCH = 44
SIGNATURE = 352


def plan(percent: int, miss: float) -> tuple[int, int]:
    """(bands, rows a band): the most rows, so the fewest chance candidates, that SIGNATURE hashes allow."""
    t = percent / 100
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - t**rows)) if t < 1 else 1
        if bands * rows <= SIGNATURE:
            return bands, rows
    raise ValueError("the threshold is too low for this signature")


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch end n, the fewest matching signature bytes with P(similarity >= threshold) >= miss.

    With a uniform prior the posterior of the match rate after m of n is
    Beta(m + 1, n - m + 1), whose upper tail at t is a binomial's lower tail.
    A byte of two different minima agrees by chance in 1 of 256 cases.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, and each text's range."""
    buf, off = B.text_buffer(texts)
    buf = _LOWER[buf]
    starts, ends, bounds = B.word_spans(buf, off)
    hashes, b = B.shingle_hashes(_ROLLER.spans(_ROLLER.prefix(buf), starts, ends), bounds, width)
    sets = [np.unique(hashes[x:y]) for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
    return np.concatenate(sets) if sets else hashes, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _fingerprints(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, text hash, size of its set, key of its set, band hashes, signature bytes."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("_rl_text"))

    def run(batches):
        mult = (B.splitmix(SIGNATURE, 3) >> _U(32)).astype(np.uint32) | np.uint32(1)
        plus = (B.splitmix(SIGNATURE, 4) >> _U(32)).astype(np.uint32)
        odd, salt = B.splitmix(rows, 6) | _U(1), B.splitmix(bands, 7)
        for part in B.pieces(batches, "_rl_text", 512 << 10):
            sets, bounds = shingle_sets(part.column(2), width)
            n = np.diff(bounds)
            k1, k2 = (B.sums(B.mix(sets + c), bounds) for c in (_U(1), _U(0x5851F42D4C957F2D)))
            full = np.flatnonzero(n)
            low = np.zeros((SIGNATURE, len(full)), dtype=np.uint32)
            if len(full):
                x, at = (sets >> _U(32)).astype(np.uint32), bounds[full]
                for j in range(SIGNATURE):
                    low[j] = np.minimum.reduceat(x * mult[j] + plus[j], at)
            keys = np.zeros((len(full), bands), dtype=_U)
            for i in range(bands):
                for j in range(rows):
                    keys[:, i] += low[i * rows + j] * odd[j]
                keys[:, i] = B.mix(keys[:, i] + salt[i])
            sig = np.ascontiguousarray((low & 255).astype(np.uint8).T)
            where = dict(zip(full.tolist(), range(len(full)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    pa.array([keys[where[d]].view(np.int64) if d in where else None for d in range(len(n))], pa.list_(pa.int64())),
                    pa.array([sig[where[d]].tobytes() if d in where else None for d in range(len(n))], pa.binary()),
                ],
                names=["doc_id", "th", "n", "k1", "k2", "bands", "sig"],
            )

    return B.bounded(kept).mapInArrow(run, "doc_id long, th long, n long, k1 long, k2 long, bands array<long>, sig binary")


def _promising(pairs: DataFrame, limits: list[int]) -> DataFrame:
    """The pairs (with sig_a, sig_b) that survive the sequential comparison."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
            alive, seen = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for i, least in enumerate(limits):
                cut = slice(i * BATCH, (i + 1) * BATCH)
                seen[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
                alive = alive[seen[alive] >= least]
            yield batch.take(pa.array(alive)).select(["a", "b"])

    return B.bounded(pairs.select("a", "b", "sig_a", "sig_b")).mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (with text_a, text_b) whose full sets reach the threshold."""

    def run(batches):
        memory: OrderedDict[str, set] = OrderedDict()

        def full(text: str) -> set:
            if text not in memory:
                w = text.encode().translate(bytes(_LOWER)).split()
                memory[text] = set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)}
                if len(memory) > 32:
                    memory.popitem(last=False)
            return memory[text]

        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = []
            for i in range(batch.num_rows):
                x, y = full(b[i].as_py()), full(a[i].as_py())
                both = len(x & y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return B.bounded(pairs.select("a", "b", "text_a", "text_b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, comp), comp the smallest node of the component.

    Alternates: every node takes the smallest label of its neighbours, then the
    label's own label; each round is written to the shared folder.  A node
    with very many links only ever meets them through partial aggregation or a
    join that can be split.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", "fewer")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels", "fewer")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        new = materialise(step.join(jump, "low", "left").select("node", F.least("low", "next").alias("comp"), (F.least("low", "next") != F.col("comp")).alias("moved")), "labels")
        drop(labels)
        labels = new.select("node", "comp")
        labels._rl_path = new._rl_path
        if new.filter("moved").isEmpty():
            return labels


class _Search:
    """Signatures and texts of the classes that share a bucket with another: one row a class."""

    def __init__(self, docs: DataFrame, classes: DataFrame, members: DataFrame, width: int, percent: int, miss: float):
        self.docs, self.width, self.percent = docs, width, percent
        self.limits = least_matches(percent, miss)
        some = members.select("cid").distinct()
        self.classes = materialise(classes.select("cid", "doc_id", "th", "sig").join(some, "cid", "left_semi"), "bucket-classes")
        self.texts: DataFrame | None = None

    def text_of(self, need: DataFrame) -> DataFrame:
        """(cid, text) of the classes `need` (cid), written, so that a join with it can be split.

        The documents are shuffled once, to fetch the text of each class that
        shares a bucket from its one chosen row.
        """
        if self.texts is None:
            want = self.classes.select("cid", F.col("doc_id").alias("w_doc"), F.col("th").alias("w_th"))
            rows = self.docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
            same = (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_doc"))
            found = rows.join(want.hint("shuffle_hash"), same).dropDuplicates(["th", "doc_id", "cid"])
            self.texts = materialise(found.select("cid", "text"), "class-texts")
        return materialise(self.texts.join(need, "cid", "left_semi"), "needed-texts")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs (a, b)."""
        sig = self.classes.select("cid", "sig")
        left = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
        found = materialise(_promising(left.join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b"), self.limits), "promising")
        if found.isEmpty():
            return found
        text = self.text_of(found.select(F.col("a").alias("cid")).union(found.select("b")).distinct())
        left = found.join(text.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(text.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        links = materialise(_exact(both, self.width, self.percent), "links")
        drop(text, found)
        return links


def _star(members: DataFrame, fits) -> DataFrame:
    """(a, b): every class of a bucket with the bucket's best connected class."""
    sizes = materialise(members.groupBy("bucket").agg(F.count("*").alias("m")), "bucket-sizes", "fewer")
    degree = materialise(members.join(sizes, "bucket").groupBy("cid").agg(F.sum("m").alias("degree")), "degrees", "fewer")
    best = members.join(degree, "cid").groupBy("bucket").agg(F.max(F.struct("degree", "cid", "n")).alias("p"))
    best = materialise(best.select("bucket", F.col("p.cid").alias("b"), F.col("p.n").alias("nb")), "best-connected", "fewer")
    pairs = members.join(best, "bucket").filter((F.col("cid") != F.col("b")) & fits(F.col("n"), F.col("nb")))
    return pairs.select(F.col("cid").alias("a"), "b").distinct()


def _rare_partners(texts: DataFrame, width: int, percent: int, fits) -> DataFrame:
    """(a, b): classes of different components (cid, text, n, comp) that share a shingle of both their prefixes."""

    def run(batches):
        for part in B.pieces(batches, "text", 512 << 10):
            sets, bounds = shingle_sets(part.column(1), width)
            take = pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), *(part.column(i).take(take) for i in (0, 2, 3))], names=["token", "cid", "n", "comp"])

    tokens = materialise(B.bounded(texts.select("cid", "text", "n", "comp")).mapInArrow(run, "token long, cid long, n long, comp long"), "tokens")
    often = materialise(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared-tokens", "fewer")
    # of each class its shared shingles, rarest first; those of its own come before them and fill the prefix first
    own = tokens.join(often, "token").groupBy("cid", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    prefix = own.filter(length > 0).select("cid", "n", "comp", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("i", "t"))
    prefix = prefix.select("cid", "n", "comp", "t.token", (F.col("n") - F.col("m") + F.col("i")).alias("before"))
    prefix = materialise(prefix, "prefixes")
    # the largest component among a shingle's classes only meets the others
    sizes = prefix.groupBy("token", "comp").agg(F.count("*").alias("m"))
    most = sizes.groupBy("token").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).filter(F.col("all") > F.col("top.m"))
    most = materialise(most.select("token", F.col("top.comp").alias("main")), "split-tokens", "fewer")
    prefix = materialise(prefix.join(most, "token"), "meeting")
    few = prefix.filter("comp <> main").select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("before").alias("bb"))
    # of the first shingle that both have, none of those before it is shared, and the rest must be enough
    need = F.floor((percent * (F.col("n") + F.col("nb")) + 99 + percent) / (100 + percent))
    enough = (F.col("n") - F.col("before") >= need) & (F.col("nb") - F.col("bb") >= need)
    once = (F.col("comp") == F.col("main")) | (F.col("cid") < F.col("b"))
    pairs = prefix.join(few, "token").filter((F.col("comp") != F.col("cb")) & once & enough & fits(F.col("n"), F.col("nb")))
    return pairs.select(F.col("cid").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Per row: doc_id, th (hash of the text), n_shingles, component_id, component, kept (it has the component's id).

    `component` numbers the components, also those whose ids are all null; it is null for the empty set.
    """
    bands, rows = plan(percent, miss)
    table = materialise(_fingerprints(docs, width, bands, rows), "fingerprints")
    first = F.min_by(F.struct("doc_id", "th", "n", "bands", "sig"), F.struct("doc_id", "th")).alias("r")
    # numbers are unique, and fixed once written
    classes = table.filter("n > 0").groupBy("k1", "k2").agg(first, F.min("doc_id").alias("first"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "first", "r.*"), "classes", "fewer")
    # buckets in which at least two classes meet
    each = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("bucket")
    shared = materialise(shared, "shared-buckets", "fewer")
    members = materialise(each.join(shared, "bucket", "left_semi").distinct(), "buckets")
    drop(shared)
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  (sizes allow the threshold)
    labels = None
    if not members.isEmpty():
        search = _Search(docs, classes, members, width, percent, miss)
        links = search.compare(_star(members, fits))
        labels = components(links)
        # classes that share a bucket and are in different components may still be linked
        now = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "n", F.coalesce("comp", "cid").alias("comp"))
        now = materialise(now, "labelled-buckets")
        split = materialise(now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket"), "split-buckets", "fewer")
        rest = materialise(now.join(split, "bucket", "left_semi").select("cid", "n", "comp").distinct(), "unsettled")
        drop(members, now, split)
        if not rest.isEmpty():
            more = search.compare(_rare_partners(search.text_of(rest.select("cid")).join(rest, "cid"), width, percent, fits))
            if not more.isEmpty():
                labels = components(materialise(links.union(more), "links"))
    return _result(table, classes, labels)


def _result(table: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    rows = table.select("doc_id", "th", F.col("n").alias("n_shingles"), "k1", "k2")
    classes = classes.select("cid", "k1", "k2", "first")
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        firsts = materialise(classes.filter("comp is not null").groupBy("comp").agg(F.min("first").alias("low")), "component-firsts", "fewer")
        classes = classes.join(firsts, "comp", "left").select("k1", "k2", F.coalesce("low", "first").alias("component_id"), F.coalesce("comp", "cid").alias("component"))
    else:
        classes = classes.select("k1", "k2", F.col("first").alias("component_id"), F.col("cid").alias("component"))
    classes = materialise(classes, "class-components")
    out = rows.join(classes, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "th", "n_shingles", "component_id", "component", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
