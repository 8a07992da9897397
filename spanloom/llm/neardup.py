"""Near-duplicate detection by BagMinHash.

A text is the multiset of its five-word shingles. Its signature has M components; each is the first point of
a Poisson process that falls on it. Every shingle of weight w owns the processes of the weight intervals
[0, 1), [1, 2), [2, 4), [4, 8) ... up to w; points of the last interval that lie above w are thinned out. So two
texts share a component with the probability of their weighted Jaccard likeness, and the cost grows with the
logarithm of a weight. Points are made in order of time until no component can change any more.

Steps: exact copies fall together by two hashes of the text; signatures are cut into BANDS bands of ROWS;
texts that share a band are candidates; candidates are verified by the true overlap of their multisets;
links become classes by large-star and small-star steps.

A bucket's candidates are never all paired. First each text is compared with one of each of its buckets, the lead,
and classes are formed; texts of one class need no further comparison. Buckets that still hold several classes are
left to exact prefix filtering: order the shingles of their texts from rare to frequent; two texts of likeness s or
more then share one of their first n - ceil(s * n) + 1 shingles. Texts that share such a shingle are compared if
their classes differ and if their sizes and the shingle's places in both leave room for the likeness; of two such texts one
is not of the shingle's largest class, so one side of that join is without the bulk of a large group of copies.
Thus every candidate pair is compared, is known to be of one class, or is shown to be less alike, and a group of
copies costs in proportion to its size. A pair of likeness 0.8 shares no band, and so may be missed, with
probability (1 - 0.8**ROWS)**BANDS = 3e-6.

Defined results: a null text counts as empty; texts without words are alike only if equal; a text of fewer than
five words is one shingle; rows of one doc_id with different texts are documents of their own; a class is named by
its least doc_id, or, if none of its rows has one, by a hash of its text; an empty table gives no rows. Only doc_id
and text are used; other columns are kept by keep_one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialize, new_folder, scratch, table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
MAX_BROADCAST = 500_000
MEMO = 200_000
WORD = re.compile(r"[^\x00-/:-`{-\x7f]+")
U = np.uint64
_MUL = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """uint64 hashes of a text's shingles, repeats included."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        if not words:
            return np.empty(0, U)
        if len(known) > MEMO:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U, len(words))
        n, k = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
        return _mix(sum((h[i : i + n] * _MUL[i] for i in range(k)), np.full(n, k, U)))


def signature(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint64[M] of distinct shingles and their weights."""
    unit, weight, low = _mix(shingles + _MUL[0]), counts.astype(float), np.zeros(len(shingles))
    rate = np.ones(len(unit))
    more, j = np.flatnonzero(counts > 1), 0
    extra = []
    while len(more):  # the interval [2**j, 2**(j + 1)) of the shingles whose weight reaches into it
        extra.append((_mix(shingles[more] + U(int(_MUL[1]) * (j + 1) % (1 << 64))), weight[more], np.full(len(more), 2.0**j), np.full(len(more), 2.0**j)))
        j += 1
        more = more[counts[more] > 2**j]
    if extra:
        unit, weight, low, rate = (np.concatenate(x) for x in zip((unit, weight, low, rate), *extra, strict=True))
    least, who = np.full(M, np.inf), np.zeros(M, U)
    time, made, active, block = np.zeros(len(unit)), 0, np.arange(len(unit)), max(2, -(-8 * M // len(unit)))
    while len(active):
        steps = np.arange(made + 1, made + block + 1, dtype=U) * _MUL[2]
        bits = _mix(unit[active, None] + steps[None, :])
        gaps = -np.log(((bits >> U(24)).astype(float) + 0.5) * 2.0**-40) / (rate[active, None] * M)
        times = time[active, None] + np.cumsum(gaps, axis=1)
        at = ((bits & U(0xFFFFFF)) % U(M)).astype(np.intp)
        keep = times <= least.max()
        if j:  # thin out the points above the weight
            level = low[active, None] + rate[active, None] * ((_mix(bits + _MUL[3]) >> U(11)).astype(float) * 2.0**-53)
            keep &= level < weight[active, None]
        t, a, b = times[keep], at[keep], bits[keep]
        order = np.argsort(-t)
        t, a, b = t[order], a[order], b[order]
        first, name = np.full(M, np.inf), np.zeros(M, U)
        first[a], name[a] = t, b  # the last write, so the earliest point, stays
        better = first < least
        least[better], who[better] = first[better], name[better]
        time[active] = times[:, -1]
        made += block
        active = active[time[active] < least.max()]
    return who


def band_hashes(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=U) * _MUL[4]
    for i in range(ROWS):
        h = _mix(h ^ parts[:, i]) * _MUL[0] + U(i)
    return h.view(np.int64)


def distinct(shingles: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the second, third, ... of equal shingles get hashes of their own."""
    s = np.sort(shingles)
    if len(s) > 1 and (again := s[1:] == s[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], ~again]))
        nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        s = np.sort(np.where(nth > 0, _mix(s + nth.astype(U) * _MUL[3]), s))
    return s


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one, two = _text_hashes(F.col("text"))
    return rows.select("doc_id", one.alias("h1"), two.alias("h2"), "text")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b in batches:
        out = []
        for text in b["text"].to_pylist():
            s = shingler(text)
            out.append(band_hashes(signature(*np.unique(s, return_counts=True))) if len(s) else None)
        yield pa.record_batch([b["doc_id"], b["h1"], b["h2"], pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b in batches:
        sets = [distinct(shingler(t)) for t in b["text"].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        every = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, U), *sets]).view(np.int64))
        yield pa.record_batch([b["node"], every], names=["node", "shingles"])


def _sets(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy().view(U)
    return [values[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(map(overlap, _sets(b["x"]), _sets(b["y"])))
        yield pa.record_batch([b["a"], b["b"], pa.array(found, pa.float64())], names=["a", "b", "likeness"])


def _small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df marked for broadcast if it has up to most rows; beyond that Spark joins it by key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Texts:
    """The distinct texts (nodes) of a table, their bands, and the rows' links to them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str) -> None:
        bounded_batches(docs.sparkSession)
        self.keyed = _keyed(docs, doc_id, text)
        self.rows = materialize(self.keyed.mapInArrow(_bands, "doc_id long, h1 long, h2 long, bands array<long>"), "bands")
        named = materialize(self.rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "texts")
        # a node is named by the first hash; of texts that share it, all but one by the second
        clash = materialize(named.groupBy("h1").agg(F.min("h2").alias("_own"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "clash")
        node = F.when(F.col("_own").isNull() | (F.col("_own") == F.col("h2")), F.col("h1")).otherwise(F.col("h2"))
        self.nodes = named.join(_small(clash), "h1", "left").select(node.alias("node"), "h1", "h2", "least", "bands")

    def stars(self) -> DataFrame:
        """(node, lead): every node with the lead of each bucket that it shares with others: of the bucket's texts the
        one that meets most others in its buckets, as the middle of a group does."""
        members = self.nodes.select(F.explode("bands").alias("bucket"), "node")
        several = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        shared = materialize(members.join(several, "bucket").select("bucket", "node", "n"), "members")
        known = shared.drop("n").join(shared.groupBy("node").agg(F.sum("n").alias("fame")), "node")
        leads = known.groupBy("bucket").agg(F.max(F.struct("fame", "node"))["node"].alias("lead"))
        return shared.join(leads, "bucket").filter("node <> lead").select("node", "lead").distinct()

    def shingles(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the given nodes, from one row that has the text."""
        wanted = materialize(nodes.join(self.nodes.select("node", "h1", "h2", F.col("least").alias("_least")), "node"), "wanted")
        same = F.col("doc_id").eqNullSafe(F.col("_least"))
        texts = self.keyed.join(_small(wanted), ["h1", "h2"]).filter(same).select("node", "text")
        return materialize(texts.mapInArrow(_shingles, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")


def _alike(known: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are alike enough; known: (node, shingles)."""
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_likeness, "a long, b long, likeness double").filter(F.col("likeness") >= similarity).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the least node of the component."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        ends = now.union(now.select("v", "u"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = materialize(star, "edges")
        ends = now.select(F.col("u").alias("k"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(now.select("v", F.lit(0), F.lit(1)))
        per = ends.groupBy("k").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not per.filter("below > 1 OR below + above > 1").limit(1).count():  # each node below one root
            break
    stars = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different labels that may be alike, of sets (node, label, shingles); no pair that is alike is missing."""
    entries = materialize(sets.select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "entries")
    shared = entries.groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1")
    ordered = entries.join(shared, "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    alone = F.col("n") - F.size("s")  # shingles that no other text has come first
    need = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    first = ordered.select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.greatest(need - alone, F.lit(0)).cast("int"))).alias("k", "s"))
    first = materialize(first.select(F.col("s.shingle").alias("shingle"), "node", "label", "n", (F.col("alone") + F.col("k")).alias("place")), "prefixes")
    sizes = first.groupBy("shingle", "label").agg(F.count("*").alias("size")).groupBy("shingle").agg(F.count("*").alias("labels"), F.max(F.struct("size", "label")).alias("most"))
    mixed = materialize(first.join(sizes.filter("labels > 1").select("shingle", F.col("most.label").alias("most")), "shingle"), "mixed")
    few = mixed.filter("label <> most").select("shingle", *(F.col(c).alias(f"_{c}") for c in ("node", "label", "n", "place")))
    least = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("_n")) - 1e-9  # what alike sets share
    fits = (F.least("n", "_n") >= similarity * F.greatest("n", "_n") - 1e-9) & (F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) >= least)
    met = few.join(mixed.drop("most"), "shingle").filter((F.col("label") != F.col("_label")) & fits)
    return met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _labels(texts: Texts, similarity: float) -> DataFrame:
    """(node, label) of the nodes that have links; label is the least node of the class."""
    stars = materialize(texts.stars(), "stars")
    known = texts.shingles(stars.select("node").union(stars.select("lead")).distinct())
    links = materialize(_alike(known, stars.select(F.col("node").alias("a"), F.col("lead").alias("b")), similarity), "links")
    labels = materialize(components(links), "labels")
    named = stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("lead").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("lead")
    left = named.join(mixed, "lead").select("node", "label").distinct()
    pairs = prefix_pairs(left.join(known, "node"), similarity)
    more = materialize(_alike(known, materialize(pairs, "pairs"), similarity), "links")
    return materialize(components(links.union(more)), "labels") if more.limit(1).count() else labels


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: doc_id, class_id (the least id of its class), label (one of each class), h1, h2 (hashes of its text)."""
    path = new_folder(docs.sparkSession, "classes")
    with scratch(docs.sparkSession, "classes"):
        texts = Texts(docs, doc_id, text)
        labels = _labels(texts, similarity)
        light = texts.nodes.select("node", "h1", "h2", "least")
        least = labels.join(light, "node").groupBy("label").agg(F.min("least").alias("_least"))
        named = light.join(labels.join(least, "label"), "node", "left")
        named = named.select("h1", "h2", F.coalesce("_least", "label", "least", "h1").alias("class_id"), F.coalesce("label", "node").alias("label"))
        texts.rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).write.parquet(path)
    return docs.sparkSession.read.schema("h1 long, h2 long, doc_id long, class_id long, label long").parquet(path)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the one with the least id; all its columns."""
    found = classes(docs, doc_id, text, similarity)
    k, one, two, n = fresh(docs, "_k", "_h1", "_h2", "_n")
    ids = materialize(found.select(F.coalesce("doc_id", "h1").alias(k), F.col("h1").alias(one), F.col("h2").alias(two), "label").groupBy(k, one, two).agg(F.min("label").alias("c"), F.count("*").alias(n)), "kept")
    first = ids.groupBy("c").agg(F.min(F.struct(k, one, two)).alias("f")).select(F.col(f"f.{k}").alias(k), F.col(f"f.{one}").alias(one), F.col(f"f.{two}").alias(two))
    gone = materialize(ids.join(first, [k, one, two], "left_anti").select(k, one, two), "gone")
    h1, h2 = _text_hashes(F.coalesce(F.col(text), F.lit("")))
    df = docs.withColumns({one: h1, two: h2}).withColumn(k, F.coalesce(F.col(doc_id).cast("long"), F.col(one)))
    df = df.join(_small(gone), [k, one, two], "left_anti")
    again = ids.filter(F.col(n) > 1).join(first, [k, one, two]).select(k, one, two)
    if again.limit(1).count():  # the same id and text in several rows: one of them stays
        again = materialize(again, "again")
        single = df.join(_small(again), [k, one, two], "left_anti")
        df = single.unionByName(df.join(_small(again), [k, one, two], "left_semi").dropDuplicates([k, one, two]))
    return df.select(*docs.columns)


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id")
