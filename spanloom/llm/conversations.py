"""Prefix trie of conversations: shared beginnings, counted by leaf-peeling message passing.

A node is a distinct sequence of first turns (role, text). Its key is depth and the exclusive-or of 128 bits of SHA-256
of each turn's place and content, so keys are running exclusive-ors and a parent's key is the child's without its turn.

Subtree totals go up by messages. A node would wait for its children one depth a round, so a chain of nodes is first
contracted: every node belongs to the path of its longest member (least id among equals), and the nodes of one path
follow each other down to a leaf. A path holds a counter of the paths that hang from it; each round, those at zero send
their totals to the paths above, and are done, until only the root's path finishes. There are as many rounds as paths
nest, not as turns follow each other. Totals are kept by the node that a path hangs from, and running sums up each
path give every node its own.

Nothing rests on a task that holds a whole key: turns are sorted by ranges that cut a long conversation too, and
numbered in streams; running values go over blocks of ``block`` turns, with the blocks' totals carried over; counts are
pre-aggregated; of nodes with more than a thousandth of all nodes as children there are a thousand at most, and these are
broadcast to their children while the others are joined. Ids of conversations that end at a node are joined in ranges
of 8,192 ids, and one task hashes a node's ranges in order as a stream, as SHA-256 goes over bytes in order: it holds
one range. Each step is a table in the shared folder; all but the result go at the end.

Defined results: turns are ordered by number, null first, and those of one number by their content's hash; null role and
text are empty; rows without conv_id belong to no conversation; repeated rows are turns of their own; remainders have
the sign of the id; an empty table has no nodes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, scratch, table

BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]


def _halves(*parts: Column) -> list[Column]:
    """128 bits of the parts' SHA-256, as two longs."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return [F.conv(F.substring(h, at, 16), 16, -10).cast("long") for at in (1, 17)]


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), a and b (128 bits of role and text) and words of the turns of each conversation.

    Sorted by ranges of (conv_id, turn); each task numbers its rows in order, and a conversation that goes on in the next
    task is carried over by a table of a row a task."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b = _halves(F.length(role), role, text)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), a.alias("a"), b.alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # parts equal rows
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, "_row").sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = np.asarray(batch["conv_id"])
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            sizes = np.diff(np.r_[starts, len(conv)])
            rank = np.arange(1, len(conv) + 1) - np.repeat(starts, sizes)
            if conv[0] == last:
                rank[: sizes[0]] += count
            last, count = conv[-1], int(rank[-1])
            yield pa.record_batch([pa.array(np.full(len(conv), part, "int32")), batch["conv_id"], pa.array(rank, pa.int64()), batch["a"], batch["b"], batch["words"]], names=["part", "conv_id", "rank", "a", "b", "words"])

    made = materialize(rows.select("conv_id", "a", "b", "words").mapInArrow(number, "part int, conv_id long, rank long, a long, b long, words long"), "turns")
    ends = made.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "rank")).alias("last")).orderBy("part").collect()  # a row a task
    carried, open_, so_far = [], None, 0
    for r in ends:
        before = so_far if r["first"] == open_ else 0
        if before:
            carried.append((r["part"], r["first"], before))
        open_, so_far = r["last"]["conv_id"], r["last"]["rank"] + (before if r["last"]["conv_id"] == r["first"] else 0)
    more = F.broadcast(spark.createDataFrame(carried, "part int, conv_id long, before long"))
    return made.join(more, ["part", "conv_id"], "left").select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "a", "b", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and their turns (conv_id, size, block, depth, a, b, words), each begun by the first
    h turns of its group's first conversation in place of its own; h is below ``most``."""
    turns = materialize(numbered(turns), "ranks")
    few = F.array_sort(F.collect_list(F.when(F.col("rank") < most, F.struct("rank", "a", "b", "words"))))
    own = turns.groupBy("conv_id").agg(F.max("rank").alias("n"), few.alias("head"))
    own = materialize(own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % group}), "own")
    bases = own.select(F.col("conv_id").alias("base"), F.col("head").alias("shared"))
    begun = own.join(bases, "base", "left").withColumn("shared", F.filter("shared", lambda x: x["rank"] <= F.col("h")))
    begun = begun.withColumn("m", F.coalesce(F.size("shared"), F.lit(0)).cast("long"))
    begun = materialize(begun.select("conv_id", "n", "h", "m", "shared", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "begun")
    front = begun.select("conv_id", "size", F.lit(0).cast("long").alias("block"), F.explode("shared").alias("x"))
    front = front.select("conv_id", "size", "block", F.col("x.rank").alias("depth"), "x.a", "x.b", "x.words")
    shift = begun.select("conv_id", "size", "h", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {block}"))).alias("block"))
    rest = turns.withColumn("block", F.expr(f"rank div {block}")).join(shift, ["conv_id", "block"]).filter("rank > h")
    rest = rest.select("conv_id", "size", "block", (F.col("m") + F.col("rank") - F.col("h")).alias("depth"), "a", "b", "words")
    return begun.select("conv_id", "size"), front.unionByName(rest)


def _carried(rows: DataFrame, key: str, long_: Column, totals: dict[str, Column], later: bool) -> DataFrame:
    """(key, block, the totals over the blocks before or, if ``later``, behind) of the long ones among the keys."""
    sums = rows.filter(long_).groupBy(key, "block").agg(*(t.alias(n) for n, t in totals.items()))
    w = Window.partitionBy(key).orderBy(F.desc("block") if later else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    again = F.bit_xor if not later else F.sum
    return sums.select(key, "block", *(again(n).over(w).alias(n) for n in totals))


def members(turns: DataFrame, **options) -> DataFrame:
    """A row for each conversation and each of its nodes: conv_id, size (its turns), depth, k1, k2, p1, p2 (the parent's
    key) and words (of the node's last text)."""
    block = options.get("block", BLOCK)
    convs, rows = rebuilt(turns, **options)
    one, two = _halves(F.col("depth"), F.col("a"), F.col("b"))
    rows = materialize(rows.select("conv_id", "size", "block", "depth", one.alias("h1"), two.alias("h2"), "words"), "places")
    before = _carried(rows, "conv_id", F.col("size") >= block - 4, {"c1": F.bit_xor("h1"), "c2": F.bit_xor("h2")}, False)
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda i: F.bit_xor(f"h{i}").over(w).bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long")))
    keyed = rows.join(before, ["conv_id", "block"], "left").withColumns({"k1": key(1), "k2": key(2)})
    keyed = keyed.select("conv_id", "size", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "words")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", "size", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"))
    return materialize(root.unionByName(keyed), "members")


def _nodes(rows: DataFrame) -> DataFrame:
    """The nodes with their path, the path's leaf depth, and the parent's conv_id and path (null for the root)."""
    longest = F.max(F.struct("size", (-F.col("conv_id")).alias("conv_id"))).alias("_long")
    nodes = rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), longest, F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = materialize(nodes.withColumns({"path": -F.col("_long.conv_id"), "size": F.col("_long.size")}).drop("_long"), "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    many = nodes.count() // 1000
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), "n_children")
    link = ["depth", "p1", "p2"]
    few = F.broadcast(up.filter(F.col("n_children") > many).drop("n_children"))  # below a thousand
    tried = nodes.filter("depth > 0").join(few, link, "left")
    hot = tried.filter("parent_path IS NOT NULL")
    rest = tried.filter("parent_path IS NULL").drop("parent_path", "parent_conv_id").join(up.filter(F.col("n_children") <= many).drop("n_children"), link)
    none = F.lit(None).cast("long")
    root = nodes.filter("depth = 0").withColumns({"parent_conv_id": none, "parent_path": none})
    return materialize(root.unionByName(hot).unionByName(rest).drop("p1", "p2"), "linked")


def _peel(nodes: DataFrame) -> DataFrame:
    """(path, parent, at, leaves, saved): each path's totals, those of the paths below it with them, and the depth of
    the node that it hangs from."""
    top = F.col("parent_path").isNotNull() & (F.col("parent_path") != F.col("path"))
    own = nodes.groupBy("path").agg(
        F.max(F.when(top, F.col("parent_path"))).alias("parent"), F.max(F.when(top, F.col("depth") - 1)).alias("at"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    own = materialize(own, "paths")
    hanging = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("waits"))
    open_ = materialize(own.join(hanging, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "open")
    left, done = open_.count(), []
    while left:
        ready = open_.filter("waits = 0").drop("waits")
        done.append(ready)
        sent = ready.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        plus = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
        waiting = open_.filter("waits > 0").join(sent, "path", "left").withColumns({"waits": F.col("waits") - F.coalesce("_n", F.lit(0)), "leaves": plus("leaves", "_l"), "saved": plus("saved", "_s")})
        open_, before = materialize(waiting.drop("_n", "_l", "_s"), "open"), left
        left = open_.count()
        if left == before:
            raise RuntimeError(f"{left} paths wait for each other")
    all_ = done[0] if done else open_.drop("waits")
    for d in done[1:]:
        all_ = all_.unionByName(d)
    return all_


def _ends(rows: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of the nodes where conversations end."""
    last = rows.filter("depth = size").withColumn("_range", F.shiftright("conv_id", 13))
    some = last.groupBy(*NODE, "_range").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))  # conv_ids are distinct
    names = [*NODE, "ends_sha256"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for d, k1, k2, ids in zip(b["depth"], b["k1"], b["k2"], b["ids"], strict=True):
                if (d, k1, k2) != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = (d, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=names)

    return some.repartition(*NODE).sortWithinPartitions(*NODE, "_range").select(*NODE, "ids").mapInPandas(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 20, most: int = 4, block: int = BLOCK) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. turns: conv_id, turn, role, text. The result is a table in the shared folder."""
    spark = turns.sparkSession
    path = new_folder(spark, "trie")
    with scratch(spark, "trie-work"):
        rows = members(turns, group=group, most=most, block=block)
        nodes = _nodes(rows)
        sent = _peel(nodes).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        own = nodes.join(sent, ["path", "depth"], "left").withColumns({
            "block": F.expr(f"depth div {block}"),
            "leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("_l", F.lit(0)),
            "saved": (F.col("n_convs") - 1) * F.col("words") + F.coalesce("_s", F.lit(0)),
        })
        own = materialize(own.drop("_l", "_s"), "sums")
        behind = _carried(own, "path", F.col("size") >= block, {"_l": F.sum("leaves"), "_s": F.sum("saved")}, True)
        w = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        up = lambda c, m: F.sum(c).over(w) + F.coalesce(m, F.lit(0))
        whole = own.join(behind, ["path", "block"], "left").withColumns({"n_leaves": up("leaves", "_l"), "saved_tokens": up("saved", "_s")})
        out = whole.join(_ends(rows), NODE, "left")
        none = F.sha2(F.lit(""), 256)
        out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")).write.parquet(path)
    return spark.read.schema("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string").parquet(path)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The same with whole prefixes as keys, and every node added to each of its ancestors.
SQL = r"""WITH t AS (SELECT conv_id, coalesce(role, '') "role", coalesce(text, '') txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) r FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) l FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) s FROM t)),
crc AS (SELECT conv_id, xor(list_reduce(l, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) c FROM bits),
c AS (SELECT conv_id, c % 4 h, conv_id - conv_id % 20 base FROM crc),
u AS (SELECT c.conv_id, 0 side, r, "role", txt FROM c JOIN t ON t.conv_id = c.base AND t.r <= c.h UNION ALL SELECT c.conv_id, 1, r, "role", txt FROM c JOIN t ON t.conv_id = c.conv_id AND t.r > c.h),
v AS (SELECT conv_id, row_number() OVER w d, "role", txt, array_to_string(list(md5(CAST(length("role") AS VARCHAR) || ':' || "role" || txt)) OVER w, '') k FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY side, r)),
m AS (SELECT conv_id, d, k, CAST(len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS BIGINT) words FROM v UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT d, k, count(*) n_convs, min(conv_id) conv_id, (count(*) - 1) * any_value(words) saved FROM m GROUP BY d, k),
p AS (SELECT n.*, o.k up FROM n LEFT JOIN m o ON o.conv_id = n.conv_id AND o.d = n.d - 1),
b AS (SELECT d - 1 d, up k, count(*) n_children FROM p WHERE d > 0 GROUP BY ALL),
s AS (SELECT o.d, o.k, count(*) FILTER (b.n_children IS NULL) n_leaves, CAST(sum(p.saved) AS BIGINT) saved_tokens FROM p LEFT JOIN b ON b.d = p.d AND b.k = p.k JOIN m o ON o.conv_id = p.conv_id AND o.d <= p.d GROUP BY o.d, o.k),
z AS (SELECT conv_id, max(d) d FROM m GROUP BY conv_id),
e AS (SELECT m.d, m.k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) ids FROM m JOIN z USING (conv_id, d) GROUP BY m.d, m.k)
SELECT p.conv_id, CAST(p.d AS BIGINT) "depth", q.conv_id parent_conv_id, p.n_convs, coalesce(b.n_children, 0) n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) ends_sha256
FROM p LEFT JOIN n q ON q.d = p.d - 1 AND q.k = p.up LEFT JOIN b ON b.d = p.d AND b.k = p.k JOIN s ON s.d = p.d AND s.k = p.k LEFT JOIN e ON e.d = p.d AND e.k = p.k"""
