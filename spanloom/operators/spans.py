"""Operators on time-ordered spans: islands, interval and as-of joins, windows with overlap, walls.

Times are whole milliseconds, so thresholds are exact. A recording's rows are ordered in one task, as each island
depends on its predecessors; recordings are spread by hash, and a long one spills to disk. Joins by time are cut into
bins, so that a long recording is spread over many tasks too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, order: Sequence[str], starts: Column, out: str = "island") -> DataFrame:
    """Numbers the runs of each key from 1; a row where ``starts`` is true begins one, as does the first row.
    ``starts`` may use lag(); null counts as false."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = df.withColumn("_starts", F.when(F.row_number().over(w) == 1, 1).when(starts, 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def neighbours(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds prev_end and next_start: of the rows beside this one; null at the ends."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"prev_end": F.lag("end_ms").over(w), "next_start": F.lead("start_ms").over(w)})


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_ms: int) -> DataFrame:
    """All pairs of one key whose spans [start_ms, end_ms) overlap; right columns get the prefix ``r_``.

    Both sides are dealt to bins of time, and a pair is made only in the bin where the later span begins: an equi-join
    on (key, bin) instead of a comparison of all spans of a key. bin_ms: about the length of a usual span.
    """
    cut = lambda d: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor(F.greatest("start_ms", "end_ms") / bin_ms))))
    r = cut(right).select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.col("_bin"), F.col(key).alias("_key"))
    met = cut(left).withColumn("_key", F.col(key)).join(r, ["_key", "_bin"])
    real = (F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("end_ms"))
    once = F.floor(F.greatest("start_ms", "r_start_ms") / bin_ms) == F.col("_bin")
    return met.filter(real & once).drop("_key", "_bin")


def overlap_counts(spans: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, id_, n): how many other spans of its key overlap each span [start_ms, end_ms); without any it has no row.

    Spans that begin before it ends, less those that end before it begins: two running counts over the key's points in
    time, so no pair is made. A span of no length overlaps those that it lies inside."""
    empty = F.col("start_ms") == F.col("end_ms")
    same = F.count("*").over(Window.partitionBy(key, "start_ms", "end_ms"))
    rows = spans.select(key, id_, "start_ms", "end_ms", F.when(empty, same).otherwise(-1).alias("_own"))
    # at one time: ask for the beginnings before it, then beginnings, ends, and ask for the ends up to it
    points = F.explode(F.array(
        F.struct(F.col("end_ms").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("kind")),
        F.struct(F.col("end_ms").alias("t"), F.lit(2).alias("kind")), F.struct(F.col("start_ms").alias("t"), F.lit(3).alias("kind")),
    ))
    rows = rows.select(key, id_, "_own", points.alias("_p")).select(key, id_, "_own", "_p.t", "_p.kind")
    w = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda k: F.count(F.when(F.col("kind") == k, 1)).over(w)
    told = rows.withColumns({"_b": run(1), "_e": run(2)}).filter("kind IN (0, 3)")
    n = F.sum(F.when(F.col("kind") == 0, F.col("_b") + F.col("_own")).otherwise(-F.col("_e")))
    return told.groupBy(key, id_).agg(n.alias("n")).filter("n > 0")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Sequence[str], later: bool = False) -> DataFrame:
    """left with the ``take`` columns of right's latest row at or before left_time (``later``: the earliest at or
    after it), null if there is none. Ties go to the greatest (later: the least) take values. One shuffle and one
    sort of both sides together; no pair is made."""
    got = F.struct(*(F.col(c) for c in take))
    a = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(got).schema[0].dataType).alias("_got"))
    b = right.select(F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), got.alias("_got"))
    time = F.desc("_time") if later else F.asc("_time")
    tie = F.desc("_got") if later else F.asc("_got")
    w = Window.partitionBy("_key").orderBy(time, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_got", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*(F.col("_row")[c].alias(c) for c in left.columns), *(F.col("_last")[c].alias(c) for c in take))


def walls(spans: DataFrame, others: DataFrame, key: str, slack_ms: int = 20) -> DataFrame:
    """spans with wall_before, the latest end of others up to start_ms + slack_ms, and wall_after, the earliest start
    of others from end_ms - slack_ms."""
    ends = others.select(key, F.col("end_ms").alias("wall_before"))
    starts = others.select(key, F.col("start_ms").alias("wall_after"))
    df = spans.withColumns({"_from": F.col("start_ms") + slack_ms, "_to": F.col("end_ms") - slack_ms})
    df = as_of(df, ends, key, "_from", "wall_before", ["wall_before"])
    return as_of(df, starts, key, "_to", "wall_after", ["wall_after"], later=True).drop("_from", "_to")


def chunk_windows(durations: DataFrame, key: str, total: str, chunk_ms: int = 1_080_000, overlap_ms: int = 5_000, tail_ms: int = 1_000, longest_ms: int = 1_180_000) -> DataFrame:
    """(key, chunk, start_ms, end_ms): windows of chunk_ms that begin overlap_ms early. A last window that with its
    overlap is shorter than tail_ms joins the one before, unless that grows beyond longest_ms. A total of 0 or null has
    no window."""
    n = F.ceil(F.col(total) / chunk_ms)
    before = F.greatest(F.lit(0), (n - 2) * chunk_ms - overlap_ms)
    n = F.when((n > 1) & (F.col(total) - (n - 1) * chunk_ms + overlap_ms < tail_ms) & (F.col(total) - before <= longest_ms), n - 1).otherwise(n)
    cut = durations.filter(F.col(total) > 0).select(key, F.col(total).alias("_total"), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    start = F.greatest(F.lit(0), F.col("chunk") * chunk_ms - overlap_ms).cast("long")
    end = F.when(F.col("chunk") == F.col("_n") - 1, F.col("_total")).otherwise((F.col("chunk") + 1) * chunk_ms)
    return cut.select(key, "chunk", start.alias("start_ms"), end.cast("long").alias("end_ms"))


def stitch(words: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Of words read in overlapping windows (key, chunk, start_ms, end_ms), the reading in the window on whose side of
    the overlap's middle the word's centre lies: each word once."""
    w = Window.partitionBy(key).orderBy("chunk")
    lo = (F.col("start_ms") + F.lag("end_ms").over(w)) / 2
    hi = (F.col("end_ms") + F.lead("start_ms").over(w)) / 2
    sides = windows.select(key, "chunk", lo.alias("_lo"), hi.alias("_hi"))
    centre = (F.col("start_ms") + F.col("end_ms")) / 2
    return words.join(sides, [key, "chunk"]).filter((F.col("_lo").isNull() | (centre >= F.col("_lo"))) & (F.col("_hi").isNull() | (centre < F.col("_hi")))).drop("_lo", "_hi")


def tiered_match(clips: DataFrame, units: DataFrame, key: str, slack_ms: int = 200, bin_ms: int = 10_000) -> DataFrame:
    """(key, clip_id, unit_id, tier): a clip's units by its list of ids (1), else by its range of ids (2), else by
    time (3). clips: clip_id, unit_ids, first_id, last_id, start_ms, end_ms. A range becomes its ids, so tiers 1 and 2
    are equi-joins."""
    ids = units.select(key, "unit_id")
    one = clips.select(key, "clip_id", F.explode(F.array_distinct("unit_ids")).alias("unit_id")).join(ids, [key, "unit_id"]).withColumn("tier", F.lit(1))
    ranged = clips.filter("first_id <= last_id").select(key, "clip_id", F.explode(F.sequence("first_id", "last_id")).alias("unit_id"))
    two = ranged.join(ids, [key, "unit_id"]).withColumn("tier", F.lit(2))
    wide = clips.select(key, "clip_id", (F.col("start_ms") - slack_ms).alias("start_ms"), (F.col("end_ms") + slack_ms).alias("end_ms"))
    three = overlap_join(wide, units.select(key, "unit_id", "start_ms", "end_ms"), key, bin_ms).select(key, "clip_id", F.col("r_unit_id").alias("unit_id"), F.lit(3).alias("tier"))
    every = one.select(key, "clip_id", "unit_id", "tier").unionByName(two.select(key, "clip_id", "unit_id", "tier")).unionByName(three)
    best = F.min("tier").over(Window.partitionBy(key, "clip_id"))
    return every.withColumn("_best", best).filter("tier = _best").drop("_best")


def containment(docs: DataFrame, blocks: DataFrame, anchor: int = 12, piece: int = 64, few: int = 512) -> DataFrame:
    """(doc_id, block_id) where docs.norm contains blocks.norm; empty or null blocks are nowhere.

    A block is found by the hash of its first ``anchor`` characters, or of all if it has fewer, among the hashes at
    every place of a text: an equi-join on hashes, without texts. Texts are read in overlapping pieces, as finding a
    place costs its distance from the start. What is met is looked up once more in its text. A few small blocks, by number and
    bytes, are looked for in each text where it is read."""
    n, size = blocks.filter(F.length("norm") > 0).agg(F.count("*"), F.sum(F.octet_length("norm"))).first()
    if n <= few and (size or 0) <= few * 1024:
        rows = blocks.filter(F.length("norm") > 0).select("block_id", "norm").collect()
        held = F.array(*(F.struct(F.lit(r[0]).alias("block_id"), F.lit(r[1]).alias("norm")) for r in rows)) if rows else F.array().cast("array<struct<block_id:long,norm:string>>")
        met = F.filter(held, lambda b: F.contains(F.col("norm"), b["norm"]))
        return docs.filter(F.length("norm") > 0).select("doc_id", F.explode(F.transform(met, lambda b: b["block_id"])).alias("block_id"))
    blocks = blocks.filter(F.length("norm") > 0).select("block_id", F.col("norm").alias("_block"), F.least(F.length("norm"), F.lit(anchor)).alias("_n"))
    blocks = blocks.withColumn("_h", F.xxhash64("_n", F.left("_block", F.col("_n"))))
    sizes = [r[0] for r in blocks.select("_n").distinct().collect()]  # anchor values at most
    docs = docs.select("doc_id", "norm", F.xxhash64("norm").alias("_text"))
    cut = F.transform(F.sequence(F.lit(1), F.length("norm"), F.lit(piece)), lambda i: F.substring("norm", i, piece + anchor - 1))
    pieces = docs.filter(F.length("norm") > 0).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_same"), F.explode(cut).alias("_piece"))
    places = pieces.select("*", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("_n"))
    places = places.filter(F.length("_piece") >= F.col("_n")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(piece), F.length("_piece") - F.col("_n") + 1))).alias("_i"))
    places = places.select("_doc", "_same", F.xxhash64("_n", F.substring("_piece", F.col("_i"), F.col("_n"))).alias("_h"))
    met = places.join(blocks.select("_h", "block_id", "_block"), "_h").select("_doc", "_same", "block_id", "_block").distinct()
    return docs.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_same"))).filter(F.contains("norm", "_block")).select("doc_id", "block_id")
