"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

A document of ``size`` words gets the rate min(most, exp(v * size / mean size of its source)): among all rates
between 0 and ``most`` that give each source its target of words, these are nearest in entropy to one copy of
each document. v is the source's dual variable. The dual is convex and falls apart by source, so Newton steps,
kept inside a bracket, find all of them at once: each step is one aggregation over the histogram (source, size,
documents), which stands for all rows.

Targets: sources in the order of their names' code points, null last, weigh ``weights`` in turn and share the
words of all documents; no target is above ``most`` times its source's words, and the excess is shared by weight.

Rates become whole copies: the sizes of a source are cut into bins a few per cent wide, whose number has a
bound; each bin, largest first, takes the number of copies that brings the source's words nearest to what its
rates ask so far, and spreads them evenly over its documents in the order of a hash. Ranks are counted within
(source, bin, salt), so a hot source is never in one task.

Defined results: null or blank texts have size 0 and take nothing; null sources are one source; repeated rows
are documents of their own (ties of the hash are told apart by row content only, so equal rows share their copies
in any order); a mix of no words takes nothing; all columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SALTS = 64
BINS_PER_OCTAVE = 32
STEPS = 40
NEAR = 1e-9
MAX_BROADCAST = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) with target. Above the water level t a source gets its weight times t, below it
    most times its size: with sources by the level at which they fill up, prefix sums give t at once."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    known = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    known = known.withColumn("level", F.col("cap") / F.col("weight"))
    fills = Window.orderBy("level", F.col("source").isNull(), "source")
    total, full, left = F.sum("source_size").over(Window.partitionBy()), F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    level = (total - F.coalesce(full, F.lit(0.0))) / left
    known = known.withColumn("open", F.when(F.col("level") >= level, level)).withColumn("open", F.min(F.struct(F.col("open").isNull(), F.col("level"), F.col("open"))).over(Window.partitionBy())["open"])
    return known.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("open", F.lit(float("inf")))).alias("target"))


def solve(histogram: DataFrame, sources: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """sources (source, source_size, target, mean, least_size) with v, the dual variable of each source."""
    z = F.col("size") / F.col("mean")
    ratio, low = F.col("target") / F.col("source_size"), F.col("least_size") / F.col("mean")
    never = (F.col("source_size") == 0) | (F.col("target") <= 0)
    state = sources.withColumns(
        {
            "low": F.when(never, 0.0).when(ratio < 1, F.log(ratio) / low).otherwise(0.0),
            "high": F.when(never | (ratio <= 1), 0.0).otherwise(math.log(most) / low),
            "v": F.when(never | (ratio >= most), F.lit(0.0)).otherwise(F.lit(0.0)),
        }
    )
    state = materialize(state, "dual")
    for _ in range(steps):
        raw = F.exp(F.least(F.col("v") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        met = histogram.join(state.select(F.col("source").alias("_s"), "v", "mean"), F.col("source").eqNullSafe(F.col("_s")))
        sums = met.groupBy("source").agg(F.sum(words * F.least(raw, F.lit(float(most)))).alias("got"), F.sum(F.when(raw < most, words * z * raw).otherwise(0.0)).alias("slope"))
        both = state.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.coalesce(F.col("got") - F.col("target"), F.lit(0.0))
        low_, high_ = F.when(gap < 0, F.col("v")).otherwise(F.col("low")), F.when(gap > 0, F.col("v")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("v") - gap / F.col("slope"))
        inside = (newton >= low_) & (newton <= high_)
        step = F.when(F.abs(gap) <= NEAR * F.col("target"), F.col("v")).when(inside, newton).otherwise((low_ + high_) / 2)
        both = both.select(*sources.columns, low_.alias("low"), high_.alias("high"), step.alias("v"), (F.abs(gap) / F.greatest("target", F.lit(1.0))).alias("miss"))
        state = materialize(both, "dual")
        if not state.filter("miss > 1e-6 AND high > low").limit(1).count():
            break
        state = state.drop("miss")
    else:
        wide = materialize(both, "dual").filter("miss > 0.01 AND high > low").orderBy(F.desc("miss")).select("source", "miss").limit(5).collect()
        if wide:
            raise RuntimeError(f"after {steps} steps these sources miss their targets by the shares {[tuple(r) for r in wide]}")
    return state.select(*sources.columns, "v")


def _bin(size: Column) -> Column:
    """A few per cent of width; exact for small sizes; as many as the octaves of a long at most."""
    return F.when(size <= 0, F.lit(-1)).otherwise(F.floor(F.log2(size.cast("double")) * BINS_PER_OCTAVE).cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 42, out: str = "mix", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with ``out``: struct(size, source_size, target, copies, taken = copies * size)."""
    size, name, blank, bin_, salt, u, rank, before, n, copies, words, target, found = fresh(docs, *(f"_{x}" for x in "size name blank bin salt u rank before n copies words target found".split()))
    mark = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text))

    light = docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"), mark.alias("u"))
    counts = materialize(light.groupBy("source", "size", F.pmod("u", F.lit(SALTS)).cast("int").alias("salt")).agg(F.count("*").alias("n")), "sizes")
    histogram = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    per = per.withColumn("mean", F.coalesce(F.col("source_size") / F.col("_docs"), F.lit(1.0))).withColumn("least_size", F.coalesce("least_size", F.lit(1))).drop("_docs")
    per = materialize(per, "sources")
    named = per.select(F.col("source").alias("_s"), "mean", "least_size").join(targets(per.select("source", "source_size"), weights, most), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dual = solve(histogram, named.select("source", "source_size", "target", "mean", "least_size"), most)
    quota = materialize(_quotas(counts, dual, most), "quotas")

    rows = docs.withColumns({size: size_of(F.col(text)), u: mark, name: F.coalesce(F.col(source), F.lit("")), blank: F.col(source).isNull()})
    rows = rows.withColumns({bin_: _bin(F.col(size)), salt: F.pmod(F.col(u), F.lit(SALTS)).cast("int")})
    # (source, bin, salt) holds 1/64 of a bin, so the hottest source still falls into many groups
    key = [name, blank, bin_, salt]
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(u)))
    q = quota.select(
        F.coalesce("source", F.lit("")).alias(name), F.col("source").isNull().alias(blank), F.col("bin").alias(bin_), F.col("salt").alias(salt),
        *(F.col(c).alias(x) for c, x in (("before", before), ("n", n), ("copies", copies), ("source_size", words), ("target", target))),
    )
    # beyond the limit the join uses the partitioning that the ranks already have
    rows = rows.join(F.broadcast(q) if quota.limit(max_broadcast + 1).count() <= max_broadcast else q.hint("shuffle_hash"), key, "left")
    at = F.col(before) + F.col(rank)
    share = lambda j: F.floor(j * F.col(copies) / F.col(n))
    rows = rows.withColumn(found, (share(at) - share(at - 1)).cast("long"))
    made = F.struct(F.col(size).alias("size"), F.col(words).cast("long").alias("source_size"), F.col(target).alias("target"), F.col(found).alias("copies"), (F.col(found) * F.col(size)).alias("taken"))
    (result,) = fresh(docs, out)
    rows = rows.select(*docs.columns, made.alias(result))
    return rows if result == out else rows.withColumnRenamed(result, out)


def _quotas(counts: DataFrame, dual: DataFrame, most: int) -> DataFrame:
    """(source, bin, salt): copies and documents of the bin, and documents of it under lower salts."""
    d = dual.select(F.col("source").alias("_s"), "source_size", "target", "mean", "v")
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("v") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(most))))
    cells = counts.join(d, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = cells.withColumn("bin", _bin(F.col("size"))).groupBy("source", "bin", "salt", "source_size", "target").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.col("n") * F.col("size") * rate).alias("ask"))
    bins = cells.groupBy("source", "source_size", "target", "bin").agg(F.sum("m").alias("n"), F.sum("words").alias("words"), F.sum("ask").alias("ask"))
    # largest bins first; what rounding leaves over or short goes on to the next: at most 64 * 32 bins a source
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("bin", "n", "words", "ask"))))
    empty = F.array().cast("array<struct<bin:int,n:bigint,copies:bigint>>")

    def take(acc, b):
        mean = b["words"] / b["n"]
        k = F.when(b["words"] == 0, F.lit(0).cast("long")).otherwise(F.least(F.greatest(F.round((acc["owed"] + b["ask"]) / mean), F.lit(0.0)), most * b["n"].cast("double")).cast("long"))
        return F.struct((acc["owed"] + b["ask"] - k * mean).alias("owed"), F.concat(acc["done"], F.array(F.struct(b["bin"].alias("bin"), b["n"].alias("n"), k.alias("copies")))).alias("done"))

    split = bins.groupBy("source", "source_size", "target").agg(F.aggregate(ordered, F.struct(F.lit(0.0).alias("owed"), empty.alias("done")), take, lambda acc: acc["done"]).alias("b"))
    split = split.select(F.col("source").alias("_s"), F.explode("b").alias("b")).select("_s", F.col("b.bin").alias("_b"), F.col("b.n").alias("n"), F.col("b.copies").alias("copies"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("before", before).join(split, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).select("source", "bin", "salt", "source_size", "target", "before", "n", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as its copies say, in docs' own columns."""
    result, again = fresh(docs, "_mix", "_again")
    found = mix(docs, out=result, **options).filter(F.col(result)["copies"] > 0)
    return found.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(result)["copies"].cast("int")))).select(*docs.columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
