"""Document fingerprints by one-permutation MinHash. DataFrame functions only.

The shingles (five words each; a shorter text is one shingle) are hashed once. The upper bits of a hash name
one of ``BINS`` bins, and the least hash of each bin is kept: in sorted order, the first of each bin. An empty
bin takes the value of the first filled bin in its own fixed random order of all bins (optimal densification).
The low ``BITS`` bits of each bin are stored, packed as hex. Two such values agree by chance once in 2**BITS,
which ``likeness`` corrects for.

Everything is computed inside the row, so nothing is shuffled. Defined results: a null text counts as empty; a
text without words has the fingerprint ""; two of these are alike (1.0), one and any other text are not (0.0).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table
from .decontaminate import SEPARATORS

BIN_BITS, BITS, SHINGLE = 7, 8, 5
BINS = 1 << BIN_BITS
MOST_BUCKETS = 1024


def _orders(bins: int) -> str:
    """For each bin the order in which it looks at the others when it is empty."""
    rng, out = random.Random(bins), []
    for _ in range(bins):
        order = list(range(bins))
        rng.shuffle(order)
        out.append(f"array({','.join(map(str, order))})")
    return f"array({','.join(out)})"


def fingerprint(text: str) -> Column:
    """array<tinyint> of BINS values for the text that the SQL expression names; empty if it has no words.

    ``transform(array(x), y -> body)[0]`` binds x to a name that the body uses more than once.
    """
    shift = 64 - BIN_BITS
    at = lambda x: f"CAST(shiftright({x}, {shift}) + {BINS // 2} AS int)"
    words = f"array_remove(split(lower(coalesce({text}, '')), r'{SEPARATORS}'), '')"
    shingles = f"IF(size(h) = 0, CAST(array() AS array<bigint>), transform(sequence(1, greatest(size(h) - {SHINGLE - 1}, 1)), i -> xxhash64(slice(h, i, {SHINGLE}))))"
    least = "filter(s, (x, i) -> i = 0 OR shiftright(x, %d) <> shiftright(get(s, i - 1), %d))" % (shift, shift)
    gap = f"array_repeat(CAST(NULL AS bigint), {at('x')} - IF(i = 0, 0, {at('get(m, i - 1)')} + 1))"
    tail = f"array_repeat(CAST(NULL AS bigint), {BINS - 1} - {at('element_at(m, -1)')})"
    dense = f"concat(flatten(transform(m, (x, i) -> concat({gap}, array(x)))), {tail})"
    filled = f"IF(size(m) = {BINS}, d, transform(d, (x, i) -> IF(x IS NOT NULL, x, get(d, get(filter({_orders(BINS)}[i], j -> get(d, j) IS NOT NULL), 0)))))"
    low = f"transform({filled}, x -> CAST((x & {(1 << BITS) - 1}) - {1 << (BITS - 1)} AS tinyint))"
    body = f"IF(size(m) = 0, CAST(array() AS array<tinyint>), transform(array({dense}), d -> {low})[0])"
    return F.expr(f"transform(array(transform({words}, x -> xxhash64(x))), h -> transform(array(sort_array({shingles})), s -> transform(array({least}), m -> {body})[0])[0])[0]")


def packed(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda x: F.lpad(F.lower(F.hex((x + (1 << (BITS - 1))).cast("long"))), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The shingle sets' Jaccard likeness, 0 to 1, from two fingerprints."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest((same - chance) / (1 - chance), F.lit(0.0)))


def with_next(docs: DataFrame, key: str, text: str, out: str, add: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """docs(key, text, ...) with ``out``: struct of all columns of the row that follows in descending order of
    key (after the last: the first). Rows of one key follow in the order of their texts, nulls come last.
    add: columns to compute from the row's own; they are part of the struct too.

    Buckets of the key's range are ordered on their own; each also gets a copy of the first row of the next.
    """
    spark = docs.sparkSession
    bucket, first, place, of, nth = fresh(docs, "_bucket", "_first", "_place", "_of", "_nth")
    n = min(buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    cuts = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cut = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))).cast("array<bigint>")
    rank = F.when(F.col(key).isNull(), F.lit(MOST_BUCKETS + 1)).otherwise(F.size(F.filter(cut, lambda c: F.col(key) < c)))
    placed = docs.withColumn(bucket, rank)
    # a row for each bucket, of which there are MOST_BUCKETS + 1 at most
    tops = placed.groupBy(bucket).agg(F.max(key).alias(first))
    ring = Window.orderBy(bucket)
    tops = tops.withColumn(place, F.coalesce(F.lag(bucket).over(ring), F.max(bucket).over(Window.partitionBy())))
    order = [F.desc_nulls_last(key), F.asc(text)]
    heads = placed.join(F.broadcast(tops.withColumnRenamed(bucket, of)), (F.col(bucket) == F.col(of)) & F.col(key).eqNullSafe(F.col(first)))
    heads = heads.withColumn(nth, F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col(nth) == 1)
    heads = heads.withColumn(bucket, F.col(place)).withColumn(place, F.lit(1)).select(*docs.columns, bucket, place)
    both = placed.withColumn(place, F.lit(0)).select(*docs.columns, bucket, place)
    both = both.withColumns(add or {}).unionByName(heads.withColumns(add or {}))  # of the heads, after there are few
    follow = F.lead(F.struct(*docs.columns, *(add or {}))).over(Window.partitionBy(bucket).orderBy(place, *order))
    return both.withColumn(out, follow).filter(F.col(place) == 0).drop(bucket, place)


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs, "doc_id", "text", "next", {"bits": fingerprint("text")})
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.col("next")["text"], F.lit(1), k)))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "bits", F.col("next")["bits"].alias("next_bits"), fingerprint("edited").alias("edited_bits"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
