"""Benchmark decontamination by a broadcast set of normalised test n-grams. DataFrame functions only.

Words: A-Z lower-cased, then the runs of digits, a-z and characters beyond ASCII. A window is ``n``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A word of a
document is hit if it lies inside an occurrence of a window.

Plan: the items' windows are few and are gathered on the driver; up to ``max_broadcast`` of them go to the
executors as a hash set inside the task binary, which Spark broadcasts. Each document is scanned in place,
without a shuffle: word hashes once, window hashes by position, set lookup, then a comparison of the words
themselves. A larger benchmark is never gathered: its windows stay a table, and window hashes of the
documents are joined to it (``_located_by_join``).

Defined results: a null text has no words; null or repeated doc_ids are rows of their own; repeated items
count once by item_id; an item with a null id marks words but is never listed; with an empty benchmark
nothing is hit. All columns of the input are kept; working columns get names that clash with none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

N = 13
MAX_BROADCAST, MAX_BYTES = 200_000, 32 << 20
SEPARATORS = r"[\x00-/:-`{-\x7f]+"
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "array<struct<pos:int,len:int>>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), AZ, az), SEPARATORS), "")


def windows(bench: DataFrame, n: int = N, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(gram, folded, len, item): the distinct windows of the items; folded: the hash that documents are scanned for."""
    items = bench.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    cut = items.select("item", "w", at.alias("at"))
    part = lambda c: F.slice(c, F.col("at"), F.least(F.size("w"), F.lit(n)))
    return cut.select(
        F.array_join(part("w"), " ").alias("gram"),
        F.xxhash64(F.transform(part("w"), lambda x: F.xxhash64(x))).alias("folded"),
        F.size(part("w")).alias("len"),
        F.xxhash64(F.element_at(part("w"), 1)).alias("head"),
        "item",
    ).distinct()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _numbers(values) -> str:
    """An IN list; the least long has no literal of its own."""
    return ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in sorted(values))


def _split_sql(text: str) -> str:
    return f"array_remove(split({text}, r'{SEPARATORS}'), '')"


def _located_by_set(df: DataFrame, text: str, grams: list, n: int, out: str) -> DataFrame:
    """Adds out: (n_words, hits) by functions of each row's own text; no shuffle."""
    (scan,) = fresh(df, "_scan")
    long_, short = {g.folded for g in grams if g.len == n}, [g for g in grams if g.len < n]
    none, found = f"CAST(array() AS {HITS})", []
    if long_:
        at = f"filter(sequence(1, greatest(size(h) - {n - 1}, 1)), i -> xxhash64(slice(h, i, {n})) IN ({_numbers(long_)}))"
        found.append(f"IF(size(h) >= {n}, transform({at}, i -> named_struct('pos', i, 'len', {n})), {none})")
    if short:
        at = f"filter(sequence(1, size(h)), i -> h[i - 1] IN ({_numbers({g.head for g in short})}))"
        each = ", ".join(f"named_struct('pos', i, 'len', {k})" for k in sorted({g.len for g in short}))
        fits = f"s.pos + s.len - 1 <= size(h) AND xxhash64(slice(h, s.pos, s.len)) IN ({_numbers({g.folded for g in short})})"
        found.append(f"IF(size(h) > 0, filter(flatten(transform({at}, i -> array({each}))), s -> {fits}), {none})")
    found = f"concat({', '.join(found)})" if found else none
    folded = f"translate(coalesce({_quoted(text)}, ''), '{AZ}', '{az}')"
    # array(x) with transform(..)[0] binds x to a name once per row
    df = df.withColumn(scan, F.expr(f"transform(array(transform({_split_sql(folded)}, x -> xxhash64(x))), h -> named_struct('n_words', size(h), 'found', CAST({found} AS {HITS})))[0]"))
    if grams:
        texts = ", ".join(f"'{g}'" for g in sorted({g.gram for g in grams}))  # a word holds no quote and no backslash
        exact = f"transform(array({_split_sql(folded)}), v -> filter({scan}.found, s -> array_join(slice(v, s.pos, s.len), ' ') IN ({texts})))[0]"
        hits = F.expr(f"IF(size({scan}.found) > 0, {exact}, {none})")
    else:
        hits = F.expr(none)
    return df.withColumn(out, F.struct(F.col(scan)["n_words"].cast("long").alias("n_words"), hits.alias("hits"))).drop(scan)


def _located_by_join(df: DataFrame, text: str, grams: DataFrame, n: int, out: str) -> DataFrame:
    """The same for a benchmark of any size. What is hit depends on the text alone, so each distinct text is looked at once,
    under its SHA-256, which stays the same when a lost executor's rows are read again. Its windows' hashes are joined to
    those of the benchmark; the window itself comes with a hit only and is compared with the text."""
    key, w, at, k, folded, gram = fresh(df, "_key", "_w", "_at", "_k", "_folded", "_gram")
    df = df.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    scan = df.select(key, F.col(text).alias(w)).groupBy(key).agg(F.first(w).alias(w)).select(key, words(F.col(w)).alias(w))
    lens = [r[0] for r in grams.select("len").distinct().collect()]  # n values at most
    cut = scan.withColumn(k, F.explode(F.array(*map(F.lit, lens)).cast("array<int>"))).filter(F.size(w) >= F.col(k))
    hashed = cut.select(key, k, F.transform(w, lambda x: F.xxhash64(x)).alias(w))
    places = hashed.select(key, k, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(w) - F.col(k) + 1), lambda i: F.xxhash64(F.slice(w, i, F.col(k))))).alias(at, folded))
    met = places.join(grams.select(F.col("folded").alias(folded), F.col("len").alias(k), F.col("gram").alias(gram)).distinct(), [folded, k])
    met = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col(at) + 1).alias("pos"), F.col(k).alias("len"), F.col(gram).alias("gram")))).alias(at))
    both = df.join(met, key, "left").withColumn(w, words(F.col(text)))
    real = F.filter(at, lambda s: F.array_join(F.slice(F.col(w), s["pos"], s["len"]), " ") == s["gram"])
    hits = F.coalesce(F.transform(real, lambda s: F.struct(s["pos"].alias("pos"), s["len"].alias("len"))), F.array().cast(HITS))
    return both.withColumn(out, F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))).drop(key, w, at)


def _few(grams: DataFrame, max_broadcast: int) -> bool:
    """Whether windows are few and small enough to stand in an expression, or to go to all tasks."""
    n, size = grams.agg(F.count("*"), F.sum(F.octet_length("gram"))).first()
    return n <= max_broadcast and (size or 0) <= MAX_BYTES


def locate(docs: DataFrame, bench: DataFrame, n: int = N, text: str = "text", bench_text: str = "text", item_id: str = "item_id", max_broadcast: int = MAX_BROADCAST, out: str = "hit") -> DataFrame:
    """docs with a column ``out``: struct(n_words long, hits array<struct(pos, len)>), pos from 1, in words."""
    (name,) = fresh(docs, out)
    grams = windows(bench, n, bench_text, item_id).select("gram", "folded", "len", "head").distinct()
    df = _located_by_set(docs, text, grams.collect(), n, name) if _few(grams, max_broadcast) else _located_by_join(docs, text, grams, n, name)
    return df if name == out else df.withColumnRenamed(name, out)


def covered(hits: Column) -> Column:
    """The positions of the words inside hits, from 1, each once."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", n: int = N, text: str = "text", share: int = 20, **options) -> DataFrame:
    """mode "documents": docs without those of which a 20th or more of the words is hit; "spans": every row,
    the hit words taken out of its text, with the separators that follow them; "flag": every row, with
    n_words, n_hit and contaminated."""
    (hit,) = fresh(docs, "_hit")
    df = locate(docs, bench, n, text, out=hit, **options)
    n_hit = F.size(covered(F.col(hit)["hits"])).cast("long")
    if mode == "flag":
        return df.withColumns({"n_words": F.col(hit)["n_words"], "n_hit": n_hit}).withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit"), share)).drop(hit)
    if mode == "documents":
        return df.filter(~is_contaminated(F.col(hit)["n_words"], n_hit, share)).drop(hit)
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: documents, spans or flag")
    run = r"[^\x00-/:-@\[-`{-\x7f]+"
    kept = F.expr(
        f"transform(array(named_struct('s', split({_quoted(text)}, r'{run}'), 'w', regexp_extract_all({_quoted(text)}, r'{run}', 0), 'c', transform({hit}.hits, s -> sequence(s.pos, s.pos + s.len - 1)))), "
        "x -> array_join(concat(array(x.s[0]), transform(array_except(sequence(1, size(x.w)), flatten(x.c)), i -> concat(x.w[i - 1], x.s[i]))), ''))[0]"
    )
    return df.withColumn(text, F.when(F.size(F.col(hit)["hits"]) > 0, kept).otherwise(F.col(text))).drop(hit)


def report(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, item_id: str = "item_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated."""
    found = locate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), bench, n, item_id=item_id, max_broadcast=max_broadcast)
    exact = F.transform(F.array(words(F.col("text"))), lambda v: F.array_distinct(F.transform(F.col("hit")["hits"], lambda s: F.array_join(F.slice(v, s["pos"], s["len"]), " "))))[0]
    rows = found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("hit")["n_words"].alias("n_words"), F.size(covered(F.col("hit")["hits"])).cast("long").alias("n_hit"),
        F.when(F.size(F.col("hit")["hits"]) > 0, exact).otherwise(F.array().cast("array<string>")).alias("grams"),
    )
    grams = windows(bench, n, item_id=item_id).select("gram", "item").distinct()
    small = _few(grams, max_broadcast)
    parts = rows.select("row", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram"))
    parts = parts.join(F.broadcast(grams) if small else grams, "gram", "left")
    items = F.array_sort(F.collect_set("item"))
    per = parts.groupBy("row", "doc_id", "n_words", "n_hit").agg(items.alias("item_ids"))
    return per.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
