"""Queries of spans, takes, signals, audits and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import alignment, anomalies, folds, occlusion, repair, retakes, signals, similarity, spans
from spanloom.sinks import cut_table, timeline
from spanloom.sinks import edit_lists as edit_list_sink
from spanloom.sources import edit_lists, recognised

from .relations import CLIPS, SEGMENTS, WORDS, clips, segments, table, words

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



def _rec():
    return Window.partitionBy("rec_id").orderBy("seg_id")


def _time():
    return Window.partitionBy("rec_id").orderBy("start_ms", "clip_id")


def _islands_sql(condition: str) -> str:
    return f"""WITH {SEGMENTS}, g AS (SELECT *, start_ms - lag(end_ms) OVER w gap, lag(closes) OVER w shut, row_number() OVER w rn FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seg_id)),
i AS (SELECT *, CAST(sum(CASE WHEN rn = 1 OR {condition} THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY seg_id) AS BIGINT) sent_id FROM g),
a AS (SELECT rec_id, sent_id, min(start_ms) start_ms, max(end_ms) end_ms, count(*) n_segs, CAST(sum(nl) AS BIGINT) n_chars FROM i GROUP BY ALL)
SELECT *, round(CAST(n_chars AS DOUBLE) * 1000 / greatest(end_ms - start_ms, 500), 6) cps FROM a"""


def _sentences(spark, d, starts):
    df = spans.islands(segments(spark, d), "rec_id", ["seg_id"], starts(F.col("start_ms") - F.lag("end_ms").over(_rec()), F.lag("closes").over(_rec())), "sent_id")
    a = df.groupBy("rec_id", "sent_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_segs"), F.sum("nl").alias("n_chars"))
    return a.withColumn("cps", F.round(F.col("n_chars").cast("double") * 1000 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(500)), 6))


@query(_islands_sql("gap >= 550"))
def gap_segmentation(spark, d):
    return _sentences(spark, d, lambda gap, shut: gap >= 550)


@query(_islands_sql("gap >= 1000"))
def pause_split_ge_1000(spark, d):
    return _sentences(spark, d, lambda gap, shut: gap >= 1000)


@query(_islands_sql("shut"))
def closure_punct_split(spark, d):
    return _sentences(spark, d, lambda gap, shut: shut)


@query(f"""WITH {WORDS}, g AS (SELECT *, start_ms - lag(end_ms) OVER w gap, row_number() OVER w rn FROM word WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR gap >= 450 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, seg_id ORDER BY pos) part FROM g)
SELECT rec_id, seg_id, CAST(part AS BIGINT) part, min(start_ms) start_ms, max(end_ms) end_ms, string_agg(word, ' ' ORDER BY pos) text FROM i GROUP BY rec_id, seg_id, part""")
def word_gap_split(spark, d):
    w = Window.partitionBy("rec_id", "seg_id").orderBy("pos")
    df = words(spark, d).withColumn("_new", F.when((F.row_number().over(w) == 1) | (F.col("start_ms") - F.lag("end_ms").over(w) >= 450), 1).otherwise(0))
    df = df.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = df.groupBy("rec_id", "seg_id", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("rows"))
    return a.select("rec_id", "seg_id", "part", "start_ms", "end_ms", F.array_join(F.transform("rows", lambda x: x["word"]), " ").alias("text"))


@query(f"""WITH {CLIPS}, g AS (SELECT *, start_ms - lag(start_ms) OVER w gap, row_number() OVER w rn FROM clip WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms, clip_id)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR gap > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start_ms, clip_id) cluster FROM g)
SELECT rec_id, CAST(cluster AS BIGINT) cluster, count(*) n, min(start_ms) start_ms, max(start_ms) last_ms FROM i GROUP BY ALL""")
def cluster_le_gap(spark, d):
    df = spans.islands(clips(spark, d), "rec_id", ["start_ms", "clip_id"], F.col("start_ms") - F.lag("start_ms").over(_time()) > 21_600_000, "cluster")
    return df.groupBy("rec_id", "cluster").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("start_ms").alias("last_ms"))


@query(f"""WITH {CLIPS}, g AS (SELECT *, start_ms - lag(end_ms) OVER w gap, lag(event_type) OVER w before, row_number() OVER w rn FROM clip WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms, clip_id)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR gap < 0 OR gap >= 14400000 OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY start_ms, clip_id) span FROM g)
SELECT rec_id, CAST(span AS BIGINT) span, count(*) n, min(start_ms) start_ms, max(end_ms) end_ms FROM i GROUP BY ALL""")
def coalesce_spans(spark, d):
    gap = F.col("start_ms") - F.lag("end_ms").over(_time())
    df = spans.islands(clips(spark, d), "rec_id", ["start_ms", "clip_id"], (gap < 0) | (gap >= 14_400_000) | (F.lag("event_type").over(_time()) != F.col("event_type")), "span")
    return df.groupBy("rec_id", "span").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("""WITH c AS (SELECT conv_id, role, count(*) n, min(turn) seen FROM conversations GROUP BY ALL)
SELECT conv_id, role speaker, n votes FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, seen) = 1""")
def speaker_majority_vote(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("seen"))
    best = c.groupBy("conv_id").agg(F.max(F.struct("n", (-F.col("seen")).alias("s"), "role")).alias("b"))
    return best.select("conv_id", F.col("b.role").alias("speaker"), F.col("b.n").alias("votes"))


@query("SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) * 2 >= count(*) is_target FROM conversations GROUP BY conv_id")
def target_flag_majority(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.when(F.col("role") == "user", 1).otherwise(0)) * 2 >= F.count("*")).alias("is_target"))


@query("""WITH c AS (SELECT conv_id, turn, role, bool_or(role = 'user') OVER (PARTITION BY conv_id) has FROM conversations) SELECT conv_id, turn, role FROM c WHERE role = 'user' OR NOT has""")
def target_rows_or_all(spark, d):
    some = F.max(F.col("role") == "user").over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", some.alias("some")).filter((F.col("role") == "user") | ~F.col("some")).drop("some")


@query(f"""WITH {SEGMENTS}, c AS (SELECT rec_id, seg_id, dur_ms, txt, len(regexp_extract_all(txt, '[\\x{{4E00}}-\\x{{9FFF}}]')) k, len(regexp_extract_all(txt, '[A-Za-z0-9]')) a, length(regexp_replace(txt, '[ \\t\\n\\r]', '', 'g')) o FROM seg)
SELECT rec_id, seg_id, CASE WHEN txt = '' OR dur_ms <= 0 THEN 3.0::DOUBLE ELSE round(CAST(CASE WHEN k + a * 6 // 10 = 0 THEN o ELSE k + a * 6 // 10 END AS DOUBLE) * 1000 / greatest(dur_ms, 500), 6) END cps FROM c""")
def clip_cps(spark, d):
    t = F.col("text")
    said = T.count_of(t, r"[\x{4E00}-\x{9FFF}]") + F.floor(T.count_of(t, "[A-Za-z0-9]") * 6 / 10)
    n = F.when(said == 0, F.length(F.regexp_replace(t, r"[ \t\n\r]", ""))).otherwise(said)
    cps = F.round(n.cast("double") * 1000 / F.greatest(F.col("dur_ms"), F.lit(500)), 6)
    return segments(spark, d).select("rec_id", "seg_id", F.when((t == "") | (F.col("dur_ms") <= 0), 3.0).otherwise(cps).alias("cps"))


HEADS = r"WITH t AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) norm FROM documents)"


def _heads(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm(F.col("text")).alias("norm"))


@query(HEADS + " SELECT md5(left(norm, 40)) block, count(*) takes, max(doc_id) kept FROM t WHERE norm <> '' GROUP BY left(norm, 40)")
def last_take_wins(spark, d):
    return _heads(spark, d).filter("norm <> ''").groupBy(F.md5(F.left("norm", F.lit(40))).alias("block")).agg(F.count("*").alias("takes"), F.max("doc_id").alias("kept"))


@query(HEADS + " SELECT md5(norm) text_md5, count(*) copies, min(doc_id) first_id, max(doc_id) last_id FROM t GROUP BY md5(norm) HAVING count(*) > 1")
def exact_duplicate_takes(spark, d):
    return _heads(spark, d).groupBy(F.md5("norm").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("copies > 1")


@query("SELECT sha256(coalesce(text, '')) content, min(doc_id) upload, count(*) - 1 skipped FROM documents GROUP BY 1")
def content_hash_cache(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(T.text_of(F.col("text")), 256).alias("content")).agg(F.min("doc_id").alias("upload"), (F.count("*") - 1).alias("skipped"))


@query(HEADS + """, p AS (SELECT b.doc_id, (SELECT max(a.doc_id) FROM t a WHERE length(a.norm) >= 4 AND left(a.norm, 4) = left(b.norm, 4) AND a.doc_id < b.doc_id AND length(b.norm) >= length(a.norm) * 3 // 4) AS "before" FROM t b WHERE length(b.norm) >= 4)
SELECT "before", doc_id FROM p WHERE "before" IS NOT NULL""")
def opening_retake_pairs(spark, d):
    """Each text with the latest one before it that begins with the same 4 characters and of which it has three quarters
    of the length or more; texts of under 4 characters have none."""
    takes = _heads(spark, d).select(F.left("norm", F.lit(4)).alias("head"), "doc_id", F.length("norm").cast("long").alias("n")).filter("n >= 4")
    return folds.earlier_takes(takes)


@query(HEADS + r", b AS (SELECT item_id block_id, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) norm FROM benchmark) SELECT doc_id, block_id FROM t JOIN b ON b.norm <> '' AND contains(t.norm, b.norm)")
def block_containment(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("block_id"), T.norm(F.col("text")).alias("norm"))
    return spans.containment(_heads(spark, d), b)


@query(f"""WITH {CLIPS} SELECT a.rec_id, a.clip_id, count(*) n FROM clip a JOIN clip b ON a.rec_id = b.rec_id AND a.clip_id <> b.clip_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL""")
def interval_overlap_join(spark, d):
    c = clips(spark, d).select("rec_id", "clip_id", "start_ms", "end_ms")
    return spans.overlap_counts(c, "rec_id", "clip_id")


@query(f"""WITH {CLIPS} SELECT a.rec_id, a.clip_id, count(b.clip_id) n, CAST(coalesce(sum(b.clip_id), 0) AS BIGINT) ids FROM clip a LEFT JOIN clip b ON a.rec_id = b.rec_id AND b.event_type <> 'purchase' AND b.start_ms < a.start_ms + 10800000 AND b.end_ms > a.start_ms - 10800000 WHERE a.event_type = 'purchase' GROUP BY ALL""")
def window_select(spark, d):
    c = clips(spark, d).select("rec_id", "clip_id", "event_type", "start_ms", "end_ms")
    at = c.filter("event_type = 'purchase'").select("rec_id", "clip_id", (F.col("start_ms") - 10_800_000).alias("start_ms"), (F.col("start_ms") + 10_800_000).alias("end_ms"))
    met = spans.overlap_join(at, c.filter("event_type <> 'purchase'"), "rec_id", 10_800_000).select("rec_id", "clip_id", "r_clip_id")
    return at.select("rec_id", "clip_id").join(met, ["rec_id", "clip_id"], "left").groupBy("rec_id", "clip_id").agg(F.count("r_clip_id").alias("n"), F.coalesce(F.sum("r_clip_id"), F.lit(0)).alias("ids"))


@query(f"""WITH {CLIPS}, k AS (SELECT rec_id, start_ms at_ms, max(clip_id) click_id FROM clip WHERE event_type = 'click' GROUP BY ALL)
SELECT p.rec_id, p.clip_id, k.click_id FROM (SELECT * FROM clip WHERE event_type = 'purchase') p ASOF LEFT JOIN k ON p.rec_id = k.rec_id AND p.start_ms >= k.at_ms""")
def asof_latest(spark, d):
    c = clips(spark, d)
    clicks = c.filter("event_type = 'click'").select("rec_id", F.col("start_ms").alias("at_ms"), F.col("clip_id").alias("click_id"))
    return spans.as_of(c.filter("event_type = 'purchase'").select("rec_id", "clip_id", "start_ms"), clicks, "rec_id", "start_ms", "at_ms", ["click_id"]).select("rec_id", "clip_id", "click_id")


@query(f"""WITH {CLIPS}, k AS (SELECT * FROM clip WHERE event_type = 'click'), o AS (SELECT DISTINCT rec_id, start_ms, end_ms FROM clip WHERE event_type <> 'click')
SELECT k.rec_id, k.clip_id, (SELECT max(end_ms) FROM o WHERE o.rec_id = k.rec_id AND o.end_ms <= k.start_ms + 20) wall_before, (SELECT min(start_ms) FROM o WHERE o.rec_id = k.rec_id AND o.start_ms >= k.end_ms - 20) wall_after FROM k""")
def hard_walls(spark, d):
    c = clips(spark, d)
    kept = c.filter("event_type = 'click'").select("rec_id", "clip_id", "start_ms", "end_ms")
    return spans.walls(kept, c.filter("event_type <> 'click'"), "rec_id").select("rec_id", "clip_id", "wall_before", "wall_after")


@query(f"WITH {SEGMENTS} SELECT rec_id, seg_id, lag(end_ms) OVER w prev_end, lead(start_ms) OVER w next_start FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seg_id)")
def neighbor_bounds(spark, d):
    return spans.neighbours(segments(spark, d).select("rec_id", "seg_id", "start_ms", "end_ms"), "rec_id", ["seg_id"]).select("rec_id", "seg_id", "prev_end", "next_start")


TIERED = f"""WITH {SEGMENTS}, c AS (SELECT rec_id, seg_id clip_id, CASE WHEN rec_id % 3 = 0 THEN [seg_id, seg_id + 2] ELSE CAST([] AS BIGINT[]) END ids, CASE WHEN rec_id % 3 = 1 THEN seg_id END lo, seg_id + 1 hi, start_ms, end_ms FROM seg WHERE seg_id % 2 = 0),
e AS (SELECT c.rec_id, clip_id, seg_id unit_id, 1 tier FROM c JOIN seg s ON c.rec_id = s.rec_id AND list_contains(ids, s.seg_id)
UNION ALL SELECT c.rec_id, clip_id, seg_id, 2 FROM c JOIN seg s ON c.rec_id = s.rec_id AND s.seg_id BETWEEN lo AND hi
UNION ALL SELECT c.rec_id, clip_id, seg_id, 3 FROM c JOIN seg s ON c.rec_id = s.rec_id AND c.start_ms - 200 < s.end_ms AND s.start_ms < c.end_ms + 200)"""


def _tiered(spark, d):
    s = segments(spark, d)
    i, k = F.col("seg_id"), F.col("rec_id") % 3
    c = s.filter("seg_id % 2 = 0").select("rec_id", i.alias("clip_id"), F.when(k == 0, F.array(i, i + 2)).otherwise(F.array().cast("array<bigint>")).alias("unit_ids"), F.when(k == 1, i).alias("first_id"), (i + 1).alias("last_id"), "start_ms", "end_ms")
    units = s.select("rec_id", i.alias("unit_id"), "start_ms", "end_ms")
    return spans.tiered_match(c, units, "rec_id"), units


@query(TIERED + " SELECT * FROM e QUALIFY tier = min(tier) OVER (PARTITION BY rec_id, clip_id)")
def tiered_match(spark, d):
    return _tiered(spark, d)[0]


@query(TIERED + ", m AS (SELECT * FROM e QUALIFY tier = min(tier) OVER (PARTITION BY rec_id, clip_id)) SELECT rec_id, seg_id unit_id FROM seg ANTI JOIN m ON seg.rec_id = m.rec_id AND seg.seg_id = m.unit_id")
def unclaimed_anti_join(spark, d):
    met, units = _tiered(spark, d)
    return units.select("rec_id", "unit_id").join(met, ["rec_id", "unit_id"], "left_anti")


WINDOWS = f"""{SEGMENTS}, t AS (SELECT rec_id, max(end_ms) total, CAST(ceil(max(end_ms) / 20000.0) AS BIGINT) n FROM seg GROUP BY rec_id),
u AS (SELECT rec_id, total, CASE WHEN n > 1 AND total - (n - 1) * 20000 + 1000 < 1000 AND total - greatest(0, (n - 2) * 20000 - 1000) <= 1180000 THEN n - 1 ELSE n END n FROM t),
win AS (SELECT rec_id, chunk, greatest(0, chunk * 20000 - 1000) start_ms, CASE WHEN chunk = n - 1 THEN total ELSE (chunk + 1) * 20000 END end_ms FROM (SELECT *, unnest(range(n)) chunk FROM u))"""


def _windows(spark, d):
    return spans.chunk_windows(segments(spark, d).groupBy("rec_id").agg(F.max("end_ms").alias("total")), "rec_id", "total", 20_000, 1_000)


@query(f"WITH {WINDOWS} SELECT rec_id, chunk, start_ms, end_ms FROM win")
def chunk_windows(spark, d):
    return _windows(spark, d)


@query(f"""WITH {WINDOWS}, m AS (SELECT *, (start_ms + lag(end_ms) OVER w) / 2 lo, (end_ms + lead(start_ms) OVER w) / 2 hi FROM win WINDOW w AS (PARTITION BY rec_id ORDER BY chunk))
SELECT s.rec_id, s.seg_id, m.chunk FROM seg s JOIN m ON s.rec_id = m.rec_id AND s.start_ms < m.end_ms AND m.start_ms < s.end_ms WHERE (lo IS NULL OR (s.start_ms + s.end_ms) / 2 >= lo) AND (hi IS NULL OR (s.start_ms + s.end_ms) / 2 < hi)""")
def overlap_stitch(spark, d):
    w = _windows(spark, d)
    heard = spans.overlap_join(segments(spark, d).select("rec_id", "seg_id", "start_ms", "end_ms"), w.select("rec_id", "chunk", "start_ms", "end_ms"), "rec_id", 20_000)
    return spans.stitch(heard.select("rec_id", "seg_id", "start_ms", "end_ms", F.col("r_chunk").alias("chunk")), w, "rec_id").select("rec_id", "seg_id", "chunk")


FRAMES_OF = "greatest(1, CAST(round_even(CAST(end_ms - start_ms AS DOUBLE) * 24000 / 1001 / 1000, 0) AS BIGINT))"


@query(f"WITH {CLIPS}, f AS (SELECT *, {FRAMES_OF} frames FROM clip) SELECT rec_id, clip_id, frames, CAST(sum(frames) OVER (PARTITION BY rec_id ORDER BY start_ms, clip_id) AS BIGINT) - frames cursor FROM f")
def timeline_cursor(spark, d):
    f = clips(spark, d).withColumn("frames", F.greatest(F.lit(1), F.bround((F.col("end_ms") - F.col("start_ms")).cast("double") * 24000 / 1001 / 1000).cast("long")))
    return f.select("rec_id", "clip_id", "frames", (F.sum("frames").over(_time().rowsBetween(Window.unboundedPreceding, 0)) - F.col("frames")).alias("cursor"))


@query(f"WITH {CLIPS} SELECT rec_id, clip_id, CAST({FRAMES_OF} * 1001 AS VARCHAR) || '/24000s' duration FROM clip")
def rational_time(spark, d):
    rate = T.frame_rate(F.lit(23.976))
    n = F.greatest(F.lit(1), F.bround((F.col("end_ms") - F.col("start_ms")).cast("double") * 24000 / 1001 / 1000).cast("long"))
    return clips(spark, d).select("rec_id", "clip_id", F.concat((n * rate["num"]).cast("string"), F.lit("/"), rate["den"].cast("string"), F.lit("s")).alias("duration"))


@query(f"WITH {CLIPS}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, clip_id) nxt FROM clip) SELECT rec_id, clip_id, start_ms, least(end_ms, coalesce(nxt, end_ms)) end_ms, least(end_ms, coalesce(nxt, end_ms)) - start_ms < 400000 micro FROM n")
def overlap_deconflict_lag(spark, d):
    end = F.least("end_ms", F.lead("start_ms").over(_time()))
    return clips(spark, d).select("rec_id", "clip_id", "start_ms", end.alias("end_ms")).withColumn("micro", F.col("end_ms") - F.col("start_ms") < 400_000)


@query(f"""WITH {CLIPS}, n AS (SELECT *, lag(start_ms) OVER w ps, lag(end_ms) OVER w pe FROM clip WINDOW w AS (PARTITION BY rec_id ORDER BY clip_id))
SELECT rec_id, count(*) clips, count(*) FILTER (start_ms < ps) out_of_order, count(*) FILTER (start_ms >= ps AND pe - start_ms > 5) AS "overlaps", count(*) FILTER (start_ms < -10 OR end_ms > 31622400000) out_of_bounds FROM n GROUP BY rec_id""")
def timeline_integrity(spark, d):
    w = Window.partitionBy("rec_id").orderBy("clip_id")
    n = clips(spark, d).withColumns({"ps": F.lag("start_ms").over(w), "pe": F.lag("end_ms").over(w)})
    return n.groupBy("rec_id").agg(F.count("*").alias("clips"), F.count_if(F.expr("start_ms < ps")).alias("out_of_order"), F.count_if(F.expr("start_ms >= ps AND pe - start_ms > 5")).alias("overlaps"), F.count_if(F.expr("start_ms < -10 OR end_ms > 31622400000")).alias("out_of_bounds"))


AUDIT = f"""WITH {CLIPS}, q AS (SELECT *, round(value, 6) cps, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, clip_id) nxt, event_type <> 'error' locked FROM clip)"""


@query(AUDIT + """, a AS (SELECT rec_id, count(*) clips, CAST(sum(end_ms - start_ms) AS BIGINT) total_ms, max(end_ms) - min(start_ms) source_ms, round(avg(cps), 6) avg_cps, round(100.0::DOUBLE * count(*) FILTER (locked) / count(*), 6) lock_rate,
count(*) FILTER (end_ms - start_ms < 1200000) micro, count(*) FILTER (end_ms - start_ms >= 180000 AND cps < 1.2) slow, count(*) FILTER (nxt < end_ms) AS "overlaps" FROM q GROUP BY rec_id)
SELECT *, CASE WHEN lock_rate < 80 OR "overlaps" > 0 THEN 'FAIL' WHEN lock_rate < 90 OR micro > 0 OR slow > 0 THEN 'PASS' ELSE 'EXCELLENT' END grade FROM a""")
def audit_summary(spark, d):
    q = clips(spark, d).withColumns({"cps": F.round("value", 6), "nxt": F.lead("start_ms").over(_time()), "locked": F.col("event_type") != "error"})
    dur = F.col("end_ms") - F.col("start_ms")
    a = q.groupBy("rec_id").agg(
        F.count("*").alias("clips"), F.sum(dur).alias("total_ms"), (F.max("end_ms") - F.min("start_ms")).alias("source_ms"), F.round(F.avg("cps"), 6).alias("avg_cps"), F.round(F.count_if("locked") * 100.0 / F.count("*"), 6).alias("lock_rate"),
        F.count_if(dur < 1_200_000).alias("micro"), F.count_if((dur >= 180_000) & (F.col("cps") < 1.2)).alias("slow"), F.count_if(F.col("nxt") < F.col("end_ms")).alias("overlaps"),
    )
    fatal, warn = F.expr("lock_rate < 80 OR overlaps > 0"), F.expr("lock_rate < 90 OR micro > 0 OR slow > 0")
    return a.withColumn("grade", F.when(fatal, "FAIL").when(warn, "PASS").otherwise("EXCELLENT"))


RMS = f"""WITH {CLIPS}, r AS (SELECT rec_id, clip_id, start_ms, value x, sqrt(avg(value * value) OVER (PARTITION BY rec_id ORDER BY start_ms, clip_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) rms FROM clip)"""


def _rms(spark, d):
    x = F.col("value")
    return clips(spark, d).select("rec_id", "clip_id", "start_ms", x.alias("x"), F.sqrt(F.avg(x * x).over(_time().rowsBetween(0, 2))).alias("rms"))


@query(RMS + " SELECT rec_id, clip_id, round(rms, 6) rms FROM r")
def sliding_rms(spark, d):
    return _rms(spark, d).select("rec_id", "clip_id", F.round("rms", 6).alias("rms"))


@query(RMS + " SELECT rec_id, round(quantile_cont(rms, 0.1), 6) floor_rms FROM r GROUP BY rec_id")
def noise_floor_p10(spark, d):
    return _rms(spark, d).groupBy("rec_id").agg(F.round(F.percentile("rms", F.lit(0.1)), 6).alias("floor_rms"))


DB = CLIPS + """, m AS (SELECT rec_id, start_ms // 2592000000 part, avg(value * value) every, avg(value * value) FILTER (value >= 9.0) voiced FROM clip GROUP BY ALL), b AS (SELECT rec_id, part, round(20 * log10(sqrt(coalesce(voiced, every))), 6) db FROM m WHERE every > 0)"""


def _db(spark, d):
    x = F.col("value")
    m = clips(spark, d).groupBy("rec_id", F.floor(F.col("start_ms") / 2_592_000_000).alias("part")).agg(F.avg(x * x).alias("every"), F.avg(F.when(x >= 9.0, x * x)).alias("voiced"))
    return m.filter("every > 0").select("rec_id", "part", F.round(20 * F.log10(F.sqrt(F.coalesce("voiced", "every"))), 6).alias("db"))


@query(f"WITH {DB} SELECT * FROM b")
def voiced_db(spark, d):
    return _db(spark, d)


@query(f"WITH {DB}, g AS (SELECT *, lag(db) OVER (PARTITION BY rec_id ORDER BY part) - db gap FROM b) SELECT rec_id, part, round(CASE WHEN gap IS NULL OR abs(gap) < 1.5 THEN 0.0::DOUBLE ELSE least(4.5, greatest(-4.5, 0.75 * gap)) END, 5) gain_db FROM g")
def gain_match(spark, d):
    gap = F.lag("db").over(Window.partitionBy("rec_id").orderBy("part")) - F.col("db")
    return _db(spark, d).withColumn("gap", gap).select("rec_id", "part", F.round(F.when(F.expr("gap IS NULL OR abs(gap) < 1.5"), 0.0).otherwise(F.least(F.lit(4.5), F.greatest(F.lit(-4.5), 0.75 * F.col("gap")))), 5).alias("gain_db"))


@query(f"""WITH {CLIPS} SELECT rec_id, clip_id, round(CASE WHEN value >= 5.5 THEN 0.06 WHEN value <= 3 THEN 0.16 ELSE 0.16 - 0.10 * (value - 3) / 2.5 END::DOUBLE, 6) out_margin,
round(CASE WHEN value >= 5.5 THEN 0.06 WHEN value <= 3 THEN 0.14 ELSE 0.14 - 0.08 * (value - 3) / 2.5 END::DOUBLE, 6) in_margin FROM clip""")
def pacing_margins(spark, d):
    v = F.col("value")
    at = lambda slow, span: F.round(F.when(v >= 5.5, 0.06).when(v <= 3, slow).otherwise(slow - span * (v - 3) / 2.5), 6)
    return clips(spark, d).select("rec_id", "clip_id", at(0.16, 0.10).alias("out_margin"), at(0.14, 0.08).alias("in_margin"))


@query(f"""WITH {SEGMENTS}, n AS (SELECT rec_id, count(*) n, max(end_ms) total FROM seg GROUP BY rec_id)
SELECT rec_id, CAST(greatest(1024, least(500 + 55 * n, CAST(floor(42 * greatest(25, 210 - least(70, 15 + 0.05::DOUBLE * total / 1000) - 25)) AS BIGINT), 5120)) AS BIGINT) budget FROM n""")
def thinking_budget(spark, d):
    n = segments(spark, d).groupBy("rec_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("total"))
    room = F.floor(42 * F.greatest(F.lit(25.0), 210 - F.least(F.lit(70.0), 15 + F.lit(0.05) * F.col("total") / 1000) - 25))
    return n.select("rec_id", F.greatest(F.lit(1024), F.least(500 + 55 * F.col("n"), room, F.lit(5120))).cast("long").alias("budget"))


@query(f"WITH {CLIPS} SELECT rec_id, clip_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY value DESC, clip_id) AS INT) place FROM clip QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY value DESC, clip_id) <= 5")
def first_five_anomalies(spark, d):
    w = Window.partitionBy("rec_id").orderBy(F.desc("value"), "clip_id")
    return clips(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 5").select("rec_id", "clip_id", "place")


@query(f"WITH {CLIPS} SELECT rec_id, clip_id, start_ms < 31622400000 - CASE event_type WHEN 'error' THEN 2 ELSE 15 END * 86400000::BIGINT expired FROM clip")
def retention_filter(spark, d):
    days = F.when(F.col("event_type") == "error", 2).otherwise(15)
    return clips(spark, d).select("rec_id", "clip_id", (F.col("start_ms") < 31_622_400_000 - days * F.lit(86_400_000).cast("long")).alias("expired"))


@query(rf"""WITH RECURSIVE {SEGMENTS}, t AS (SELECT rec_id, seg_id, start_ms, end_ms, CASE WHEN seg_id % 10 = 6 THEN left(norm, 6) ELSE txt || CASE seg_id % 5 WHEN 1 THEN '，' WHEN 3 THEN '!' ELSE '' END || CASE WHEN seg_id % 13 = 12 THEN 'の' ELSE '' END END t FROM seg),
o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_id) rn, CAST(length(regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS BIGINT) nl, regexp_matches(rtrim(t), '(。|！|？|!|\?|……|\.\.\.)$') closes, regexp_matches(rtrim(t), '[，,、；;：:]$') clause,
  regexp_matches(trim(t), '^[A-Za-z0-9\s\-_]+$') slate, regexp_matches(t, '[\x{{3040}}-\x{{30FF}}]') kana, seg_id % 7 < 5 speaker, seg_id % 11 <> 10 target, seg_id % 6 = 4 drawn, seg_id % 4 = 1 slow FROM t),
f AS (SELECT rec_id, rn, 1::BIGINT sent_id, start_ms, end_ms, 1::BIGINT k, nl n, closes, clause, slate, kana, speaker, target, slow FROM o WHERE rn = 1 UNION ALL
SELECT o.rec_id, o.rn, CASE WHEN b THEN f.sent_id + 1 ELSE f.sent_id END, CASE WHEN b THEN o.start_ms ELSE f.start_ms END, o.end_ms, CASE WHEN b THEN 1 ELSE f.k + 1 END, CASE WHEN b THEN o.nl ELSE f.n + o.nl END, o.closes, o.clause, o.slate AND (b OR f.slate), o.kana OR (NOT b AND f.kana), o.speaker, o.target, o.slow
FROM f JOIN o ON o.rec_id = f.rec_id AND o.rn = f.rn + 1, LATERAL (SELECT o.start_ms - f.end_ms gap) g, LATERAL (SELECT gap >= 550 OR ((gap >= 200 OR o.drawn) AND f.n >= 5) OR (gap >= 250 AND f.n >= 3 AND o.nl >= 4) OR (o.end_ms - f.start_ms >= 8000 AND gap >= 120) OR f.closes
  OR (f.clause AND ((f.n >= 6 AND o.nl >= 2 AND (gap >= 120 OR (CASE WHEN f.slow THEN 300 ELSE 50 END) + greatest(gap, 0) >= 320 OR f.slow)) OR gap >= 180)) OR (f.slate AND NOT o.slate AND gap >= 150) OR f.kana <> o.kana OR f.target <> o.target OR f.speaker <> o.speaker b) h)
SELECT rec_id, sent_id, max(start_ms) start_ms, max(end_ms) end_ms, max(k) n_segs, max(n) n_chars FROM f GROUP BY rec_id, sent_id""")
def sentence_fold(spark, d):
    """Sentences of segments that now and then end with marks, are slates or hold kana, have drawn-out first or last words,
    or change their speaker."""
    i = F.col("seg_id")
    mark = F.when(i % 5 == 1, "，").when(i % 5 == 3, "!").otherwise("")
    text = F.when(i % 10 == 6, F.left("norm", F.lit(6))).otherwise(F.concat("text", mark, F.when(i % 13 == 12, "の").otherwise("")))
    seg = segments(spark, d).select("rec_id", "seg_id", "start_ms", "end_ms", text.alias("text"), F.when(i % 7 < 5, "A").otherwise("B").alias("speaker"), (i % 11 != 10).alias("target"))
    return folds.sentences(seg.withColumns({"first_ms": F.when(i % 6 == 4, 1300).otherwise(120), "first_n": F.lit(2), "last_ms": F.when(i % 4 == 1, 600).otherwise(100), "last_n": F.lit(2)}))


@query(rf"""WITH RECURSIVE {WORDS}, v AS (SELECT rec_id, seg_id, pos, CASE WHEN (pos + seg_id) % 23 = 7 THEN word || '!' ELSE word END word, nl, greatest(nl, 1) * CASE WHEN (pos * 5 + seg_id * 3) % 7 = 0 THEN 280 WHEN (pos + seg_id) % 17 = 0 THEN 500 ELSE 60 END long, CASE WHEN (pos * 7 + seg_id * 3) % 11 = 0 THEN 500 WHEN (pos * 3 + seg_id) % 5 = 0 THEN 70 ELSE 0 END pause FROM word),
o AS (SELECT *, sum(long + pause) OVER w end_ms, CAST(sum(nl) OVER (PARTITION BY rec_id, seg_id ORDER BY pos DESC) AS BIGINT) rest, regexp_matches(word, '(。|！|？|!|\?|……|\.\.\.)$') closes, regexp_matches(word, '[，,、；;：:]$') clause, row_number() OVER w rn FROM v WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY pos)),
p AS (SELECT *, CAST(end_ms - long AS BIGINT) start_ms, CAST(end_ms AS BIGINT) stop_ms, CAST(long AS BIGINT) took, CAST(greatest(nl, 1) AS BIGINT) chars FROM o),
f AS (SELECT rec_id, seg_id, rn, 1::BIGINT part, start_ms, stop_ms, nl n, took, chars, closes, clause FROM p WHERE rn = 1 UNION ALL
SELECT p.rec_id, p.seg_id, p.rn, CASE WHEN b THEN f.part + 1 ELSE f.part END, p.start_ms, p.stop_ms, CASE WHEN b THEN p.nl ELSE f.n + p.nl END, p.took, p.chars, p.closes, p.clause
FROM f JOIN p ON p.rec_id = f.rec_id AND p.seg_id = f.seg_id AND p.rn = f.rn + 1, LATERAL (SELECT p.start_ms - f.stop_ms gap) g, LATERAL (SELECT (f.closes AND f.n >= 2 AND p.rest >= 1) OR (f.clause AND (gap >= 120 OR f.took + greatest(gap, 0) * f.chars >= 320 * f.chars OR f.took >= 250 * f.chars) AND f.n >= 6 AND p.rest >= 2)
  OR (((f.took >= 275 * f.chars AND gap >= 60) OR (f.took >= 310 * f.chars AND gap >= 35)) AND f.n BETWEEN 2 AND 5 AND (f.n <= 4 OR gap >= 60) AND p.rest >= 4) OR ((gap >= 180 OR (p.took >= 1200 AND p.took >= 450 * p.chars)) AND f.n >= (CASE WHEN gap >= 250 THEN 3 ELSE 5 END) AND p.rest >= 5) b) h)
SELECT rec_id, seg_id, part, min(start_ms) start_ms, max(stop_ms) end_ms, count(*) n_words, max(n) n_chars FROM f GROUP BY rec_id, seg_id, part""")
def pause_split(spark, d):
    """Parts of sentences whose words now and then drag, pause or close."""
    i, j = F.col("pos"), F.col("seg_id")
    w = words(spark, d).select("rec_id", "seg_id", "pos", F.when((i + j) % 23 == 7, F.concat("word", F.lit("!"))).otherwise(F.col("word")).alias("word"), "nl")
    w = w.withColumn("took", F.greatest(F.col("nl"), F.lit(1)) * F.when((i * 5 + j * 3) % 7 == 0, 280).when((i + j) % 17 == 0, 500).otherwise(60))
    pause = F.when((i * 7 + j * 3) % 11 == 0, 500).when((i * 3 + j) % 5 == 0, 70).otherwise(0)
    end = F.sum(F.col("took") + pause).over(Window.partitionBy("rec_id", "seg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("end_ms", end.cast("long")).withColumn("start_ms", (F.col("end_ms") - F.col("took")).cast("long"))
    return folds.split_at_pauses(w)


@query()
def sanitize_clips(spark, d):
    """Events as clips, some of which end before their last word or beyond a wall, were cut, or are seams."""
    c, i, kind = clips(spark, d), F.col("clip_id"), F.col("event_type")
    last = F.when(i % 3 == 0, F.col("end_ms") + 100).when(i % 3 == 1, F.col("end_ms") - 100)
    return folds.sanitize(c.withColumns({"t_last": last, "wall": F.when(i % 4 == 0, F.col("end_ms") + 50), "cut_tail": kind == "error", "splice": kind == "purchase"}))


@query()
def repetition_loops(spark, d):
    return folds.drop_loops(words(spark, d))


_TAIL = """["''”’）)]*$"""


@query(rf"""WITH RECURSIVE {WORDS}, o AS (SELECT *, length(word) + 1 width, regexp_matches(word, '[。！？.!?]{_TAIL}') closed, regexp_matches(word, '[，、；：,;:\-]{_TAIL}') clause, row_number() OVER (PARTITION BY rec_id ORDER BY seg_id, pos) rn FROM word),
f AS (SELECT rec_id, rn, 1::BIGINT group_id, start_ms, start_ms first_ms, end_ms, width, closed, clause, word FROM o WHERE rn = 1 UNION ALL
SELECT o.rec_id, o.rn, CASE WHEN b THEN f.group_id + 1 ELSE f.group_id END, o.start_ms, CASE WHEN b THEN o.start_ms ELSE f.first_ms END, o.end_ms, CASE WHEN b THEN o.width ELSE f.width + o.width END, o.closed, o.clause, o.word
FROM f JOIN o ON o.rec_id = f.rec_id AND o.rn = f.rn + 1, LATERAL (SELECT o.start_ms - f.end_ms gap) g, LATERAL (SELECT gap >= 350 OR f.closed OR (f.width >= 38 AND (gap >= 120 OR f.clause)) OR f.width >= 60 OR f.end_ms - f.first_ms >= 5500 b) h),
s AS (SELECT rec_id, group_id, min(first_ms) start_ms, arg_max(end_ms, rn) end_ms, count(*) n_words, string_agg(word, ' ' ORDER BY rn) txt FROM f GROUP BY rec_id, group_id)
SELECT rec_id, group_id, start_ms, end_ms, n_words, regexp_replace(regexp_replace(txt, '({T.NO_SPACE_AFTER}) ', '\1', 'g'), ' ({T.NO_SPACE_BEFORE})', '\1', 'g') text FROM s""")
def word_grouping(spark, d):
    """Words by pauses, marks and width, as they are shown."""
    g = folds.word_groups(words(spark, d))
    return g.select("rec_id", "group_id", "start_ms", "end_ms", F.size("words").cast("long").alias("n_words"), T.join_for_display(F.col("words")).alias("text"))


@query()
def chunk_boundaries(spark, d):
    return folds.chunks(segments(spark, d), 8_000, 500, 20_000)


def _lines(spark, d):
    """Lines of documents: doc_id, line (from 0), norm."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(T.text_of(F.col("text")), "\n")).alias("line", "text"))
    return t.select("doc_id", F.col("line").cast("long").alias("line"), T.norm(F.col("text")).alias("norm")).filter("norm <> ''")


def _blocks(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("block_id"), T.norm(F.col("text")).alias("norm"))


@query()
def coverage_score(spark, d):
    """Each line of a document with the item of ``benchmark`` of which it covers most, if that is 45 % or more."""
    best = similarity.best_block(_lines(spark, d), _blocks(spark, d)).filter("block_id IS NOT NULL")
    return best.select("block_id", "doc_id", "line", F.round("coverage", 6).alias("coverage"))


@query()
def last_take_per_block(spark, d):
    """Of the lines that cover 85 % or more of an item, how many there are and the last one."""
    best = similarity.best_block(_lines(spark, d), _blocks(spark, d), least=0.85)
    last = F.max(F.struct("doc_id", "line")).alias("l")
    return best.filter("block_id IS NOT NULL").groupBy("block_id").agg(F.count("*").alias("takes"), last).select("block_id", "takes", F.col("l.doc_id").alias("doc_id"), F.col("l.line").alias("line"))


@query()
def retake_flags(spark, d):
    """Each sentence with the one before it: whether it restarts it, completes a false start, or is a take of the same."""
    before = F.lag("text").over(_rec())
    p = segments(spark, d).select("rec_id", "seg_id", "text", before.alias("prev")).filter("prev IS NOT NULL")
    one, two, compare = F.col("prev"), F.col("text"), retakes.comparer()
    told = {"restarts": retakes.restarts(one, two, compare=compare), "aborted": retakes.aborted(one, two, compare=compare), "related": retakes.related(one, two, compare), "opens_again": retakes.opens_again(one, two, compare)}
    return p.select("rec_id", "seg_id", *(c.alias(n) for n, c in told.items()))


@query(f"WITH {WORDS} SELECT rec_id, seg_id, pos, word, start_ms + 1000 start_ms, greatest(end_ms, start_ms + 20) + 1000 end_ms FROM word")
def recognised_words(spark, d):
    """The words of recognition results: one JSON text a recording, one result a segment; moved by a second."""
    ms = lambda c: F.concat(F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.col(c) % 1000), F.lit("s"))
    w = words(spark, d).select("rec_id", "seg_id", "pos", F.struct("word", ms("start_ms").alias("startOffset"), ms("end_ms").alias("endOffset")).alias("w"))
    one = w.groupBy("rec_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    result = F.struct(F.lit("en").alias("languageCode"), F.array(F.struct(F.transform("ws", lambda x: x["w"]).alias("words"))).alias("alternatives"))
    js = one.select("rec_id", "seg_id", F.to_json(F.struct(F.array(result).alias("results"))).alias("js"))
    got = recognised.words_of(js.withColumn("key", F.struct("rec_id", "seg_id")), "key", "js", F.lit(1000))
    return got.select("key.rec_id", "key.seg_id", "pos", "word", "start_ms", "end_ms")


_SECONDS = "CAST(({0} + 5) // 10 // 100 AS VARCHAR) || '.' || lpad(CAST(({0} + 5) // 10 % 100 AS VARCHAR), 2, '0')"


@query(f"""WITH {SEGMENTS} SELECT rec_id, seg_id, md5(concat_ws(',', CAST(seg_id AS VARCHAR), '"' || speaker || '"', {_SECONDS.format("start_ms")}, {_SECONDS.format("end_ms")}, {_SECONDS.format("dur_ms")}, '3.00', {_SECONDS.format("gap_ms")}, '0.00', '"' || replace(txt, '"', '""') || '"', '""', '"ok"')) line_md5 FROM seg""")
def cut_table_lines(spark, d):
    """Each segment as a line of a cut table."""
    line = cut_table.csv_line(F.col("seg_id"), F.col("speaker"), F.col("start_ms"), F.col("end_ms"), F.lit(3000), F.col("gap_ms"), F.lit(0), F.col("text"), F.lit(None).cast("string"), F.lit("ok"))
    return segments(spark, d).select("rec_id", "seg_id", F.md5(line).alias("line_md5"))


@query()
def clip_alignment(spark, d):
    """Where clips of every other segment stand in their recordings: 80 characters of it, as they are, or with every 15th
    replaced or every 11th left out."""
    text = F.substring("text", 9, 80)
    said = F.when(F.col("seg_id") % 3 == 0, text).when(F.col("seg_id") % 3 == 1, F.regexp_replace(text, "(?s)(.{14}).", "$1x")).otherwise(F.regexp_replace(text, "(?s)(.{10}).", "$1"))
    clips = segments(spark, d).filter("seg_id % 2 = 0").select("rec_id", F.col("seg_id").alias("clip_id"), said.alias("transcript"))
    return alignment.align(clips, words(spark, d))


@query()
def stumble_excision(spark, d):
    """Of every segment and the one behind it, what a transcript without their characters 31 to 60 and without the last 20
    of the second keeps."""
    w = _rec()
    s = segments(spark, d).select("rec_id", "seg_id", "text", F.coalesce(F.lead("seg_id").over(w), F.col("seg_id")).alias("last_seg"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("then"))
    said = F.concat(F.left("text", F.lit(30)), F.substring("text", F.lit(61), F.length("text")), F.lit(" "), F.left("then", F.greatest(F.length("then") - 20, F.lit(0))))
    clips = s.filter("seg_id % 2 = 0").select("rec_id", F.col("seg_id").alias("clip_id"), F.col("seg_id").alias("first_seg"), "last_seg", said.alias("transcript"))
    return alignment.excise(clips, words(spark, d)).withColumn("transcript", F.md5("transcript"))


def _false_starts(spark, d):
    """Segments as units; each even one ends with the first five words of the next, said too early."""
    w = words(spark, d).select("rec_id", "seg_id", "pos", "word", "start_ms", "end_ms")
    ends = segments(spark, d).select("rec_id", (F.col("seg_id") + 1).alias("seg_id"), F.col("end_ms").alias("from_ms"))
    early = w.filter("seg_id % 2 = 1 AND pos < 5").join(ends, ["rec_id", "seg_id"])
    late = F.sum(F.col("end_ms") - F.col("start_ms")).over(Window.partitionBy("rec_id", "seg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    early = early.withColumn("_to", F.col("from_ms") + F.floor(late / 2)).withColumn("_from", F.col("_to") - F.floor((F.col("end_ms") - F.col("start_ms")) / 2))
    early = early.select("rec_id", F.col("seg_id") - 1, F.col("pos") + 1_000_000, "word", F.col("_from"), F.col("_to"))
    every = w.union(early)
    return every.groupBy("rec_id", F.col("seg_id").alias("unit_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), occlusion.words_of_unit().alias("words"))


@query()
def take_occlusion(spark, d):
    """What is left of units whose ends the next unit says again."""
    return occlusion.occlude(_false_starts(spark, d))


@query()
def anomaly_windows(spark, d):
    """Windows in which the clips of ``take_occlusion``, before any is cut, would be looked at again."""
    units = _false_starts(spark, d)
    text = F.array_join(F.transform("words", lambda x: x["w"]), " ")
    anchor = F.when(F.col("unit_id") % 5 != 4, F.col("unit_id"))
    clips = units.select("rec_id", F.col("unit_id").alias("clip_id"), "start_ms", "end_ms", text.alias("text"), anchor.alias("first_seg"), anchor.alias("last_seg"))
    return anomalies.merge(anomalies.candidates(clips))


def _frames_sql(ms: str, num: int, den: int) -> str:
    """ms * num / (1000 * den), halves to even."""
    n, d = f"(({ms}) * {num})", 1000 * den
    return f"({n} // {d} + CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END)"


def _timeline_clips(spark, d):
    """Segments as clips; each fourth is a seam."""
    s = segments(spark, d)
    return s.select("rec_id", F.col("seg_id").alias("clip_id"), F.concat("speaker", F.lit(' & "<'), F.left("text", F.lit(9))).alias("topic"), "start_ms", "end_ms", (F.col("seg_id") % 4 == 3).alias("splice"))


_TOPIC = """replace(replace(replace(replace('Clip_' || lpad(CAST(seg_id AS VARCHAR), CAST(greatest(2, length(CAST(seg_id AS VARCHAR))) AS INT), '0') || '_' || left(speaker || ' & "<' || left(txt, 9), 15), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query(f"""WITH {SEGMENTS}, f AS (SELECT *, greatest(1, {_frames_sql("end_ms - start_ms", 24000, 1001)}) frames, {_frames_sql("start_ms", 24000, 1001)} begun FROM seg),
g AS (SELECT *, row_number() OVER w - 1 place, sum(frames) OVER w - frames gone FROM f WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms, end_ms, seg_id))
SELECT rec_id, place, CAST(frames AS BIGINT) frames, md5('<asset-clip name="' || {_TOPIC} || '" ref="r2" offset="' || CASE WHEN gone = 0 THEN '0s' ELSE CAST(CAST(gone AS BIGINT) * 1001 AS VARCHAR) || '/24000s' END || '" start="' || CAST(begun * 1001 AS VARCHAR) || '/24000s" duration="' || CAST(frames * 1001 AS VARCHAR) || '/24000s"'
  || CASE WHEN seg_id % 4 = 3 THEN '><adjust-transform scale="1.12 1.12"/><marker start="' || CAST(begun * 1001 AS VARCHAR) || '/24000s" duration="1001/24000s" value="Composite Splice (Pick-up)"/></asset-clip>' ELSE '/>' END) item_md5 FROM g""")
def timeline_items(spark, d):
    """Each segment as an element of an editing timeline."""
    items = timeline.fcpxml_items(_timeline_clips(spark, d), punch_in=True)
    return items.select("rec_id", "place", "frames", F.md5("item").alias("item_md5"))


@query(f"""WITH {SEGMENTS}, b AS (SELECT DISTINCT rec_id, rec_id % 7 = 3 cut, rec_id % 7 = 5 bare FROM seg)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY seg_id) - 1 place, seg_id clip_id, start_ms, end_ms, md5(txt) text_md5, CAST(NULL AS VARCHAR) reason FROM seg WHERE rec_id % 7 NOT IN (3, 5)
UNION ALL SELECT rec_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN cut THEN 'no object' ELSE 'no clips' END FROM b WHERE cut OR bare""")
def edit_list_clips(spark, d):
    """Segments written as edit lists in JSON, some of them broken off or without clips, and read again."""
    s = segments(spark, d).withColumn("place", F.row_number().over(_rec()))
    js = edit_list_sink.edit_list_json(s.select("rec_id", "place", F.col("seg_id").alias("clip_id"), F.col("start_ms").alias("source_in_ms"), F.col("end_ms").alias("source_out_ms"), F.col("text").alias("transcript")))
    k = F.col("rec_id") % 7
    broken = js.withColumn("js", F.when(k == 3, F.left("js", F.length("js") - 9)).when(k == 5, '{"project_title": ""}').otherwise(F.col("js")))
    clips, bad = edit_lists.parse_edit_lists(broken, "rec_id", "js")
    good = clips.select("rec_id", "place", "clip_id", F.col("source_in_ms").alias("start_ms"), F.col("source_out_ms").alias("end_ms"), F.md5("transcript").alias("text_md5"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("long")
    return good.unionByName(bad.select("rec_id", none.alias("place"), none.alias("clip_id"), none.alias("start_ms"), none.alias("end_ms"), F.lit(None).cast("string").alias("text_md5"), "reason"))


def _event_signal(spark, d):
    """A user's events in order as 40 ms of signal each, as loud as their value, errors silent: (rec_id, k, amplitude)."""
    k = F.row_number().over(_time()) - 1
    loud = F.when(F.col("event_type") == "error", 0.0005).otherwise(F.col("value") / 1000)
    return clips(spark, d).select("rec_id", k.cast("long").alias("k"), loud.alias("a"))


def _event_energy(spark, d):
    one = _event_signal(spark, d).groupBy("rec_id", F.expr("k div 25").alias("second")).agg(F.array_sort(F.collect_list(F.struct("k", "a"))).alias("s"))
    return one.select("rec_id", "second", F.flatten(F.transform("s", lambda x: F.array_repeat(x["a"] * x["a"], 40))).alias("e"))


@query()
def onset_clamp(spark, d):
    """Every sixth event begins a word of 230 ms, 160 ms behind the one before: where it is heard to begin."""
    at = 40 * F.col("k")
    w = _event_signal(spark, d).filter("k % 6 = 0").select("rec_id", F.col("k").alias("word_id"), at.alias("start_ms"), (at + 230).alias("end_ms"), F.when(F.col("k") > 0, at - 160).alias("prev_end_ms"), (F.col("k") == 0).alias("cut_head"))
    return signals.onsets(w, _event_energy(spark, d))


@query()
def cut_pivot(spark, d):
    """Every twentieth event begins a seam: six words of 320 ms, and six more of which the first three are the last said again."""
    at = lambda i: 40 * F.col("k") + 320 * i
    words_ = lambda lo, hi: F.array(*(F.struct(at(i).alias("start_ms"), (at(i) + 200 + 30 * (i % 4)).alias("end_ms")) for i in range(lo, hi)))
    s = _event_signal(spark, d).filter("k % 20 = 0").select("rec_id", F.col("k").alias("seam_id"), words_(0, 6).alias("prefix"), words_(6, 12).alias("rest"), F.lit(3).alias("shared"))
    return signals.pivots(s, _event_energy(spark, d))


@query()
def repaired_clips(spark, d):
    """The clips of ``anomaly_windows`` after the repair loop, judged by rules alone."""
    units = _false_starts(spark, d)
    text = F.array_join(F.transform("words", lambda x: x["w"]), " ")
    anchor = F.when(F.col("unit_id") % 5 != 4, F.col("unit_id"))
    clips = units.select("rec_id", F.col("unit_id").alias("clip_id"), "start_ms", "end_ms", text.alias("text"), anchor.alias("first_seg"), anchor.alias("last_seg"))
    return repair.repair(clips).select("rec_id", "clip_id", "start_ms", "end_ms", F.md5("text").alias("text_md5"), "verified", "rounds", "settled")


@query()
def seam_overlap(spark, d):
    """What the end of each segment, with the first words of the next one behind it, and the next one's start say both."""
    s = segments(spark, d).select("rec_id", "seg_id", "norm", F.lead("norm").over(_rec()).alias("then")).filter("then IS NOT NULL")
    before = F.concat("norm", F.left("then", (F.col("seg_id") % 12).cast("int")), F.left(F.lit("zq"), (F.col("seg_id") % 3).cast("int")))
    return s.select("rec_id", "seg_id", retakes.seam(before, F.col("then")).alias("overlap"))
