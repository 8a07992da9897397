"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import fuzzy

from .relations import SEGMENTS, segments, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORM = r"lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g'))"


@query(f"SELECT doc_id, CAST(length({NORM}) AS BIGINT) norm_len, md5({NORM}) norm_md5 FROM documents")
def normalize_text(spark, d):
    n = T.norm(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("norm_len"), F.md5(n).alias("norm_md5"))


@query(r"""WITH t AS (SELECT doc_id, ['那麼', '然後,', 'ok ', 'OK，', '', '好 對 '][CAST(doc_id % 6 AS INT) + 1] || coalesce(text, '') x FROM documents)
SELECT doc_id, md5(lower(regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}_]*(?:(?:OK|ok|其實|另外|就是|所以|然後|現在|而且|那麼|來|好|對|那)[，,、 \x{3000}]*)+', ''), '[^\p{L}\p{N}_]', '', 'g'))) stripped_md5 FROM t""")
def strip_leading_fillers(spark, d):
    heads = F.array(*map(F.lit, ["那麼", "然後,", "ok ", "OK，", "", "好 對 "]))
    x = F.concat(F.get(heads, (F.col("doc_id") % 6).cast("int")), T.text_of(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_fillers(x)).alias("stripped_md5"))


COUNT = lambda p: f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT)"


@query(f"SELECT doc_id, {COUNT(T.CJK)} cjk, {COUNT('[A-Za-z]')} latin, {COUNT('[A-Za-z]+')} words, CAST(length(coalesce(text, '')) AS BIGINT) + {COUNT('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} width FROM documents")
def char_counts(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.cjk_chars(c).alias("cjk"), T.latin_chars(c).alias("latin"), T.latin_words(c).alias("words"), T.display_width(c).alias("width"))


@query(rf"""WITH {SEGMENTS}, c AS (SELECT rec_id, seg_id, unnest(l) clause, unnest(range(len(l))) pos FROM (SELECT rec_id, seg_id, list_filter(regexp_split_to_array(txt, '[。！？.!?]+'), lambda x: x <> '') l FROM seg)),
n AS (SELECT *, length(regexp_replace(clause, '[^\p{{L}}\p{{N}}_]', '', 'g')) nl, len(regexp_extract_all(clause, '{T.CJK}')) cjk, len(regexp_extract_all(clause, '[A-Za-z0-9]+')) lw, len(regexp_extract_all(clause, '[A-Za-z0-9]')) lc FROM c)
SELECT rec_id, seg_id, CAST(pos AS BIGINT) pos, nl >= 2 AND nl * 60 >= 550 AND (cjk >= 4 OR lw >= 3 OR lc >= 10 OR (cjk >= 2 AND lc >= 3)) viable FROM n""")
def viable_span(spark, d):
    df = segments(spark, d).select("rec_id", "seg_id", F.posexplode(F.filter(F.split("text", "[。！？.!?]+"), lambda x: x != "")).alias("pos", "clause"))
    return df.select("rec_id", "seg_id", F.col("pos").cast("long").alias("pos"), T.is_viable(F.col("clause"), F.length(T.norm(F.col("clause"))) * 60 / 1000).alias("viable"))


@query("""WITH c AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) n FROM events)
SELECT event_id, CASE n % 7 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN CAST(n // 100 AS DOUBLE) WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 ELSE CAST(CAST(n // 100 AS VARCHAR) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS "seconds" FROM c""")
def parse_offset(spark, d):
    """Values of events as offsets: with and without a fraction, none, no number, two points, no unit."""
    n = F.round(F.col("value") * 100).cast("long")
    whole, part = F.floor(n / 100).cast("string"), F.lpad((n % 100).cast("string"), 2, "0")
    k = n % 7
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "bad").when(k == 2, F.concat(whole, F.lit("s"))).when(k == 3, F.concat(whole, F.lit(".1.2s"))).when(k == 4, F.concat(whole, F.lit("."), part)).otherwise(F.concat(whole, F.lit("."), part, F.lit("s")))
    return table(spark, d, "events").select("event_id", T.offset_seconds(raw).alias("seconds"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\x{AC00}-\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh-TW'
WHEN len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}')) >= 5 THEN 'en' ELSE 'zh-TW' END locale FROM documents""")
def lang_hint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.locale_hint(F.col("text")).alias("locale"))


#: Two hex digits of a text's MD5, to choose among forms by content.
DIGITS = lambda c: F.conv(F.left(F.md5(T.text_of(F.col(c))), F.lit(2)), 16, 10).cast("int")
DIGITS_SQL = "CAST('0x' || left(md5(coalesce({0}, '')), 2) AS INT)"
SUFFIXES = [s.upper() if i % 3 == 1 else s for i, s in enumerate([*T.MEDIA_TYPES, "", ".txt", ".mp4.bak"])]


@query(f"SELECT page_id, ({[T.MEDIA_TYPES.get(s.lower(), 'video/mp4') for s in SUFFIXES]})[{DIGITS_SQL.format('url')} % {len(SUFFIXES)} + 1] media FROM pages")
def mime_lookup(spark, d):
    """Pages' addresses with each known suffix, in either case, and with others."""
    ends = F.get(F.array(*map(F.lit, SUFFIXES)), DIGITS("url") % len(SUFFIXES))
    return table(spark, d, "pages").select("page_id", T.media_type(F.concat(T.text_of(F.col("url")), F.lit("/clip"), ends)).alias("media"))


@query(f"SELECT doc_id, CASE WHEN {DIGITS_SQL.format('text')} % 8 < 6 THEN md5(coalesce(text, '')) END drive_id FROM documents")
def drive_uri_parse(spark, d):
    """Texts' hashes as ids in each form of link, alone, too short and in a sentence."""
    i, lit = F.md5(T.text_of(F.col("text"))), F.lit
    forms = [
        F.concat(lit("gdrive://"), i), F.concat(lit("https://drive.example/drive/folders/"), i, lit("?usp=sharing")), F.concat(lit("https://drive.example/file/d/"), i, lit("/view")),
        F.concat(lit("https://drive.example/open?id="), i), F.concat(lit("https://drive.example/uc?export=download&id="), i), i, F.left(i, lit(14)), F.concat(lit("see "), i),
    ]
    return table(spark, d, "documents").select("doc_id", T.drive_id(F.get(F.array(*forms), DIGITS("text") % 8)).alias("drive_id"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) escaped_md5 FROM pages""")
def escape_attr(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.escape_attr(F.col("html"))).alias("escaped_md5"))


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) || 'x' w, {DIGITS_SQL.format("text")} % 6 k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN w || ' 漢.mp4' WHEN 1 THEN w || '.mp4' WHEN 2 THEN w || ' q.mov' WHEN 3 THEN w WHEN 4 THEN w || '.mov' ELSE 'none' END "name" FROM t""")
def attachment_name(spark, d):
    """First words of texts as file names: extended form before others, in either case, quoted, plain, last, none."""
    w, lit = F.concat(F.regexp_extract(T.text_of(F.col("text")), "[A-Za-z]+", 0), F.lit("x")), F.lit
    forms = [
        F.concat(lit("attachment; filename=\"y\"; filename*=UTF-8''"), w, lit("%20%E6%BC%A2.mp4")), F.concat(lit("attachment; filename*=utf-8''"), w, lit(".mp4; size=1")),
        F.concat(lit('attachment; filename="'), w, lit(' q.mov"')), F.concat(lit("attachment; filename="), w, lit("; x=1")), F.concat(lit("inline; filename="), w, lit(".mov")), lit("inline"),
    ]
    return table(spark, d, "documents").select("doc_id", T.attachment_name(F.get(F.array(*forms), DIGITS("text") % 6), F.lit("none")).alias("name"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') x FROM documents)
SELECT doc_id, md5(CASE WHEN length(regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')) >= 12 THEN regexp_extract(x, '^((?:[^\p{L}\p{N}_]*[\p{L}\p{N}_]){12})', 1) ELSE x END) head_md5 FROM t""")
def norm_index_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_head(F.col("text"), 12)).alias("head_md5"))


@query(f"""WITH t AS (SELECT doc_id, {NORM} n FROM documents), p AS (SELECT *, substr(n, 1, 4) q FROM t)
SELECT doc_id, CASE WHEN q = '' THEN 0 ELSE CAST((length(n) - length(replace(n, q, ''))) // length(q) AS BIGINT) END found FROM p""")
def phrase_multiplicity(spark, d):
    df = table(spark, d, "documents").select("doc_id", T.norm(F.col("text")).alias("n"))
    return df.select("doc_id", T.phrase_count(F.col("n"), F.left(F.col("n"), F.lit(4))).alias("found"))


@query()
def fuzzy_occurrence_count(spark, d):
    """Each whole document for the first 4, 7 and 12 word characters of each item of benchmark; pairs without any are left out."""
    norm = T.norm(F.col("text"))
    heads = table(spark, d, "benchmark").select(norm.alias("n")).select("n", F.explode(F.array(F.lit(4), F.lit(7), F.lit(12))).alias("k")).filter(F.length("n") >= F.col("k"))
    phrases = [r[0] for r in heads.select(F.left("n", F.col("k")).alias("phrase")).distinct().collect()]
    return fuzzy.occurrences(table(spark, d, "documents").select("doc_id", norm.alias("norm")), "doc_id", "norm", phrases)


@query(f"""WITH t AS (SELECT doc_id, {NORM} a FROM documents), p AS (SELECT doc_id, a, right(a, CAST(6 + doc_id % 40 AS INT)) || left(a, 30) b FROM t)
SELECT doc_id, CAST(coalesce((SELECT max(k) FROM range(5, 49) r(k) WHERE length(a) >= k AND right(a, k) = left(b, k)), 0) AS BIGINT) overlap FROM p""")
def suffix_prefix_overlap(spark, d):
    df = table(spark, d, "documents").select("doc_id", T.norm(F.col("text")).alias("a"))
    df = df.withColumn("b", F.concat(F.right("a", (6 + F.col("doc_id") % 40).cast("int")), F.left("a", F.lit(30))))
    return df.select("doc_id", T.suffix_prefix(F.col("a"), F.col("b")).alias("overlap"))


_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SCRIPTS = rf"""t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '...' WHEN 1 THEN '---' || chr(10) || 'a: b' || chr(10) || ' --- ' WHEN 2 THEN '# head' || chr(10) || '===' ELSE '---' END || chr(10) || 'Title: none' || chr(10) || '1. Body: ' || replace(replace(coalesce(text, ''), ' the ', ' [cut] the '), '. ', '.' || chr(10) || '> - ') || chr(10) || '（鏡頭拉近）' || chr(10) || '內文：' x FROM documents),
l0 AS (SELECT doc_id, list_transform(string_split(x, chr(10)), lambda y: {_STRIP.format("y")}) l FROM t),
l1 AS (SELECT doc_id, l, CASE WHEN l[1] <> '---' THEN 0 ELSE coalesce(list_position(list_transform(l[2:], lambda y: y IN ('---', '...')), true) + 1, len(l)) END gone FROM l0),
l2 AS (SELECT doc_id, unnest(l[gone + 1:]) y, unnest(range(len(l[gone + 1:]))) i FROM l1),
l3 AS (SELECT doc_id, i, {_STRIP.format(r"regexp_replace(y, '^[>*\-\p{Nd}.]+', '')")} y FROM l2 WHERE NOT regexp_matches(y, '^(?:#|[-=*_]{{3,}}$)')),
l4 AS (SELECT doc_id, i, {_STRIP.format(f"regexp_replace(y, '(?i)^(?:{'|'.join(T.LABELS)})', '')")} raw FROM l3 WHERE NOT regexp_matches(lower(y), '^(?:{'|'.join(T.METADATA)})')),
l5 AS (SELECT doc_id, i, raw, lower(regexp_replace(regexp_replace(raw, '{T.CUES}', '', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g')) norm FROM l4),
block AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) block_id, raw, norm FROM l5 WHERE length(norm) >= 4)"""


def _scripts(spark, d):
    """Documents as scripts: with front matter (closed either way, or never), a rule, a title, labels, marks and cues."""
    i, lit = F.col("doc_id") % 4, F.lit
    head = F.when(i == 0, "---\ntitle: x\n...").when(i == 1, "---\na: b\n --- ").when(i == 2, "# head\n===").otherwise("---")
    text = F.replace(F.replace(T.text_of(F.col("text")), lit(" the "), lit(" [cut] the ")), lit(". "), lit(".\n> - "))
    x = F.concat(head, lit("\nTitle: none\n1. Body: "), text, lit("\n（鏡頭拉近）\n內文："))
    return table(spark, d, "documents").select("doc_id", T.script_blocks(x).alias("blocks"))


@query(f"WITH {SCRIPTS} SELECT doc_id, block_id, md5(raw) line_md5, md5(norm) norm_md5 FROM block")
def script_blocks_parse(spark, d):
    blocks = _scripts(spark, d).select("doc_id", F.posexplode_outer("blocks").alias("i", "b")).filter("b IS NOT NULL")  # else Spark works the blocks out to see if there are any
    return blocks.select("doc_id", (F.col("i") + 1).cast("long").alias("block_id"), F.md5("b.raw").alias("line_md5"), F.md5("b.norm").alias("norm_md5"))


@query(f"WITH {SCRIPTS} SELECT doc_id, string_agg(format('[Script Block {{:02d}}] {{:s}}', block_id, raw), chr(10) ORDER BY block_id) listing FROM block GROUP BY doc_id")
def script_listing(spark, d):
    """Each script's blocks with their numbers. A script is listed where it is read; one without blocks has no row."""
    line = lambda b, i: F.format_string("[Script Block %02d] %s", (i + 1).cast("long"), b["raw"])
    listing = F.array_join(F.transform("blocks", line), "\n")
    return _scripts(spark, d).select("doc_id", F.explode_outer(F.array(listing)).alias("listing")).filter("listing <> ''")  # a filter on the expression would work it out twice


@query(r"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents)
SELECT doc_id, CAST(len(list_filter(range(2, len(l) + 1), lambda i: length(l[i]) > 5 AND l[i] = l[i - 1])) AS BIGINT) repeats FROM t""")
def adjacent_line_repeat(spark, d):
    lines = F.split(T.text_of(F.col("text")), "\n")
    again = F.filter(F.transform(lines, lambda x, i: (F.length(x) > 5) & (i > 0) & (x == F.get(lines, i - 1))), lambda x: x)
    return table(spark, d, "documents").select("doc_id", F.size(again).cast("long").alias("repeats"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events""")
def lenient_json(spark, d):
    p, i = F.col("props"), F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("Here: "), p, F.lit(" done"))).when(i % 4 == 2, F.concat(p, F.lit(", "), p)).otherwise(p)
    js = T.lenient_json(raw)
    one = F.from_json(js, "k long")["k"]
    many = F.get(F.from_json(js, "array<struct<k:long>>"), F.lit(0))["k"]
    return table(spark, d, "events").select("event_id", F.when(F.startswith(js, F.lit("[")), many).otherwise(one).alias("k"))


@query("""SELECT rec_id, string_agg(format('[Sentence ID: {:3d}] {:6.2f}s -> {:6.2f}s | {:s}', seg_id, CAST(start_ms AS DOUBLE) / 1000, CAST(end_ms AS DOUBLE) / 1000, txt), chr(10) ORDER BY seg_id) listing FROM (WITH """ + SEGMENTS + """ SELECT * FROM seg) GROUP BY rec_id""")
def transcript_listing_whole(spark, d):
    """Each sentence's number, start, end and whole text as it was written."""
    line = F.format_string("[Sentence ID: %3d] %6.2fs -> %6.2fs | %s", F.col("seg_id"), F.col("start_ms").cast("double") / 1000, F.col("end_ms").cast("double") / 1000, F.col("text"))
    rows = segments(spark, d).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", line.alias("line")))).alias("rows"))
    return rows.select("rec_id", F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("listing"))


def _display_sql() -> str:
    words = r"array_to_string(list_filter(regexp_split_to_array(txt, '[ \t\n\r]+'), lambda x: x <> ''), ' ')"
    return rf"WITH {SEGMENTS} SELECT rec_id, seg_id, md5(regexp_replace(regexp_replace({words}, '({T.NO_SPACE_AFTER}) ', '\1', 'g'), ' ({T.NO_SPACE_BEFORE})', '\1', 'g')) display_md5 FROM seg"


@query(_display_sql())
def words_display_join(spark, d):
    """Every segment's words as they are shown."""
    return segments(spark, d).select("rec_id", "seg_id", F.md5(T.join_for_display(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != ""))).alias("display_md5"))
