"""The engine's relations over the given tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as timed speech: 60 ms for each word character, pauses from the ids."""
    df = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seg_id"), F.col("role").alias("speaker"), T.text_of(F.col("text")).alias("text"))
    df = df.withColumn("norm", T.norm(F.col("text"))).withColumn("nl", F.length("norm").cast("long"))
    df = df.withColumn("dur_ms", 60 * F.greatest(F.col("nl"), F.lit(1)))
    df = df.withColumn("gap_ms", F.when(F.col("seg_id") == 0, 0).otherwise(((F.col("rec_id") * 31 + F.col("seg_id") * 17) % 13) * 100).cast("long"))
    end = F.sum(F.col("dur_ms") + F.col("gap_ms")).over(Window.partitionBy("rec_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col("dur_ms"))
    return df.withColumn("closes", T.ends_with_any(F.col("text"), T.CLOSURE))


SEGMENTS = r"""
s0 AS (SELECT conv_id rec_id, turn seg_id, role speaker, coalesce(text, '') txt FROM conversations),
s1 AS (SELECT *, lower(regexp_replace(txt, '[^\p{L}\p{N}_]', '', 'g')) norm FROM s0),
s2 AS (SELECT *, CAST(length(norm) AS BIGINT) nl, CAST(60 * greatest(length(norm), 1) AS BIGINT) dur_ms, CAST(CASE WHEN seg_id = 0 THEN 0 ELSE ((rec_id * 31 + seg_id * 17) % 13) * 100 END AS BIGINT) gap_ms,
  regexp_matches(rtrim(txt), '(。|！|？|!|\?|……|\.\.\.)$') closes FROM s1),
s3 AS (SELECT *, CAST(sum(dur_ms + gap_ms) OVER (PARTITION BY rec_id ORDER BY seg_id) AS BIGINT) end_ms FROM s2),
seg AS (SELECT *, end_ms - dur_ms start_ms FROM s3)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clips of a user's timeline: from the event on, floor(10 * value) minutes long."""
    df = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    df = df.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("clip_id"), "event_type", F.coalesce("value", F.lit(0.0)).alias("value"), start.alias("start_ms"))
    return df.withColumn("end_ms", F.col("start_ms") + F.floor(F.col("value") * 10) * 60_000)


CLIPS = """
clip AS (SELECT *, start_ms + CAST(floor(value * 10) AS BIGINT) * 60000 end_ms FROM
  (SELECT user_id rec_id, event_id clip_id, event_type, coalesce(value, 0.0) "value", (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 start_ms FROM events))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the segments: 60 ms for each word character, and now and then a pause of 500 ms before one."""
    df = segments(spark, sf_dir).select("rec_id", "seg_id", F.col("start_ms").alias("from_ms"), F.posexplode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")).alias("pos", "word"))
    df = df.withColumn("nl", F.length(T.norm(F.col("word"))).cast("long"))
    pause = F.when((F.col("pos") * 7 + F.col("seg_id") * 3) % 11 == 0, 500).otherwise(0)
    end = F.col("from_ms") + F.sum(60 * F.col("nl") + pause).over(Window.partitionBy("rec_id", "seg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - 60 * F.col("nl")).drop("from_ms")


WORDS = SEGMENTS + r""",
w0 AS (SELECT rec_id, seg_id, start_ms from_ms, unnest(l) word, unnest(range(len(l))) pos FROM (SELECT rec_id, seg_id, start_ms, list_filter(regexp_split_to_array(txt, '[ \t\n\r]+'), lambda x: x <> '') l FROM seg)),
w1 AS (SELECT *, CAST(length(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')) AS BIGINT) nl, CASE WHEN (pos * 7 + seg_id * 3) % 11 = 0 THEN 500 ELSE 0 END pause FROM w0),
w2 AS (SELECT *, from_ms + CAST(sum(60 * nl + pause) OVER (PARTITION BY rec_id, seg_id ORDER BY pos) AS BIGINT) end_ms FROM w1),
word AS (SELECT *, end_ms - 60 * nl start_ms FROM w2)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal frames: a user's event values in order of time."""
    return clips(spark, sf_dir).select("rec_id", "clip_id", "start_ms", F.col("value").alias("x"))
