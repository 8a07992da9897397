"""Clips of edit lists in JSON: one object a recording with ``final_edl``, as ``sinks.edit_lists`` writes them.

Columns that are not asked for are not parsed. What is no such object is not lost: it comes back with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a clip and of the object around the clips.
CLIP = (
    "clip_id long, topic string, sentence_ids array<long>, start_sentence_id long, end_sentence_id long, source_in double, source_out double, t_first double, t_last double, duration double, cps double, in_margin double, "
    "out_margin double, gain_db double, transcript string, asr_transcript string, composite_role string, is_composite_splice boolean, llm_verified_window boolean, trimmed_head boolean, trimmed_tail boolean"
)
BAD = "_bad"
LIST = "project_title string, asr_engine string, average_cps double, total_duration double, final_edl array<struct<" + ",".join(":".join(f.split(" ")) for f in CLIP.split(", ")) + f">>, {BAD} string"


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def _clips(lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """lists: keys and ``l``, the parsed object."""
    reason = F.when(F.col("l").isNull() | F.col("l")[BAD].isNotNull(), "no object").when(F.col("l.final_edl").isNull(), "no clips")
    told = lists.withColumn("reason", reason)
    clip = F.posexplode(F.filter("l.final_edl", lambda c: c.isNotNull())).alias("place", "c")
    good = told.filter("reason IS NULL").select(*keys, clip)
    seconds = ("source_in", "source_out", "t_first", "t_last")
    names = [f.split(" ")[0] for f in CLIP.split(", ")]
    good = good.select(*keys, F.col("place").cast("long").alias("place"), *(ms(F.col(f"c.{n}")).alias(f"{n}_ms") if n in seconds else F.col(f"c.{n}") for n in names))
    return good, told.filter("reason IS NOT NULL").select(*keys, "reason")


def parse_edit_lists(texts: DataFrame, key: str, js: str) -> tuple[DataFrame, DataFrame]:
    """(clips, rejected) of JSON texts: key, place (from 0), the fields of a clip (times as whole _ms); and key, reason. An
    empty list has no clips and is not rejected; a null text is rejected."""
    parsed = F.from_json(F.col(js), LIST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return _clips(texts.select(key, parsed.alias("l")), [key])


def read_edit_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of files, one object a file, by ``file``, the file's path; folders like rec_id=7 give rec_id too."""
    read = spark.read.schema(LIST).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("recursiveFileLookup", True).json(path)
    whole = F.struct(*(F.col(c) for c in read.columns))
    rec = F.regexp_extract(F.col("_metadata.file_path"), "rec_id=(-?[0-9]+)", 1).try_cast("long")
    return _clips(read.select(F.col("_metadata.file_path").alias("file"), rec.alias("rec_id"), whole.alias("l")), ["file", "rec_id"])
