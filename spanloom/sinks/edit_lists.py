"""Writes clips as edit lists in JSON, one object a recording, and usage as lines of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit_list_json(clips: DataFrame, title: str = "", engine: str = "") -> DataFrame:
    """rec_id and js, the recording's object: project_title, asr_engine, average_cps, total_duration and final_edl. clips: rec_id,
    place and any columns, which become the fields of a clip; names that end in _ms become seconds without that end. A
    recording's clips are one object, so one row."""
    fields = [c for c in clips.columns if c not in ("rec_id", "place")]
    one = F.struct(*((F.col(c) / 1000).alias(c[:-3]) if c.endswith("_ms") else F.col(c) for c in fields))
    cps = F.round(F.avg("cps"), 2) if "cps" in fields else F.lit(None).cast("double")
    long_ = F.sum(F.col("source_out_ms") - F.col("source_in_ms")) / 1000 if {"source_in_ms", "source_out_ms"} <= set(fields) else F.lit(None).cast("double")
    made = clips.groupBy("rec_id").agg(cps.alias("average_cps"), long_.alias("total_duration"), F.array_sort(F.collect_list(F.struct("place", one.alias("c")))).alias("cs"))
    whole = F.struct(F.lit(title).alias("project_title"), F.lit(engine).alias("asr_engine"), "average_cps", "total_duration", F.transform("cs", lambda x: x["c"]).alias("final_edl"))
    return made.select("rec_id", F.to_json(whole).alias("js"))


def write_edit_lists(clips: DataFrame, path: str, title: str = "", engine: str = "") -> None:
    """A folder rec_id=... with one file for each recording."""
    edit_list_json(clips, title, engine).repartition("rec_id").write.partitionBy("rec_id").text(path)


def append_usage(usage: DataFrame, path: str) -> None:
    """Adds rows (video, model, mode, prompt_tokens, candidates_tokens, thoughts_tokens, tool_use_tokens, total_tokens,
    duration_seconds) to a log of JSON lines, each with the time; null counts are 0."""
    counts = ("prompt_tokens", "candidates_tokens", "thoughts_tokens", "tool_use_tokens", "total_tokens")
    rows = usage.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), "video", "model", "mode", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.round("duration_seconds", 2).alias("duration_seconds"))
    rows.write.mode("append").json(path)
