"""Reads the words of speech recognition results: JSON of results, each with alternatives, of which the first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T

SCHEMA = "results array<struct<languageCode:string,alternatives:array<struct<words:array<struct<word:string,startOffset:string,endOffset:string>>>>>>"


def words_of(payloads: DataFrame, key: str, payload: str, shift_ms: str | Column, least_ms: int = 20) -> DataFrame:
    """(key, res, pos, word, start_ms, end_ms) of the JSON text in ``payload``; times are moved by shift_ms, and a word
    lasts least_ms or more. Words of nothing but spaces, results without alternatives, null and malformed payloads have
    no rows; a missing offset is 0."""
    ms = lambda c: F.round(T.offset_seconds(c) * 1000).cast("long")
    shift = F.col(shift_ms) if isinstance(shift_ms, str) else shift_ms
    results = payloads.select(key, shift.cast("long").alias("_shift"), F.posexplode(F.from_json(payload, SCHEMA)["results"]).alias("res", "_r"))
    words = results.select(key, "_shift", "res", F.posexplode(F.get(F.col("_r.alternatives"), F.lit(0))["words"]).alias("pos", "_w"))
    words = words.withColumn("word", F.trim("_w.word")).filter("word <> ''").withColumn("_from", ms(F.col("_w.startOffset")))
    end = F.greatest(F.col("_from") + least_ms, ms(F.col("_w.endOffset")))
    return words.select(key, "res", "pos", "word", (F.col("_from") + F.col("_shift")).alias("start_ms"), (end + F.col("_shift")).alias("end_ms"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """words_of all files under path, one result file each; key: the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("_json"))
    return words_of(files, "file", "_json", F.lit(0))
