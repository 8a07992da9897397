"""Writes clips as lines of a cut table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T

#: The columns of a cut table.
COLUMNS = ("Clip_ID", "Topic", "Source_In", "Source_Out", "Duration", "CPS", "In_Margin", "Out_Margin", "Transcript", "Visual_Check", "Audio_Check")


def hundredths(ms: Column) -> Column:
    """Whole milliseconds as seconds with two digits, halves up; null stays null."""
    n = F.floor((ms + 5) / 10)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 100).cast("string"), F.lit("."), F.lpad((F.abs(n) % 100).cast("string"), 2, "0"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(T.text_of(c), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(clip_id, topic, start_ms, end_ms, rate, in_ms, out_ms, *texts: Column) -> Column:
    """A clip's line; ``rate`` is in thousandths too. A null number leaves its field empty."""
    number = lambda c: F.coalesce(hundredths(c), F.lit(""))
    return F.concat_ws(",", F.coalesce(clip_id.cast("string"), F.lit("")), quoted(topic), number(start_ms), number(end_ms), number(end_ms - start_ms), number(rate), number(in_ms), number(out_ms), *map(quoted, texts))


def write_cut_table(lines: DataFrame, path: str) -> None:
    """Writes ``line`` in the order of ``place`` as part files, in the order of their names; the first begins with a
    byte order mark and the header. Sorted by ranges, so no task gets all lines."""
    head = lines.sparkSession.createDataFrame([(0, "\ufeff" + ",".join(COLUMNS))], "_kind int, line string").withColumn("place", F.lit(None).cast(lines.schema["place"].dataType))
    every = head.unionByName(lines.select(F.lit(1).alias("_kind"), "line", "place"))
    every.orderBy("_kind", "place", "line").select("line").write.text(path)
