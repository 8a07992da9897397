"""Timelines: published numbers, well-formed documents, and what a failed task leaves."""

import os
import xml.etree.ElementTree as ET
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spanloom.sinks import timeline

CLIPS = "rec_id long, clip_id long, topic string, start_ms long, end_ms long, splice boolean, media string, total_ms long"
TWO = [(1, 1, "開場", 10_000, 15_000, False, "/media/take1.mp4", 30_000), (1, 2, "重點段落說明", 20_000, 27_500, None, "/media/take1.mp4", 30_000)]
SEAM = [(2, 1, 'Prefix "A&B"', 1_000, 2_200, False, "/m/raw & cut.mp4", 10_000), (2, 2, "Pick-up <C>\x00\x0b", 3_000, 4_500, True, "/m/raw & cut.mp4", 10_000), (3, 1, None, 0, 2_000, None, None, None)]


def write(spark, path, rows, **options):
    timeline.write_timelines(spark.createDataFrame(rows, CLIPS), str(path), **options)
    return {f.split(".")[0]: ET.parse(f"{path}/{f}").getroot() for f in os.listdir(path) if not f.startswith(("_", "."))}


def test_xmeml(spark, tmp_path):
    docs = write(spark, tmp_path / "a", TWO + SEAM, fps=24.0)
    assert set(docs) == {"1", "2", "3"}
    video = docs["1"].findall(".//video//clipitem")
    assert len(docs["1"].findall(".//clipitem")) == 4 and docs["1"].tag == "xmeml"
    assert [(c.find("in").text, c.find("out").text, c.find("start").text, c.find("end").text) for c in video] == [("240", "360", "0", "120"), ("480", "660", "120", "300")]
    assert video[0].find("file/pathurl").text == "file://localhost/media/take1.mp4" and video[0].find("file/duration").text == "720" and len(video[1].find("file")) == 0
    assert docs["1"].find(".//ntsc").text == "FALSE" and docs["1"].find(".//timebase").text == "24"
    assert write(spark, tmp_path / "b", TWO, fps=23.976)["1"].find(".//ntsc").text == "TRUE"


def test_xmeml_seam(spark, tmp_path):
    video = write(spark, tmp_path / "a", SEAM, fps=30.0, punch_in=True)["2"].findall(".//video//clipitem")
    assert video[0].find("marker") is None and video[0].find("name").text == 'Clip_01_Prefix "A&B"'
    assert video[1].find("marker/name").text == "Composite Splice (Pick-up)" and video[1].find(".//parameter/value").text == "112.0" and video[1].find("name").text == "Clip_02_Pick-up <C>"


def test_fcpxml(spark, tmp_path):
    docs = write(spark, tmp_path / "a", TWO + SEAM, kind="fcpxml", fps=60.0, width=3840, height=2160, punch_in=True)
    form, clips = docs["1"].find(".//format"), docs["1"].findall(".//asset-clip")
    assert (form.get("frameDuration"), form.get("width"), form.get("height")) == ("100/6000s", "3840", "2160")
    assert [c.get("offset") for c in clips] == ["0s", "30000/6000s"] and docs["1"].find(".//sequence").get("duration") == "75000/6000s"
    seam = docs["2"].findall(".//asset-clip")
    assert list(seam[0]) == [] and [c.tag for c in seam[1]] == ["adjust-transform", "marker"] and seam[1].find("adjust-transform").get("scale") == "1.12 1.12"
    assert docs["2"].find(".//asset").get("name") == "raw & cut.mp4"
    (clip,) = write(spark, tmp_path / "b", SEAM[2:], kind="fcpxml")["3"].findall(".//asset-clip")
    assert abs(Fraction(clip.get("duration")[:-1]) - 2) <= Fraction(1001, 24000)


def test_rates():
    assert [(r.num, r.den, r.tag) for r in map(timeline.rate, (23.976, 29.97, 59.94, 24, 25.0, 60, 47.952))] == [(1001, 24000, "2398"), (1001, 30000, "2997"), (1001, 60000, "5994"), (100, 2400, "24p"), (100, 2500, "25p"), (100, 6000, "60p"), (1001, 48000, "48p")]


def test_frames_are_exact(spark):
    for per in (Fraction(24000, 1001), Fraction("23.976"), Fraction(25)):
        ms = [0, 1, 20, 41, 42, 1001, 86_399_999, 10**12 + 7]
        got = spark.createDataFrame([(m,) for m in ms], "m long").select("m", timeline.in_frames(F.col("m"), per).alias("n")).collect()
        assert {r["m"]: r["n"] for r in got} == {m: round(m * per / 1000) for m in ms}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(timeline.Timeline)
    items = timeline.fcpxml_items(spark.createDataFrame(TWO + SEAM, CLIPS)).withColumns({"media": F.lit("/m/a.mp4"), "total_ms": F.lit(1000), "sound": F.lit(None).cast("string")})
    broken = items.withColumn("item", F.when(F.col("rec_id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("item")))
    with pytest.raises(Exception, match="no"):
        broken.repartition(3, "rec_id").sortWithinPartitions("rec_id", "place").write.format("timeline").mode("append").option("path", str(tmp_path / "x")).option("kind", "fcpxml").save()
    assert not os.path.isdir(tmp_path / "x") or os.listdir(tmp_path / "x") == []
    assert write(spark, tmp_path / "e", [], kind="fcpxml") == {}
