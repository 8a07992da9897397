"""Writes clips as editing timelines, one document a recording: the interchange XML of version 4, or FCPXML 1.9.

Each clip's element is a column expression, its place on the timeline a running sum of whole frames, so offsets are exact
fractions. The sink is a data source: a task streams the elements of its recordings, in order, between a head and a foot,
into files that no reader sees; the commit moves them into place, and an abort, or a task that fails, leaves nothing.
A task holds one line; what belongs behind the first track, or needs the total in front, waits on the task's disk."""

from __future__ import annotations

import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from spanloom.functions import text as T

#: What a seam between two takes is marked with.
SEAM, SEAM_NOTE = "Composite Splice (Pick-up)", "Composite pick-up seam"
SCALE = 1.12
KINDS = ("xmeml", "fcpxml")


@dataclass(frozen=True)
class Rate:
    """A frame lasts num / den seconds; base is the whole rate, tag the format's name for it."""

    num: int
    den: int
    base: int
    ntsc: bool
    tag: str


def rate(fps: float) -> Rate:
    base = max(1, round(fps))
    if abs(fps - round(fps)) <= 0.001:
        return Rate(100, 100 * base, base, False, f"{base}p")
    return Rate(1001, 1000 * base, base, True, {24: "2398", 30: "2997", 60: "5994"}.get(base, f"{base}p"))


def in_frames(ms: Column, per_second: Fraction) -> Column:
    """Milliseconds, from 0, as the nearest whole frame, halves to the even one."""
    n, d = ms.cast("long") * per_second.numerator, 1000 * per_second.denominator
    whole, rest = F.floor(n / F.lit(d).cast("decimal(20,0)")).cast("long"), F.pmod(n, F.lit(d))
    return whole + F.when((2 * rest > d) | ((2 * rest == d) & (whole % 2 == 1)), 1).otherwise(0)


def clean(c: Column) -> Column:
    """Without the characters that no document may hold."""
    return F.regexp_replace(T.text_of(c), r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "")


def _name(clip_id: Column, topic: Column) -> Column:
    return T.escape_attr(F.concat(F.lit("Clip_"), F.format_string("%02d", clip_id), F.lit("_"), F.left(clean(topic), F.lit(15))))


def _tag(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def fcpxml_items(clips: DataFrame, fps: float = 23.976, punch_in: bool = False, scale: float = SCALE) -> DataFrame:
    """rec_id, place (from 0), item and frames of clips: rec_id, clip_id, topic, start_ms, end_ms, splice. Ordered by start_ms,
    end_ms, clip_id; null topics and splices are empty and false."""
    r = rate(fps)
    w = Window.partitionBy("rec_id").orderBy("start_ms", "end_ms", "clip_id")
    long_ = F.greatest(F.lit(1), in_frames(F.col("end_ms") - F.col("start_ms"), Fraction(r.den, r.num)))
    rows = clips.select("rec_id", "clip_id", "topic", "start_ms", "end_ms", F.coalesce("splice", F.lit(False)).alias("splice"), long_.cast("long").alias("frames"))
    rows = rows.withColumns({"place": F.row_number().over(w).cast("long") - 1, "at": F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("frames")})
    part = lambda n: F.concat((n * r.num).cast("string"), F.lit(f"/{r.den}s"))
    start = part(in_frames(F.col("start_ms"), Fraction(r.den, r.num)))
    q = F.lit('"')
    head = F.concat(F.lit('<asset-clip name="'), _name(F.col("clip_id"), F.col("topic")), F.lit('" ref="r2" offset="'), F.when(F.col("at") == 0, "0s").otherwise(part(F.col("at"))), F.lit('" start="'), start, F.lit('" duration="'), part(F.col("frames")), q)
    grown = f'<adjust-transform scale="{scale:.2f} {scale:.2f}"/>' if punch_in else ""  # the format wants it before the marker
    seam = F.concat(F.lit(f'>{grown}<marker start="'), start, F.lit(f'" duration="{r.num}/{r.den}s" value="{SEAM}"/></asset-clip>'))
    return rows.select("rec_id", "place", F.concat(head, F.when(F.col("splice"), seam).otherwise("/>")).alias("item"), "frames")


def xmeml_items(clips: DataFrame, fps: float = 23.976, punch_in: bool = False, scale: float = SCALE) -> DataFrame:
    """rec_id, place (from 0), item (video), sound and frames of clips, as fcpxml_items."""
    r, per = rate(fps), Fraction(str(fps))
    w = Window.partitionBy("rec_id").orderBy("start_ms", "end_ms", "clip_id")
    rows = clips.select("rec_id", "clip_id", "topic", "start_ms", "end_ms", F.coalesce("splice", F.lit(False)).alias("splice"), in_frames(F.col("start_ms"), per).cast("long").alias("in"), in_frames(F.col("end_ms"), per).cast("long").alias("out"))
    rows = rows.withColumn("frames", F.greatest(F.lit(1), F.col("out") - F.col("in")))
    rows = rows.withColumns({"place": F.row_number().over(w).cast("long") - 1, "to": F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    speed = F.lit(f"<rate><timebase>{r.base}</timebase><ntsc>{'TRUE' if r.ntsc else 'FALSE'}</ntsc></rate>")
    body = F.concat(_tag("name", _name(F.col("clip_id"), F.col("topic"))), speed, _tag("in", F.col("in")), _tag("out", F.col("out")), _tag("start", F.col("to") - F.col("frames")), _tag("end", F.col("to")))
    begin = lambda track: F.concat(F.lit(f'<clipitem id="clipitem-{track}'), (F.col("place") + 1).cast("string"), F.lit('">'), body, F.lit('<file id="file-1"/>'))
    grown = (
        "<filter><effect><name>Basic Motion</name><effectid>basic</effectid><effecttype>motion</effecttype><mediatype>video</mediatype>"
        f"<parameter><parameterid>scale</parameterid><name>Scale</name><value>{round(scale * 100, 1)}</value></parameter></effect></filter>"
    )
    seam = F.concat(F.lit(f"{grown if punch_in else ''}<marker>"), _tag("name", SEAM), _tag("comment", SEAM_NOTE), _tag("in", F.col("in")), _tag("out", "-1"), F.lit("</marker>"))
    end = F.lit("</clipitem>")
    return rows.select("rec_id", "place", F.concat(begin("v"), F.when(F.col("splice"), seam).otherwise(""), end).alias("item"), F.concat(begin("a"), end).alias("sound"), "frames")


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _heads(kind: str, fps: float, width: int, height: int, media: str, total_ms: int, frames: int) -> tuple[str, str, str]:
    """What stands before the items, between the two tracks (if any), and behind."""
    r, name = rate(fps), posixpath.basename(media)
    stem, url = posixpath.splitext(name)[0], _escape(media if "://" in media else f"file://localhost{media}")
    name, stem, first = _escape(name), _escape(stem), '<?xml version="1.0" encoding="UTF-8"?>\n'
    if kind == "fcpxml":
        part = lambda n: f"{n * r.num}/{r.den}s"
        head = (
            f'{first}<!DOCTYPE fcpxml>\n<fcpxml version="1.9">\n<resources>\n<format id="r1" name="FFVideoFormat{height}p{r.tag}" frameDuration="{r.num}/{r.den}s" width="{width}" height="{height}"/>\n'
            f'<asset id="r2" name="{name}" src="{url}" start="0s" duration="{part(round(Fraction(total_ms * r.den, 1000 * r.num)))}" hasVideo="1" hasAudio="1" format="r1"/>\n</resources>\n'
            f'<library>\n<event name="{stem}">\n<project name="{stem}_cut">\n<sequence format="r1" duration="{part(frames)}">\n<spine>\n'
        )
        return head, "", "</spine>\n</sequence>\n</project>\n</event>\n</library>\n</fcpxml>\n"
    speed = f"<rate><timebase>{r.base}</timebase><ntsc>{'TRUE' if r.ntsc else 'FALSE'}</ntsc></rate>"
    head = (
        f'{first}<!DOCTYPE xmeml>\n<xmeml version="4">\n<project>\n<name>{stem}</name>\n<children>\n<sequence id="sequence-1">\n<name>{stem}_cut</name>\n<duration>{frames}</duration>\n{speed}\n<media>\n<video>\n'
        f"<format><samplecharacteristics>{speed}<width>{width}</width><height>{height}</height><pixelaspectratio>square</pixelaspectratio></samplecharacteristics></format>\n<track>\n"
    )
    return head, "</track>\n</video>\n<audio>\n<track>\n", "</track>\n</audio>\n</media>\n</sequence>\n</children>\n</project>\n</xmeml>\n"


def _whole_file(fps: float, media: str, total_ms: int) -> str:
    """The description of the media file that the first item of an xmeml document holds; the others name it."""
    r, url = rate(fps), _escape(media if "://" in media else f"file://localhost{media}")
    speed = f"<rate><timebase>{r.base}</timebase><ntsc>{'TRUE' if r.ntsc else 'FALSE'}</ntsc></rate>"
    return f'<file id="file-1"><name>{_escape(posixpath.basename(media))}</name><pathurl>{url}</pathurl>{speed}<duration>{round(Fraction(total_ms) * Fraction(str(fps)) / 1000)}</duration></file>'


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.fps = options["path"].rstrip("/"), options.get("kind", KINDS[0]), float(options.get("fps", 23.976))
        if self.kind not in KINDS:
            raise ValueError(f"kind {self.kind!r}: {' or '.join(KINDS)}")
        self.size = int(options.get("width", 1920)), int(options.get("height", 1080))
        self.waiting = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, inside = _open(self.waiting)
        made, now, first, sound, frames = [], None, None, None, 0

        def close() -> None:
            name = f"{now['rec_id']}.{'xml' if self.kind == KINDS[0] else self.kind}"
            fs.create_dir(inside, recursive=True)
            hidden = f"{inside}/{uuid.uuid4().hex}"
            head, between, foot = _heads(self.kind, self.fps, *self.size, now["media"], now["total_ms"], frames)
            with fs.open_output_stream(hidden) as out:
                out.write(head.encode())
                for spool, before in ((first, ""), (sound, between)):
                    if spool is first or between:
                        out.write(before.encode())
                        spool.seek(0)
                        shutil.copyfileobj(spool, out, 1 << 20)
                    spool.close()
                out.write(foot.encode())
            made.append((hidden, name))

        for row in rows:
            if now is None or row["rec_id"] != now["rec_id"]:
                if now is not None:
                    close()
                now, frames = {"rec_id": row["rec_id"], "media": row["media"], "total_ms": int(row["total_ms"])}, 0
                first, sound = tempfile.TemporaryFile(), tempfile.TemporaryFile()
            item = row["item"]
            if self.kind == KINDS[0] and not frames:
                item = item.replace('<file id="file-1"/>', _whole_file(self.fps, now["media"], now["total_ms"]), 1)
            first.write(item.encode() + b"\n")
            sound.write((row["sound"] or "").encode() + b"\n")
            frames += row["frames"]
        if now is not None:
            close()
        return _Written(made)

    def _drop(self) -> None:
        fs, inside = _open(self.waiting)
        if fs.get_file_info(inside).type != pafs.FileType.NotFound:
            fs.delete_dir(inside)

    def commit(self, messages: list) -> None:
        fs, inside = _open(self.path)
        fs.create_dir(inside, recursive=True)
        for m in messages:
            for hidden, name in m.files if m else ():
                fs.move(hidden, f"{inside}/{name}")
        self._drop()
        fs.open_output_stream(f"{inside}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        self._drop()


class Timeline(DataSource):
    """format("timeline"): rows (rec_id, place, media, total_ms, item, sound, frames), those of a recording in order in one
    partition. Options: path, kind (xmeml or fcpxml), fps, width, height."""

    @classmethod
    def name(cls) -> str:
        return "timeline"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def write_timelines(clips: DataFrame, path: str, kind: str = KINDS[0], fps: float = 23.976, width: int = 1920, height: int = 1080, punch_in: bool = False, scale: float = SCALE) -> None:
    """A document a recording, named by rec_id, into a folder that all executors reach. clips: rec_id, clip_id, topic,
    start_ms, end_ms, splice, media (the video's path; of several the greatest) and total_ms (the video's length). A
    recording without clips has no document; null media is named by the recording."""
    spark = clips.sparkSession
    spark.dataSource.register(Timeline)
    items = (fcpxml_items if kind == "fcpxml" else xmeml_items)(clips, fps, punch_in, scale)
    if "sound" not in items.columns:
        items = items.withColumn("sound", F.lit(None).cast("string"))
    media = clips.groupBy("rec_id").agg(F.coalesce(F.max("media"), F.concat(F.lit("/"), F.first("rec_id").cast("string"))).alias("media"), F.coalesce(F.max("total_ms"), F.max("end_ms"), F.lit(0)).cast("long").alias("total_ms"))
    rows = items.join(media, "rec_id").select("rec_id", "place", "media", "total_ms", "item", "sound", "frames")
    rows.repartition("rec_id").sortWithinPartitions("rec_id", "place").write.format("timeline").mode("append").options(path=path, kind=kind, fps=fps, width=width, height=height).save()
