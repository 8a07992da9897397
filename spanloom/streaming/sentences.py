"""Sentences of segments as they arrive: the batch fold with its state in the state store.

Segments come in any order within the watermark's delay. A recording holds those that are not due yet and the open sentence;
once the watermark has passed a segment's time no earlier one can come, so it goes through the fold, in order of seg_id.
A timer goes off at the next segment that is due, and another closes the open sentence when nothing came for
``idle_ms``. So a replay gives the same sentences as the batch, whatever the files and their order, and after a restart
from the checkpoint too. Segments behind the watermark are dropped by the engine, which counts them in its progress
(numRowsDroppedByWatermark). State is what fits into the delay and one sentence a recording."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators.folds import SENTENCE, Sentences, sentence_rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "seg_id long, start_ms long, end_ms long, nl long, closes boolean, clause boolean, slate boolean, kana boolean, speaker string, target boolean, drawn boolean, last_ms long, last_n long"
OPEN = "count long, start_ms long, end_ms long, n_segs long, n_chars long, slate boolean, kana boolean, closes boolean, clause boolean, speaker string, target boolean, last_ms long, last_n long"
Row = namedtuple("Row", ["rec_id", *(f.split(" ")[0] for f in ROW.split(", "))])
NAMES = [f.split(" ")[0] for f in SENTENCE.split(", ")]


class SentenceProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"due long, {ROW}")
        self.open = handle.getValueState("open", OPEN)
        self.seen = handle.getValueState("seen", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.due), *(_plain(getattr(r, f)) for f in Row._fields[1:])) for frame in rows for r in frame.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            last = max([r[0] for r in new] + ([self.seen.get()[0]] if self.seen.exists() else []))
            self.seen.update((last,))
            self.handle.registerTimer(min(r[0] for r in new))
            self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame([], columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        fold, out = self._fold(key[0]), []
        for r in due:
            out += fold.push(Row(key[0], *r[1:]))
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0])
            else:
                self.waiting.clear()
        if not rest and self.seen.exists() and self.seen.get()[0] + self.idle <= now:
            out += fold.close()
        self._keep(fold)
        yield pd.DataFrame(out, columns=NAMES)

    def _fold(self, rec: int) -> Sentences:
        fold = Sentences()
        if self.open.exists():
            count, start, end, segs, chars, slate, kana, closes, clause, speaker, target, last_ms, last_n = tuple(self.open.get())
            fold.count = count
            if start is not None:
                fold.open, fold.slate, fold.kana = [rec, count, start, end, segs, chars], slate, kana
                fold.last = Row(rec, None, None, end, None, closes, clause, None, None, speaker, target, None, last_ms, last_n)
        return fold

    def _keep(self, fold: Sentences) -> None:
        if fold.open:
            r = fold.last
            self.open.update((fold.count, *fold.open[2:], fold.slate, fold.kana, r.closes, r.clause, r.speaker, r.target, r.last_ms, r.last_n))
        elif fold.count:
            self.open.update((fold.count, *[None] * 12))

    def close(self) -> None:
        pass


def _plain(value):
    """A value of Python's own type; null for what pandas takes for null."""
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def stream_sentences(segments: DataFrame, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """SENTENCE of a stream of segments: as operators.folds.sentence_rows wants them, and ts, a timestamp that rises with
    seg_id in each recording. A recording is closed once the watermark is idle_ms beyond its last segment; one that goes on
    later begins a new sentence with the next number."""
    spark = segments.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only store that holds timers
    marked = segments.withWatermark("ts", delay)
    rows = sentence_rows(marked, "ts").withColumn("due", F.unix_millis(F.col("ts").cast("timestamp")))
    return rows.groupBy("rec_id").transformWithStateInPandas(statefulProcessor=SentenceProcessor(idle_ms), outputStructType=SENTENCE, outputMode="Append", timeMode="EventTime")
