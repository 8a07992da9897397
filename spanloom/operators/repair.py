"""Repairs edit lists until nothing is left to look at: a loop of DataFrames that works on what changed only.

Each round finds all windows of the recordings that are still open, hands their clips to a judge, puts its clips in the place
of the windows' own, marked as verified, and goes on with those recordings. A candidate that is longer than a window may be
has a window to itself. A pair that goes over a window's end, which may not grow, parts the list there, and the next
round looks at the clips on both sides though they are verified. A recording without windows is settled and leaves the loop; one whose
windows hold only what a judge saw already (clips without sentences) leaves it too, not settled. Each round verifies a clip or
closes a parting, so the loop ends. A round's clips are checkpointed, so the plan does not grow with the rounds and a lost
executor's work is read again, not done again from the start."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anomalies, takes
from .folds import fold

CLIP = "rec_id long, clip_id long, start_ms long, end_ms long, text string, first_seg long, last_seg long, verified boolean, total_ms long"
NAMES = [c.split(" ")[0] for c in CLIP.split(", ")]


def checkpoint(df: DataFrame) -> DataFrame:
    """df as written to the folder that the cluster names in spark.checkpoint.dir; on a local master without one, to a
    folder of this machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def judged(clips: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """What the rules alone keep of a window's clips (id, start_ms, end_ms, text), in order: a clip goes if a later one begins
    it anew; what the next one says again at its start leaves its end, and the time in proportion."""
    kept: list[tuple[int, int, int, str]] = []
    for i, start, end, text in clips:
        now = takes.Take(takes.bare(text), takes.bare(text))
        while kept and takes.opens_again(takes.Take(takes.bare(kept[-1][3]), takes.bare(kept[-1][3])), now):
            kept.pop()
        if kept:
            j, a, b, said = kept[-1]
            norm = takes.bare(said)
            again = takes.overlap(norm, now.norm, takes.Script())
            at = norm.rfind(again) if again else -1
            if at == 0:
                kept.pop()
            elif at > 0:
                left = _before(said, at)
                kept[-1] = (j, a, a + (b - a) * at // len(norm), left)
        kept.append((i, start, end, text))
    return kept


def _before(text: str, n: int) -> str:
    """The start of text before its word character n (from 0)."""
    for i, c in enumerate(text):
        if c == "_" or c.isalnum():
            if n == 0:
                return text[:i].rstrip()
            n -= 1
    return text


class _Judged:
    """A recording's windows, one after the other; holds the clips of one."""

    def __init__(self) -> None:
        self.rows: list = []

    def push(self, row) -> list:
        out = self.close() if self.rows and self.rows[0].window_id != row.window_id else []
        self.rows.append(row)
        return out

    def close(self) -> list:
        by, self.rows = {r.clip_id: r for r in self.rows}, []
        number = lambda x: None if x is None or x != x else int(x)
        kept = judged([(r.clip_id, r.start_ms, r.end_ms, r.text or "") for r in by.values()])
        return [(r.rec_id, i, s, e, t, number(r.first_seg), number(r.last_seg), True, number(r.total_ms)) for i, s, e, t in kept for r in (by[i],)]


def by_rules(windows: DataFrame) -> DataFrame:
    """A judge without a model: ``judged`` for each window. windows: the clips of windows, CLIP and window_id, kinds. A window is
    at most a minute and a half long, or has a clip or two, so its clips are few; they are read as a stream, not as a frame a
    window."""
    return fold(windows.select(*NAMES, "window_id"), "rec_id", ["window_id", "start_ms", "end_ms", "clip_id"], CLIP, _Judged)


def repair(clips: DataFrame, judge: Callable[[DataFrame], DataFrame] = by_rules, most_rounds: int | None = None) -> DataFrame:
    """CLIP with rounds (how many the recording was in) and settled. clips: as anomalies.candidates wants them; clip_id is unique
    in a recording. judge gets the clips of all windows (CLIP, window_id, kinds) and gives clips in their place, of the
    columns CLIP; of a window for which it gives none nothing is left. The loop ends when there is nothing new to judge, or, if
    it is given, after ``most_rounds``, with what then has windows as not settled."""
    given = {"verified": F.lit(False), "total_ms": F.lit(None).cast("long")}
    for c in given:
        if c in clips.columns:
            given[c] = F.coalesce(F.col(c), F.lit(False)) if c == "verified" else F.col(c)
    rows = clips.withColumns(given)
    rec = Window.partitionBy("rec_id")
    order = rec.orderBy("start_ms", "end_ms", "clip_id")
    total = F.coalesce("total_ms", F.max("end_ms").over(rec))
    open_ = rows.withColumn("total_ms", total).select(*(F.col(n).cast(t).alias(n) for n, t in (c.split(" ") for c in CLIP.split(", "))), F.lit(0).cast("long").alias("part"))
    open_ = checkpoint(open_)
    done = []
    for rounds in count():
        found = checkpoint(anomalies.candidates(open_, whole=True))
        ranges = anomalies.merge(found).select("rec_id", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("_at"), F.struct("window_id", "kinds").alias("_w"), F.lit(False).alias("_pair"))
        pairs = found.filter(F.col("step") == anomalies.PAIR).select("rec_id", F.col("first").alias("_at"), F.lit(None).cast(ranges.schema["_w"].dataType).alias("_w"), F.lit(True).alias("_pair"))
        marks = ranges.unionByName(pairs).groupBy("rec_id", "_at").agg(F.min("_w").alias("_w"), F.max("_pair").alias("_pair"))
        at = open_.withColumn("_at", (F.row_number().over(order) - 1).cast("long")).join(marks, ["rec_id", "_at"], "left").select(*NAMES, "part", "_w.window_id", "_w.kinds", "_pair")
        after, before = F.lead("window_id").over(order), F.lag("window_id").over(order)
        parted = F.coalesce("_pair", F.lit(False)) & ~F.coalesce(F.col("window_id") == after, F.lit(False))
        joins = F.coalesce((F.col("window_id") == before) & (F.col("part") != F.lag("part").over(order)), F.lit(False))
        at = at.withColumns({"_parted": parted, "_new": F.col("window_id").isNotNull() & (~F.col("verified") | joins)})
        at = checkpoint(at.withColumns({"_has": F.max(F.col("window_id").isNotNull()).over(rec), "_new": F.max("_new").over(rec)}))
        goes_on = F.col("_has") & (F.col("_new") if most_rounds is None else F.lit(rounds < most_rounds))
        done.append(at.filter(~goes_on).select(*NAMES, F.lit(rounds).alias("rounds"), (~F.col("_has")).alias("settled")))
        at = at.filter(goes_on)
        if at.isEmpty():
            break
        judgement = judge(at.filter("window_id IS NOT NULL").select(*NAMES, "window_id", "kinds")).select(*NAMES).withColumn("verified", F.lit(True))
        left = at.filter("window_id IS NULL").select(*NAMES).unionByName(judgement).withColumn("_parted", F.lit(0))
        left = left.unionByName(at.filter("_parted").select(*NAMES, F.lit(1).alias("_parted")))  # stands behind the clip, whether that is kept or not
        part = F.sum("_parted").over(rec.orderBy("start_ms", "end_ms", "clip_id", "_parted").rowsBetween(Window.unboundedPreceding, 0))
        open_ = checkpoint(left.withColumn("part", part).filter("_parted = 0").drop("_parted"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
