"""Where speech begins in a signal, and where two takes are best joined.

A signal is its mean square of every millisecond, a row a second: whatever stretch of whole milliseconds is asked for, its
energy is a difference of two running sums. Words and seams are joined with the few seconds that they lie in, so a
recording of any length is spread over as many tasks as there are words, and a task holds seconds of signal, not
recordings. The rest is arithmetic on one word's milliseconds.

Times are whole milliseconds. A second that is missing, or ends early, is where the signal ends: windows that reach beyond
it are silent for onsets and are moved back to it for seams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The amplitude of silence (-40 dB), and how much louder than that speech begins.
SILENCE, SPEECH = 10 ** (-40 / 20), 3.5 / 1.8
SECOND = 1000


def energy(samples: DataFrame) -> DataFrame:
    """(rec_id, second, e): mean squares of each whole millisecond of samples: rec_id, second, rate (samples a second, a multiple
    of 1000), x (array of amplitudes of that second, from its beginning)."""

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, rates in batches:
            out = []
            for x, rate in zip(xs, rates, strict=True):
                k = int(rate) // SECOND
                v = np.asarray(x, dtype="float64")[: len(x) // k * k]
                out.append((v * v).reshape(-1, k).mean(axis=1))
            yield pd.Series(out)

    whole = samples.filter("x IS NOT NULL AND rate >= 1000")
    return whole.select("rec_id", "second", F.pandas_udf(cut, "array<double>")("x", "rate").alias("e"))


def _near(rows: DataFrame, signal: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """rows with from_ms and e, the signal from there on over the seconds of [lo, hi]; null without any. Both joins are by sorting:
    the planner sees no length of an array, takes seconds of signal for narrow rows and would send all of it to every task."""
    asked = rows.select(*keys, F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / SECOND), F.floor(F.greatest(hi, F.lit(0)) / SECOND))).alias("second"))
    got = asked.join(signal.select("rec_id", "second", "e").hint("merge"), ["rec_id", "second"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("second", "e"))).alias("_s"))
    got = got.select(*keys, (F.get("_s", F.lit(0))["second"] * SECOND).alias("from_ms"), F.flatten(F.transform("_s", lambda s: s["e"])).alias("e"))
    return rows.join(got.hint("merge"), keys, "left")


class Signal:
    """Mean squares of the milliseconds from ``start`` on."""

    def __init__(self, e, start: int) -> None:
        self.start, self.n = start, len(e)
        self.sums = np.concatenate([[0.0], np.cumsum(e)])

    def rms(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Of windows that begin at ``starts``; 0 for one that is not all inside."""
        at = np.asarray(starts, dtype="int64") - self.start
        inside = (at >= 0) & (at + width <= self.n)
        at = np.where(inside, at, 0)
        ms = (self.sums[np.minimum(at + width, self.n)] - self.sums[at]) / width
        return np.where(inside, np.sqrt(np.maximum(ms, 0.0)), 0.0)

    def floor(self, centre: float) -> float:
        """The tenth percentile of 30 ms windows from a second before to 1.2 s behind."""
        first, last = max(self.start, int(centre) - 1000), min(self.start + self.n, int(centre) + 1200)
        if last - first <= 30:
            return SILENCE * 0.15
        return float(np.percentile(self.rms(np.arange(first, last - 30, 10), 30), 10))

    def voiced_db(self, first: int, last: int) -> float | None:
        first, last = max(self.start, first), min(self.start + self.n, last)
        if last - first < 20:
            return None
        r = self.rms(np.arange(first, last - 20 + 1, 10), 20)
        loud = r[r >= SILENCE * 0.9]
        mean = math.sqrt(float(np.mean(np.square(loud if len(loud) else r))))
        return 20 * math.log10(mean) if mean > 1e-7 else None


def _onset(s: Signal, start: int, end: int, gap: int = 10, most_low: int = 12) -> int:
    times = np.arange(start, max(start + gap, end - 20), gap)
    if len(times) < 4:
        return start
    low = s.floor((start + end) / 2)
    soft, core = max(SILENCE * 0.85, low * 1.6), max(SILENCE * SPEECH, low * 3.2)
    r = s.rms(times, 20)
    loud = np.flatnonzero(r >= core)
    if not len(loud):
        return start
    begins, quiet = loud[-1], 0
    for i in range(loud[-1], -1, -1):
        quiet = quiet + 1 if r[i] < soft else 0
        if quiet > most_low:
            break
        if not quiet:
            begins = i
    return min(max(start, int(times[begins]) - 15), max(start, end - 60))


def onsets(words: DataFrame, signal: DataFrame) -> DataFrame:
    """(rec_id, word_id, onset_ms) of words: rec_id, word_id, start_ms, end_ms, prev_end_ms (null: none), cut_head. A word behind a
    pause of 150 ms or more, or whose head was cut, begins where its last loud stretch does, as far back as it is not quiet for
    over 120 ms; other words, and words of under 140 ms, begin where they are said to, or where the one before ends."""
    keys = ["rec_id", "word_id"]
    start = F.greatest("start_ms", "prev_end_ms")
    rows = words.select(*keys, start.alias("s"), F.col("end_ms").alias("t"), (F.coalesce("cut_head", F.lit(False)) | F.coalesce(F.col("start_ms") - F.col("prev_end_ms") >= 150, F.lit(False))).alias("ask"))
    rows = rows.withColumn("ask", F.col("ask") & (F.col("t") - F.col("s") >= 140))
    centre = (F.col("s") + F.col("t")) / 2
    near = _near(rows.filter("ask"), signal, keys, F.least(F.col("s"), centre - 1000), F.greatest(F.col("t"), centre + 1200))

    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ss, ts, froms, es in batches:
            yield pd.Series([s if e is None or not len(e) else _onset(Signal(e, int(f)), int(s), int(t)) for s, t, f, e in zip(ss, ts, froms, es, strict=True)], dtype="int64")

    asked = near.select(*keys, F.pandas_udf(find, "long")("s", "t", "from_ms", "e").alias("onset_ms"))
    return rows.filter("NOT ask").select(*keys, F.col("s").alias("onset_ms")).unionByName(asked)


def _pivot(s: Signal | None, left: list, right: list, shared: int, least: int = 550) -> int:
    best, cost_of_best = 0, math.inf
    for p in range(shared + 1):
        keep = len(left) - shared + p
        if keep <= 0 or p >= len(right) or left[keep - 1][1] - left[0][0] < least or right[-1][1] - right[p][0] < least:
            continue
        a, b = left[keep - 1][1], right[p][0]
        pause = min(250, max(0, left[keep][0] - a)) if keep < len(left) else 0
        pause += min(250, max(0, b - right[p - 1][1])) if p else 0
        cost = -1.8 * pause / 1000 - (0.15 if p == 0 else 0.0)
        if s is not None:
            if s.n > 20:
                at = np.clip([a, b], s.start, s.start + s.n - 20)
                cost += 5 * float(s.rms(at, 20).sum())
            one, two = s.voiced_db(max(left[0][0], a - 220), a), s.voiced_db(b, min(right[-1][1], b + 220))
            cost += 0.12 * abs(one - two) if one is not None and two is not None else 0.0
        if cost < cost_of_best:
            best, cost_of_best = p, cost
    return best


def pivots(seams: DataFrame, signal: DataFrame) -> DataFrame:
    """(rec_id, seam_id, pivot) of seams: rec_id, seam_id, prefix, rest (arrays of struct(start_ms, end_ms), in order), shared: of
    the last ``shared`` words of the prefix, said again as the first of the rest, how many the prefix keeps. Pauses and quiet
    at the cut and like loudness on both sides count for a cut, and a little that the later take says all of it; both parts last
    550 ms or more."""
    keys = ["rec_id", "seam_id"]
    rows = seams.filter("size(prefix) > 0 AND size(rest) > 0").select(*keys, "prefix", "rest", F.greatest("shared", F.lit(0)).alias("shared"))
    first = F.get("prefix", F.greatest(F.size("prefix") - F.col("shared") - 1, F.lit(0)))["start_ms"]
    last = F.get("rest", F.least(F.size("rest") - 1, F.col("shared")))["end_ms"]
    near = _near(rows, signal, keys, first - 300, last + 300)

    def find(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        words = lambda a: [(int(w["start_ms"]), int(w["end_ms"])) for w in a]
        for lefts, rights, ns, froms, es in batches:
            yield pd.Series([_pivot(None if e is None or not len(e) else Signal(e, int(f)), words(a), words(b), int(n)) for a, b, n, f, e in zip(lefts, rights, ns, froms, es, strict=True)], dtype="int64")

    got = near.select(*keys, F.pandas_udf(find, "long")("prefix", "rest", "shared", "from_ms", "e").alias("pivot"))
    empty = seams.filter("NOT coalesce(size(prefix) > 0 AND size(rest) > 0, false)").select(*keys, F.lit(0).cast("long").alias("pivot"))
    return got.unionByName(empty)
