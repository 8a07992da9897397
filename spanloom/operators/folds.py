"""Folds over ordered rows, where a row's place depends on what was made of the rows before it.

Rows are dealt by key and sorted within partitions; a fold reads them as a stream of Arrow batches and holds one
key's state, never one key's rows. So a recording of any length takes the memory of one open sentence or clip.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

from . import takes


def fold(df: DataFrame, key: str, order: Sequence[str], schema: str, new_state: Callable) -> DataFrame:
    """new_state() gives an object with push(row) and close(), both of which return the tuples that are ready."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if state is None or getattr(row, key) != now:
                    out += state.close() if state else []
                    state, now = new_state(), getattr(row, key)
                out += state.push(row)
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame(state.close(), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Sentences:
    """Segments to sentences. A segment begins a new one after a long gap; after a shorter gap, or with a drawn-out first
    word, once the sentence has some length; after any pause once it is long; after a closing mark; after a clause mark with a
    breath, or where the word before the mark took the breath's time; after a slate in Latin letters; between scripts; and
    where the speaker, or whether it is the one wanted, changes."""

    def __init__(self) -> None:
        self.open: list | None = None
        self.count = 0
        self.last = None

    def _begins(self, row) -> bool:
        last, gap, n = self.last, row.start_ms - self.open[3], self.open[5]
        if gap >= 550 or ((gap >= 200 or row.drawn) and n >= 5) or (gap >= 250 and n >= 3 and row.nl >= 4):
            return True
        if (row.end_ms - self.open[2] >= 8000 and gap >= 120) or last.closes:
            return True
        breath = gap >= 120 or last.last_ms + max(gap, 0) * last.last_n >= 320 * last.last_n or last.last_ms >= 250 * last.last_n
        if last.clause and ((n >= 6 and row.nl >= 2 and breath) or gap >= 180):
            return True
        slate = self.slate and not row.slate and gap >= 150
        return slate or self.kana != row.kana or last.target != row.target or (last.speaker != row.speaker and bool(last.speaker) and bool(row.speaker))

    def push(self, row) -> list:
        out = self.close() if self.open and self._begins(row) else []
        if self.open:
            self.open[3], self.open[4], self.open[5] = row.end_ms, self.open[4] + 1, self.open[5] + row.nl
            self.slate, self.kana = self.slate and row.slate, self.kana or row.kana
        else:
            self.count += 1
            self.open = [row.rec_id, self.count, row.start_ms, row.end_ms, 1, row.nl]
            self.slate, self.kana = row.slate, row.kana
        self.last = row
        return out

    def close(self) -> list:
        out = [tuple(self.open)] if self.open else []
        self.open = None
        return out


SENTENCE = "rec_id long, sent_id long, start_ms long, end_ms long, n_segs long, n_chars long"


def sentence_rows(segments: DataFrame, *more: str) -> DataFrame:
    """What the fold looks at, and the columns ``more``, of segments: rec_id, seg_id, start_ms, end_ms, text and, any of
    them left out or null: speaker, target (true if null), first_ms and first_n, last_ms and last_n (time and word characters
    of the first and last word). A segment without text has no marks, no script and is no slate."""
    given = lambda c, t, d: (F.coalesce(F.col(c).cast(t), F.lit(d)) if c in segments.columns else F.lit(d).cast(t)).alias(c)
    text, first_n = T.text_of(F.col("text")), F.greatest(given("first_n", "long", 1), F.lit(1))
    first_ms = given("first_ms", "long", 0)
    return segments.select(
        *more, "rec_id", "seg_id", "start_ms", "end_ms", F.length(T.norm(text)).cast("long").alias("nl"), T.ends_with_any(text, T.CLOSURE).alias("closes"), T.ends_with_any(text, T.CLAUSE).alias("clause"),
        F.trim(text).rlike(r"^[A-Za-z0-9\s\-_]+$").alias("slate"), text.rlike(r"[\x{3040}-\x{30FF}]").alias("kana"), given("speaker", "string", ""), given("target", "boolean", True),
        ((first_ms >= 1200) & (first_ms >= 450 * first_n)).alias("drawn"), given("last_ms", "long", 0), F.greatest(given("last_n", "long", 1), F.lit(1)).alias("last_n"),
    )


def sentences(segments: DataFrame) -> DataFrame:
    """SENTENCE of segments as sentence_rows wants them."""
    return fold(sentence_rows(segments), "rec_id", ["seg_id"], SENTENCE, Sentences)


class Pauses:
    """Words of a sentence to parts: after a closing mark; after a clause mark that took a breath's time; after a short
    opening whose last syllable drags; and at a pause, or before a drawn-out word, between two clauses."""

    def __init__(self) -> None:
        self.seg, self.open, self.last = None, None, None

    def _begins(self, row) -> bool:
        last, n, rest = self.last, self.open[6], row.rest
        gap, chars = row.start_ms - last.end_ms, max(1, last.nl)
        took = last.end_ms - last.start_ms
        if last.closes and n >= 2 and rest >= 1:
            return True
        breath = gap >= 120 or took + max(gap, 0) * chars >= 320 * chars or took >= 250 * chars
        if last.clause and breath and n >= 6 and rest >= 2:
            return True
        drags = (took >= 275 * chars and gap >= 60) or (took >= 310 * chars and gap >= 35)
        if drags and 2 <= n <= 5 and (n <= 4 or gap >= 60) and rest >= 4:
            return True
        own = row.end_ms - row.start_ms
        drawn = own >= 1200 and own >= 450 * max(1, row.nl)
        return (gap >= 180 or drawn) and n >= (3 if gap >= 250 else 5) and rest >= 5

    def push(self, row) -> list:
        out = []
        if row.seg_id != self.seg:
            out, self.seg, part = self.close(), row.seg_id, 1
        elif self._begins(row):
            part = self.open[2] + 1
            out = self.close()
        if self.open:
            self.open[4], self.open[5], self.open[6] = row.end_ms, self.open[5] + 1, self.open[6] + row.nl
        else:
            self.open = [row.rec_id, row.seg_id, part, row.start_ms, row.end_ms, 1, row.nl]
        self.last = row
        return out

    close = Sentences.close


def split_at_pauses(words: DataFrame) -> DataFrame:
    """(rec_id, seg_id, part, start_ms, end_ms, n_words, n_chars): the parts, from 1, of sentences' words: rec_id, seg_id (the
    sentence), pos, word, start_ms, end_ms. Null words count as empty."""
    w = Window.partitionBy("rec_id", "seg_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    word = T.text_of(F.col("word"))
    rows = words.select("rec_id", "seg_id", "pos", "start_ms", "end_ms", F.length(T.norm(word)).cast("long").alias("nl"), T.ends_with_any(word, T.CLOSURE).alias("closes"), T.ends_with_any(word, T.CLAUSE).alias("clause"))
    rows = rows.withColumn("rest", F.sum("nl").over(w))
    return fold(rows, "rec_id", ["seg_id", "pos"], "rec_id long, seg_id long, part long, start_ms long, end_ms long, n_words long, n_chars long", Pauses)


class Sanitized:
    """Clips in order of time to clips that do not overlap. A clip inside its predecessor (50 ms allowed) goes; an overlap is cut
    in its middle, but not into what either says, and 150 ms are left of each or the later one goes. A clip too short joins its
    neighbour across a small gap, unless words were cut there or it is a seam. Two clips are held: the last one, which the next
    may still cut, and the one before it that shorter ones may join."""

    def __init__(self, least: int, gap: int) -> None:
        self.least, self.gap, self.last, self.open, self.count = least, gap, None, None, 0

    def push(self, row) -> list:
        # start, end, first, last, clips, and what its edges are
        c = [int(row.start_ms), int(row.end_ms), int(row.t_first), int(row.t_last), 1, row.cut_head or row.splice or row.role == "continuation", row.cut_tail or row.role == "prefix", row.rec_id]
        p = self.last
        if p is None:
            self.last = c if c[1] > c[0] else None
            return []
        if c[1] <= p[1] + 50:
            p[4] += 1
            return []
        if c[0] < p[1]:
            low, high = p[0] + 150, c[1] - 150
            if high < low:
                p[4] += 1
                return []
            p[1] = c[0] = max(low, min(high, max(p[3], min(c[2], (p[1] + c[0]) // 2))))
        if c[1] - c[0] < 150:
            return []
        out = self._join(p)
        self.last = c
        return out

    def _join(self, c: list) -> list:
        m = self.open
        if m is not None and not m[6] and not c[5] and min(c[1] - c[0], m[1] - m[0]) < self.least and c[1] > m[1] and 0 <= c[0] - m[1] <= self.gap:
            m[1], m[4] = c[1], m[4] + c[4]
            return []
        out = self._out()
        self.open = c
        return out

    def _out(self) -> list:
        m = self.open
        if m is None:
            return []
        self.count += 1
        return [(m[7], self.count, m[0], m[1], m[4])]

    def close(self) -> list:
        out = self._join(self.last) if self.last else []
        return out + self._out()


def sanitize(clips: DataFrame, least_ms: int = 450, gap_ms: int = 350) -> DataFrame:
    """(rec_id, clip_id, start_ms, end_ms, n_clips) of clips: rec_id, clip_id, start_ms, end_ms and, any of them left out or null:
    t_first and t_last (the first word's start, the last word's end), wall (where the next word begins that is not said),
    cut_head, cut_tail, splice, role and total_ms (the recording's length).

    First each clip is brought inside the recording, to its last word's end and 40 ms beyond where it ends before that, but not
    beyond its wall; one that does not last gets 500 ms. n_clips counts those that went into a clip."""
    has = lambda c, t: (F.col(c).cast(t) if c in clips.columns else F.lit(None).cast(t))
    flag = lambda c: F.coalesce(has(c, "boolean"), F.lit(False)).alias(c)
    total, last, wall = F.coalesce(has("total_ms", "long"), F.lit(1 << 62)), has("t_last", "long"), has("wall", "long")
    inside = lambda c: F.greatest(F.lit(0), F.least(total, c))
    rows = clips.select("rec_id", "clip_id", inside(F.col("start_ms")).alias("start_ms"), inside(F.col("end_ms")).alias("end_ms"), has("t_first", "long").alias("t_first"), last.alias("t_last"), wall.alias("wall"), flag("cut_head"), flag("cut_tail"), flag("splice"), F.coalesce(has("role", "string"), F.lit("none")).alias("role"), total.alias("total_ms"))
    tail = F.least("total_ms", F.col("t_last") + 40)
    tail = F.when(F.col("wall").isNull(), tail).otherwise(F.least(tail, F.greatest("t_last", "wall")))
    end = F.when(F.col("end_ms") < F.col("t_last"), tail).when(F.col("end_ms") > F.col("wall"), F.greatest(F.coalesce("t_last", F.col("start_ms") + 150), F.col("wall"))).otherwise(F.col("end_ms"))
    rows = rows.withColumn("end_ms", end).withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.least("total_ms", F.col("start_ms") + 500)).otherwise(F.col("end_ms")))
    rows = rows.withColumns({"t_first": F.coalesce("t_first", "start_ms"), "t_last": F.coalesce("t_last", F.col("start_ms") + 200)}).drop("wall", "total_ms")
    return fold(rows, "rec_id", ["start_ms", "end_ms", "clip_id"], "rec_id long, clip_id long, start_ms long, end_ms long, n_clips long", lambda: Sanitized(least_ms, gap_ms))


class Loops:
    """Words without repeats in a row: a run of ``most`` or more equal words or groups keeps its first copy. Words are
    compared by their ``same``; a group of nothing but empty ones is no repeat. Holds the last words only, as many as the
    longest run can need before it is told from new words."""

    def __init__(self, longest: int, most: int) -> None:
        self.longest, self.most, self.kept = longest, most, []

    def _reps(self, n: int) -> int:
        return self.most if n >= 3 else self.most + 1

    def push(self, row) -> list:
        self.kept.append(((row.rec_id, row.seg_id, row.pos, row.word), row.same))
        return self._flush(False)

    def _flush(self, end: bool) -> list:
        out = []
        while self.kept and (end or len(self.kept) >= self.longest * (self.most + 2)):
            word = [w for _, w in self.kept]
            step = 1
            for n in range(min(self.longest, len(word) // self.most), 0, -1):
                reps = 1
                if not any(word[:n]):
                    continue
                while word[reps * n : (reps + 1) * n] == word[:n]:
                    reps += 1
                if reps >= self._reps(n):
                    if not end and (reps + 1) * n > len(word):  # the run may go on
                        del self.kept[n : (reps - self._reps(n) + 1) * n]
                        return out
                    out += [row for row, _ in self.kept[:n]]
                    step = reps * n
                    break
            else:
                out.append(self.kept[0][0])
            del self.kept[:step]
        return out

    def close(self) -> list:
        return self._flush(True)


def drop_loops(words: DataFrame, longest: int = 8, most: int = 3) -> DataFrame:
    """words: rec_id, seg_id, pos, word. Words are equal that are so in lower case without marks and symbols."""
    same = F.trim(F.regexp_replace(F.lower(F.coalesce("word", F.lit(""))), r"[\p{P}\p{S}]", ""))
    rows = words.select("rec_id", "seg_id", F.col("pos").cast("long").alias("pos"), "word", same.alias("same"))
    return fold(rows, "rec_id", ["seg_id", "pos"], "rec_id long, seg_id long, pos long, word string", lambda: Loops(longest, most))


class Groups:
    """Timed words to short groups. After a word a group ends by a pause, a closing mark, from the soft width on by a
    short pause or a clause mark, and anyway at the hard width or the longest time."""

    def __init__(self, soft: int, hard: int, longest_ms: int) -> None:
        self.soft, self.hard, self.longest, self.open, self.count = soft, hard, longest_ms, None, 0

    def push(self, row) -> list:
        out = []
        if self.open:
            gap, wide = row.start_ms - self.open[3], self.width >= self.soft
            if gap >= 350 or self.closed or (wide and (gap >= 120 or self.clause)) or self.width >= self.hard or self.open[3] - self.open[2] >= self.longest:
                out = self.close()
        if not self.open:
            self.count += 1
            self.open, self.width = [row.rec_id, self.count, row.start_ms, row.end_ms, []], 0
        self.open[3] = row.end_ms
        self.open[4].append(row.word)
        self.width += row.width
        self.closed, self.clause = row.closed, row.clause
        return out

    close = Sentences.close


def word_groups(words: DataFrame, cjk: bool = False) -> DataFrame:
    """(rec_id, group_id, start_ms, end_ms, words) of words: rec_id, seg_id, pos, word, start_ms, end_ms. Widths are in
    half-width units for CJK, else characters and a space; empty words are left out, null ones too."""
    w = F.trim(F.coalesce("word", F.lit("")))
    width = F.length(w) + F.regexp_count(w, F.lit(r"[^\x00-\x7F]")) if cjk else F.length(w) + 1
    tail = r"[\"'”’）)]*$"
    rows = words.select("rec_id", "seg_id", "pos", w.alias("word"), "start_ms", "end_ms", width.cast("long").alias("width"), w.rlike("[。！？.!?]" + tail).alias("closed"), w.rlike(r"[，、；：,;:\-]" + tail).alias("clause")).filter("word <> ''")
    soft, hard = (30, 48) if cjk else (38, 60)
    return fold(rows, "rec_id", ["seg_id", "pos"], "rec_id long, group_id long, start_ms long, end_ms long, words array<string>", lambda: Groups(soft, hard, 5_500))


class Retakes:
    """Takes (head, doc_id, n) in order of id: the latest take before each that is at most as much longer as allowed.
    A take covers those before it that need as much length or more, so both ids and needs of those held rise."""

    def __init__(self) -> None:
        self.ids, self.needs, self.now, self.least = [], [], None, 0

    def push(self, row) -> list:
        need = row.n * 3 // 4
        if row.doc_id != self.now:
            if self.now is not None:
                keep = bisect_left(self.needs, self.least)
                del self.ids[keep:], self.needs[keep:]
                self.ids.append(self.now)
                self.needs.append(self.least)
            self.now, self.least = row.doc_id, need
        self.least = min(self.least, need)
        at = bisect_right(self.needs, row.n)
        return [(self.ids[at - 1], row.doc_id)] if at else []

    def close(self) -> list:
        return []


def earlier_takes(takes: DataFrame) -> DataFrame:
    """(before, doc_id) of takes: head, doc_id, n. Of each take the latest earlier one with the same head of which it
    has three quarters of the length n or more. One head is one task, of narrow rows, and holds as many rows as there
    are different lengths at most."""
    return fold(takes.filter("doc_id IS NOT NULL").select("head", "doc_id", "n"), "head", ["doc_id"], "before long, doc_id long", Retakes)


class Chunks:
    """Cuts a recording into chunks at pauses, never inside a cluster of takes of one sentence if it can be helped.

    Holds the sentences of the open chunk: no more than fit into the longest chunk, and four behind it. At a pause that
    is long enough, once the chunk is, the cut goes back to before the first of the takes that go on behind it; if the
    pause there is too short the search goes on. At the longest length the cut goes to the longest pause that parts no
    takes. What is behind a cut is looked at again as the beginning of the next chunk. The rest is the last chunk once it
    is short enough; of it only the number is kept."""

    AHEAD = 4

    def __init__(self, target: int, pause: int, longest: int) -> None:
        self.target, self.pause, self.longest = target, pause, longest
        self.start, self.units, self.at, self.earliest, self.count, self.rest = None, [], 0, 0, 0, 0

    def push(self, row) -> list:
        if self.start is None:
            self.start = 0 if row.start_ms < 30_000 else row.start_ms - 5_000
            self.rec, self.total = row.rec_id, row.total_ms
        if self.total - self.start <= self.longest:
            self.rest += 1
            return []
        self.units.append((int(row.start_ms), int(row.end_ms), takes.Take(row.norm, row.bare)))
        return self._cut(False)

    def _cut(self, end: bool) -> list:
        out = []
        while self.at < len(self.units) - 1 and (end or self.at + self.AHEAD < len(self.units) - 1):
            found = self._split()
            if found is None:
                self.at += 1
                continue
            stop, begin = self.units[found][1], self.units[found + 1][0]
            middle = stop + max(0, begin - stop) // 2
            self.count += 1
            out.append((self.rec, self.count, self.start, middle, found + 1))
            self.start, self.units, self.at, self.earliest = middle, self.units[found + 1 :], 0, 0
            if self.total - self.start <= self.longest:
                self.rest, self.units = len(self.units), []
        return out

    def _split(self) -> int | None:
        """The unit behind which to cut, if one is settled at the one looked at."""
        i, units = self.at, self.units
        length = units[i][1] - self.start
        if length * 100 >= self.target * 65 and self.earliest == 0:
            self.earliest = i
        if length >= self.target and units[i + 1][0] - units[i][1] >= self.pause:
            safe = self._before_takes(i, self.earliest)
            if safe == i or units[safe + 1][0] - units[safe][1] >= 400:
                return safe
        if length < self.longest:
            return None
        first = max(1, self.earliest)
        best, most = i, -1
        for c in range(first, i + 1):
            safe = self._before_takes(c, first)
            if units[safe + 1][0] - units[safe][1] > most:
                best, most = safe, units[safe + 1][0] - units[safe][1]
        return best

    def _before_takes(self, at: int, least: int) -> int:
        """Back from ``at`` until none of the four before a cut there is a take of one of the four behind it."""
        while at > least:
            behind = self.units[at + 1 : at + 1 + self.AHEAD]
            first = next((b for b in range(max(least, at - self.AHEAD), at + 1) if any(takes.related(self.units[b][2], a[2]) for a in behind)), None)
            if first is None or first <= least:
                break
            at = first - 1
        return at

    def close(self) -> list:
        out = self._cut(True) if self.start is not None else []
        if self.rest + len(self.units):
            out.append((self.rec, self.count + 1, self.start, self.total, self.rest + len(self.units)))
        return out


def chunks(units: DataFrame, target_ms: int = 480_000, pause_ms: int = 2_000, longest_ms: int = 660_000) -> DataFrame:
    """(rec_id, chunk_id, start_ms, end_ms, n_units) of units: rec_id, seg_id, start_ms, end_ms and, if given, text (null and
    none: no takes). A recording ends where its last unit does; one up to longest_ms is one chunk."""
    text = F.col("text") if "text" in units.columns else F.lit("")
    total = F.max("end_ms").over(Window.partitionBy("rec_id"))
    rows = units.select("rec_id", "seg_id", "start_ms", "end_ms", T.norm(text).alias("norm"), T.strip_fillers(text).alias("bare"), total.alias("total_ms"))
    return fold(rows, "rec_id", ["seg_id"], "rec_id long, chunk_id long, start_ms long, end_ms long, n_units long", lambda: Chunks(target_ms, pause_ms, longest_ms))
