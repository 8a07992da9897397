"""Later takes claim what earlier ones say too: a sweep over a recording's spans from the last to the first.

The state is the span that was kept last; the one before it in time loses what both say, as the later take counts, or goes
if it only began the same sentence or too little of it is left. So no two neighbours that are kept say the same words at
their seam. A recording is ordered by one task, which holds two spans of it and sorts its rows on disk if need be; each
pair costs its ends. Times of a cut inside a word are in proportion, or the whole word's where letters and digits of ASCII
stand on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T

from . import takes
from .folds import fold

SCHEMA = "rec_id long, unit_id long, start_ms long, end_ms long, first_char long, n_chars long, role string, splice boolean, cut_head boolean, cut_tail boolean, wall_before long, wall_after long"


class _Span:
    def __init__(self, row) -> None:
        spoken = row.spoken.split(" ") if len(row.starts) else []
        self.row, self.words = row, [(w, int(a), int(b), bool(c)) for w, a, b, c in zip(spoken, row.starts, row.ends, row.closed, strict=True)]
        self.text = "".join(w[0] for w in self.words)
        self.first, self.take = 0, takes.Take(self.text, row.bare if self.text.endswith(row.bare) else self.text)
        self.role, self.splice, self.head, self.tail = row.role or "none", bool(row.splice), bool(row.cut_head), bool(row.cut_tail)
        self.before, self.after = (None if x is None or x != x else int(x) for x in (row.wall_before, row.wall_after))

    def _at(self, place: int, end: bool) -> tuple[int, int]:
        """(word, time) where the character at ``place`` begins, or ends."""
        for i, (w, start, stop, _) in enumerate(self.words):
            if place < len(w):
                k = place + end
                if 0 < k < len(w) and not all(c.isascii() and c.isalnum() for c in w[k - 1 : k + 1]):
                    return i, start + (2 * k * (stop - start) + len(w)) // (2 * len(w))
                return i, stop if end else start
            place -= len(w)
        raise IndexError(place)

    def _slice(self, first: int, last: int) -> tuple[list, int | None, int | None]:
        """Words of the characters first to last; when what goes before them ends, and what goes behind begins."""
        (i, start), (j, stop) = self._at(first, False), self._at(last, True)
        a, b = sum(len(w[0]) for w in self.words[:i]), sum(len(w[0]) for w in self.words[: j + 1])
        gone = start if start > self.words[i][1] else self.words[i - 1][2] if i and first == a else None
        comes = stop if stop < self.words[j][2] else self.words[self._at(last + 1, False)[0]][1] if last + 1 < len(self.text) else None
        out = self.words[i : j + 1]
        if stop < self.words[j][2]:
            w = out[-1]
            out[-1] = (w[0][: len(w[0]) - (b - last - 1)], w[1], stop, w[3])
        if start > self.words[i][1]:
            out[0] = (out[0][0][first - a :], start, *out[0][2:])
        return out, gone, comes

    def drop_stutter(self, n: int) -> None:
        words, gone, _ = self._slice(n, len(self.text) - 1)
        self.words, self.first, self.head = words, n, True
        self.text = "".join(w[0] for w in words)
        self.take = takes.Take(self.text, self.text)
        if gone is not None:
            self.before = gone if self.before is None else max(self.before, gone)

    def keep(self, n: int) -> bool:
        """Keeps the first n characters, if they can stand alone."""
        words, _, comes = self._slice(0, n - 1)
        if not takes.viable([w[0] for w in words], words[-1][2] - words[0][1]):
            return False
        self.words, self.tail = words, True
        self.take = self.take.upto(sum(len(w[0]) for w in words))
        self.text = self.take.norm
        wall = max(words[-1][2], (comes if comes is not None else words[-1][2]) - 1)
        self.after = wall if self.after is None else min(self.after, wall)
        return True

    def out(self) -> list[tuple]:
        r = self.row
        start, end = (self.words[0][1], self.words[-1][2]) if self.words else (r.start_ms, r.end_ms)
        return [(r.rec_id, r.unit_id, start, end, self.first, len(self.text), self.role, self.splice, self.head, self.tail, self.before, self.after)]


class Occluded:
    """Spans from the last to the first."""

    def __init__(self, script: takes.Script, far_ms: int, back_ms: int) -> None:
        self.script, self.far, self.back, self.now = script, far_ms, back_ms, None

    def push(self, row) -> list:
        span, script = _Span(row), self.script
        if self.script or not row.verified:
            n = takes.stutter(span.text, script)
            if 0 < n < len(span.text):
                span.drop_stutter(n)
        if self.now is None:
            self.now = span
            return []
        kept = self._claim(span, self.now)
        out = []
        if kept:
            out, self.now = self.now.out(), span
        return out

    def _claim(self, before: _Span, after: _Span) -> bool:
        """Takes from ``before`` what ``after`` says too; False if it goes as a whole."""
        if not before.text or not after.text:
            return True
        gap = after.words[0][1] - before.words[-1][2]
        if gap > self.far or gap < -self.back:
            return True
        joined = before.role == "prefix" or after.role == "continuation" or after.splice
        siblings = before.row.parent_id is not None and before.row.parent_id == after.row.parent_id
        if before.row.verified and after.row.verified and not joined and not siblings and not self.script:
            return True
        if (self.script or joined or siblings) and not self.script.repeats(before.text[:6]) and takes.opens_again(before.take, after.take):
            after.head = True
            return False
        said = takes.overlap(before.text, after.text, self.script, 4, 3, widen=True)
        if not said or (siblings and not self.script and (before.row.parent_text or "").count(said) > 1):
            return True
        at = before.text.rfind(said, max(0, len(before.text) - takes.REACH - 4))
        if at < 0:
            return True
        after.head = True
        if not at or not before.keep(at):
            return False
        if joined or not before.words[-1][3]:
            before.role, after.role, after.splice = "prefix", "continuation", True
        return True

    def close(self) -> list:
        return self.now.out() if self.now else []


def words_of_unit() -> Column:
    """The words of a unit as ``occlude`` wants them: an aggregate over rows (pos, word, start_ms, end_ms)."""
    w = F.struct("pos", T.norm(F.col("word")).alias("w"), "start_ms", "end_ms", F.col("word").rlike("[。！？!?]$").alias("closes"))
    return F.filter(F.array_sort(F.collect_list(w)), lambda x: x["w"] != "")


def occlude(units: DataFrame, script: Sequence[str] = (), far_ms: int = 25_000, back_ms: int = 500) -> DataFrame:
    """The units that are kept, with what is left of them: SCHEMA. units: rec_id, unit_id, start_ms, end_ms, words (array of
    struct(w, start_ms, end_ms, closes) in order), and, any of them null: parent_id, parent_text, role, splice, verified,
    cut_head, cut_tail, wall_before, wall_after. script: normal forms of its blocks, for a script of bounded size.

    A unit's first_char is where its words begin now, in characters of its normal form, n_chars how many are left. Neighbours
    more than far_ms apart, or overlapping by more than back_ms, do not touch each other; nor do two verified ones
    without a script, unless they are parts of one clip or one is a prefix or continuation. Units of one parent may repeat
    what the parent's text has twice. Units without words stay as they are; ties in time are ordered by unit_id."""
    held = takes.Script(script)
    optional = {"parent_id": "long", "parent_text": "string", "role": "string", "splice": "boolean", "verified": "boolean", "cut_head": "boolean", "cut_tail": "boolean", "wall_before": "long", "wall_after": "long"}
    rows = units.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in units.columns})
    text = F.array_join(F.transform(F.coalesce("words", F.array()), lambda x: x["w"]), "")
    # A text and three arrays of numbers a unit: a struct a word would be a Python object for each of its fields in every batch.
    part = lambda c: F.transform(words, lambda x: x[c])
    words = F.coalesce("words", F.array().cast(units.schema["words"].dataType))
    packed = [F.array_join(part("w"), " ").alias("spoken"), part("start_ms").alias("starts"), part("end_ms").alias("ends"), F.transform(words, lambda x: F.coalesce(x["closes"], F.lit(False)).cast("byte")).alias("closed")]
    flags = {c: F.coalesce(F.col(c).cast(t), F.lit(False)) if t == "boolean" else F.col(c).cast(t) for c, t in optional.items()}
    rows = rows.select("rec_id", "unit_id", "start_ms", "end_ms", *packed, T.strip_fillers(text).alias("bare"), *(v.alias(c) for c, v in flags.items()), (-F.col("start_ms")).alias("_back"), (-F.col("unit_id")).alias("_id"))
    return fold(rows, "rec_id", ["_back", "_id"], SCHEMA, lambda: Occluded(held, far_ms, back_ms))
