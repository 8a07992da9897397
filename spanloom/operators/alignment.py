"""Alignment of clips' transcripts with the timed words of their recordings: seeds, diagonals, extension, times.

A recording's words become one line of characters (their normal form). A transcript's place is the stretch of the line
with the fewest edits (characters put in, left out or replaced); of several the last, as the last take counts, and of
those with one end the one whose length is nearest the transcript's. So an exact text is found where it stands last.

No line is read for every clip. If a stretch differs in e edits or fewer, then of e + 1 pieces of the transcript one
at least stands there unchanged, at most e characters off its diagonal. Pieces are joined with the line's places by
(recording, hash), hits are grouped by clip and band of diagonals, and only the bands' windows are extended, each by a
bit-parallel scan that is linear in the window. So nothing within the bound is missed. A first pass allows one edit in 8
characters, whose pieces are long and rare; what it leaves is looked for again with one edit in 4.

A hit counts only if its whole piece stands there, not just the first characters that are hashed, and a line has hashes only
of the lengths that its clips ask for. Rows that hold text or exploded places are joined by sorting: the planner takes them
for as small as the columns they come from, and would send them through the driver to every task.

Lines are kept in cells of 256 characters, so a window costs a join with the two or three cells that it lies in, and a
task never holds a recording. Numbering a recording's characters is one ordered pass over its narrow rows; it spills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

from .repair import checkpoint

CELL, SEED = 256, 4
#: The longest piece: with one edit in 8 characters, n div (n div 8 + 1) is 7 at most.
PIECE = 7
#: Marks that are taken off where a text is cut.
SEAM = " ，,、；;：:——-\u3000"


def character_line(words: DataFrame) -> DataFrame:
    """words (rec_id, seg_id, pos, word, start_ms, end_ms) with w, the normal form, n, its length, and at, the place of
    its first character in the recording's line. Words without a word character are left out."""
    w = words.select("rec_id", "seg_id", "pos", "start_ms", "end_ms", T.norm(F.col("word")).alias("w")).filter("w <> ''").withColumn("n", F.length("w").cast("long"))
    end = F.sum("n").over(Window.partitionBy("rec_id").orderBy("seg_id", "pos").rowsBetween(Window.unboundedPreceding, 0))
    return w.withColumn("at", end - F.col("n"))


def _in_cells(line: DataFrame) -> DataFrame:
    return line.withColumn("cell", F.explode(F.sequence(F.expr(f"at div {CELL}"), F.expr(f"(at + n - 1) div {CELL}"))))


def cells(line: DataFrame) -> DataFrame:
    """(rec_id, cell, chars): the line in cells of CELL characters."""
    left = F.greatest(F.col("cell") * CELL - F.col("at"), F.lit(0))
    room = CELL - F.greatest(F.col("at") - F.col("cell") * CELL, F.lit(0))
    parts = _in_cells(line).select("rec_id", "cell", F.struct("at", F.substring("w", (left + 1).cast("int"), room.cast("int")).alias("part")).alias("p"))
    one = parts.groupBy("rec_id", "cell").agg(F.array_sort(F.collect_list("p")).alias("p"))  # CELL parts at most
    return one.select("rec_id", "cell", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("chars"))


def _read(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """windows (rec_id, lo, hi and others) with x, the characters of the line from lo to before hi."""
    held = windows.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {CELL}"), F.expr(f"hi div {CELL}"))))
    read = held.join(lines.hint("merge"), ["rec_id", "cell"]).groupBy(*windows.columns).agg(F.array_sort(F.collect_list(F.struct("cell", "chars"))).alias("p"))
    text = F.substring(F.array_join(F.transform("p", lambda x: x["chars"]), ""), (F.col("lo") % CELL + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    return read.select(*windows.columns, text.alias("x"))


def _place(t: str, text: str) -> tuple[int, int, int]:
    """(edits, last, span): the stretch of text with the fewest edits of t, ending at last (inclusive)."""
    scores = _scan(t, text, 0)
    best = min(scores)
    last = len(scores) - 1 - scores[::-1].index(best)
    back = _scan(t[::-1], text[max(0, last + 1 - len(t) - best) : last + 1][::-1], 1)
    spans = [i for i, s in enumerate(back, 1) if s == best]
    return best, last, min(spans, key=lambda k: (abs(k - len(t)), -k)) if spans else 0


def _scan(t: str, text: str, fixed: int) -> list[int]:
    """The least edits between t and the stretches of text that end at each place: of any start, or if ``fixed`` of the
    text's own. A column of the table of edits is two numbers, a bit a character of t (Myers)."""
    size = len(t)
    full, top, has = (1 << size) - 1, 1 << (size - 1), {}
    for i, c in enumerate(t):
        has[c] = has.get(c, 0) | 1 << i
    up, down, score, out = full, 0, size, []
    for c in text:
        eq = has.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(h | up)) & full, up & h
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | fixed) & full, less << 1 & full
        up, down = (less | ~(x | more)) & full, more & x
        out.append(score)
    return out


def _extended(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ts, texts in batches:
        yield pd.DataFrame([_place(t, x) if t and x else (len(t or ""), -1, 0) for t, x in zip(ts, texts, strict=True)], columns=["edits", "last", "span"], dtype="int64")


def _once(f, kind: str):
    """f as a function of columns that a filter or explode behind it does not make Spark work out a second time."""
    return F.pandas_udf(f, kind).asNondeterministic()


def _pass(clips: DataFrame, lines: DataFrame, one_in: int) -> DataFrame:
    """(rec_id, clip_id, n, edits, first_place, last_place) of the clips with one edit in ``one_in`` characters or fewer."""
    c = clips.withColumn("e", F.expr(f"n div {one_in}")).withColumn("step", F.expr("n div (e + 1)"))
    c = c.withColumn("q", F.least("step", F.lit(SEED)).cast("int"))
    piece = lambda i: F.substring("t", (i * F.col("step") + 1).cast("int"), F.col("step").cast("int"))
    seed = lambda i: F.struct((i * F.col("step")).alias("a"), piece(i).alias("piece"))
    asked = c.select("rec_id", "clip_id", "n", "e", "q", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("e")), seed)).alias("s"))
    asked = asked.select("rec_id", "clip_id", "n", "e", "s.a", "s.piece", F.xxhash64("q", F.left("s.piece", F.col("q"))).alias("h"))
    more = F.coalesce(F.left(F.lead("chars").over(Window.partitionBy("rec_id").orderBy("cell")), F.lit(PIECE - 1)), F.lit(""))
    sizes = c.groupBy("rec_id").agg(F.collect_set("q").alias("qs"))
    held = lines.select("rec_id", "cell", F.length("chars").alias("size"), F.concat("chars", more).alias("x")).join(sizes.hint("merge"), "rec_id").withColumn("q", F.explode("qs")).drop("qs")
    held = held.filter(F.length("x") >= F.col("q")).withColumn("i", F.explode(F.sequence(F.lit(1), F.least("size", F.length("x") - F.col("q") + 1))))
    held = held.select("rec_id", (F.col("cell") * CELL + F.col("i") - 1).alias("place"), F.xxhash64("q", F.substring("x", F.col("i"), F.col("q"))).alias("h"), F.substring("x", F.col("i"), F.lit(PIECE)).alias("there"))
    wide = F.greatest("n", F.lit(32))
    band = F.floor((F.col("place") - F.col("a")) / wide)
    bands = asked.join(held.hint("merge"), ["rec_id", "h"]).filter(F.startswith("there", "piece")).select("rec_id", "clip_id", "n", "e", band.alias("band")).distinct()
    lo, hi = F.greatest(F.col("band") * wide - F.col("e"), F.lit(0)), (F.col("band") + 1) * wide + F.col("n") + F.col("e")
    read = _read(bands.select("rec_id", "clip_id", "n", "e", lo.alias("lo"), hi.alias("hi")), lines)
    met = read.join(clips.select("rec_id", "clip_id", "t").hint("merge"), ["rec_id", "clip_id"])
    got = met.select("rec_id", "clip_id", "n", "e", "lo", _once(_extended, "edits long, last long, span long")("t", "x").alias("g"))
    got = got.filter("g.edits <= e").select("rec_id", "clip_id", "n", "g.edits", "g.span", (F.col("lo") + F.col("g.last")).alias("last_place"))
    best = F.max(F.struct((-F.col("edits")).alias("e"), "last_place", (-F.abs(F.col("span") - F.col("n"))).alias("d"), "span")).alias("b")
    found = got.groupBy("rec_id", "clip_id", "n").agg(best)
    return found.select("rec_id", "clip_id", "n", (-F.col("b.e")).alias("edits"), (F.col("b.last_place") - F.col("b.span") + 1).alias("first_place"), "b.last_place")


def _time_in_word(place: Column, after: Column) -> Column:
    """When the character at ``place`` of its word begins (``after`` 0) or ends (1): in a word of letters and digits of
    ASCII there, the word's own start or end, else in proportion."""
    k = place - F.col("at") + after
    inside = (k > 0) & (k < F.col("n")) & ~F.substring("w", k.cast("int"), F.lit(2)).rlike("^[a-z0-9]{2}$")
    part = F.expr("start_ms") + F.floor((2 * k * (F.col("end_ms") - F.col("start_ms")) + F.col("n")) / (2 * F.col("n")))
    return F.when(inside, part).otherwise(F.when(after == 0, F.col("start_ms")).otherwise(F.col("end_ms"))).cast("long")


def align(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Where each clip's transcript stands: rec_id, clip_id, edits, first_seg, first_pos, start_ms, last_seg, last_pos,
    end_ms. clips: rec_id, clip_id, transcript; words: rec_id, seg_id, pos, word, start_ms, end_ms.

    A clip has one row, or none if its transcript has no word character, its recording no word, or no stretch is near
    enough. clip_id is unique in a recording."""
    c = clips.select("rec_id", "clip_id", T.norm(F.col("transcript")).alias("t")).filter("t <> ''").withColumn("n", F.length("t").cast("long"))
    line = character_line(words)
    lines = cells(line)
    near = checkpoint(_pass(c, lines, 8))  # a narrow row a clip, asked for twice
    far = _pass(c.join(near.select("rec_id", "clip_id").hint("merge"), ["rec_id", "clip_id"], "left_anti").filter("n >= 4"), lines, 4)
    found = near.unionByName(far)
    return _timed(found, line, ["rec_id", "clip_id"], "edits")


def _timed(found: DataFrame, line: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """keys, more, and the words and times of first_place and last_place. found is read once: its two places are two rows."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("after"), F.col("first_place").alias("p")), F.struct(F.lit(1).alias("after"), F.col("last_place").alias("p")))).alias("_e")
    asked = found.select(*keys, *more, ends).select(*keys, *more, "_e.after", "_e.p", F.expr(f"_e.p div {CELL}").alias("cell"))
    met = asked.join(_in_cells(line).hint("merge"), ["rec_id", "cell"]).filter("at <= p AND p < at + n")
    at = F.when(F.col("after") == 0, _time_in_word(F.col("p"), F.lit(0))).otherwise(_time_in_word(F.col("p"), F.lit(1)))
    of = lambda after: F.max(F.when(F.col("after") == after, F.struct(F.col("seg_id").alias("seg"), F.col("pos").cast("long").alias("pos"), at.alias("ms"))))
    got = met.groupBy(*keys).agg(*(F.first(m).alias(m) for m in more), of(0).alias("_f"), of(1).alias("_l")).filter("_f IS NOT NULL AND _l IS NOT NULL")
    return got.select(*keys, *more, *(F.col(f"_{k[0]}.{c}").alias(f"{k}_{c}" if c != "ms" else "start_ms" if k == "first" else "end_ms") for k in ("first", "last") for c in ("seg", "pos", "ms")))


def _same(t: str, i: int, x: str, j: int) -> int:
    """How many characters of t from i on stand in x from j on."""
    low, high = 0, min(len(t) - i, len(x) - j)
    while low < high:
        m = (low + high + 1) // 2
        if t[i + low : i + m] == x[j + low : j + m]:
            low = m
        else:
            high = m - 1
    return low


def _codes(text: str, end: int) -> np.ndarray:
    return np.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.uint32(end))


class _Reach:
    """The table of edits of texts that are near, without its cells: how far down each diagonal a cost comes.

    Costs never fall along a diagonal (while skip <= jump + 2), so the cells within a cost are a diagonal's first ones, and those
    within cost c follow from those within c - 1 and, for steps over x, c - jump. Work is the least cost times the diagonals
    that can still end within ``limit``, not the product of the texts. ``least`` is None, and the table is the cheaper way, if after a
    cost of 8 more than one in 4 characters is edited on every diagonal, or if runs of equal characters are very many."""

    def __init__(self, t: str, x: str, skip: int, jump: int):
        n, size = len(t), len(x)
        limit = n // 4 + 8
        self.low, self.least, self.rows = min(n, limit) + 1, None, []
        k = np.arange(-self.low, min(size, size - n + limit) + 2)
        if size - n + limit < 0:
            return
        one, two, ends, calls = _codes(t, 0xFFFFFFFE), _codes(x, 0xFFFFFFFF), np.minimum(n, size - k), 2 * n + 64
        now = np.where(k >= 0, 0, -(1 << 30))
        for cost in range(limit + 1):
            if cost:
                last = self.rows[-1]
                now = last + 1
                now[1:] = np.maximum(now[1:], last[:-1])
                now[:-1] = np.maximum(now[:-1], last[1:] + 1)
                if cost >= jump and len(k) > skip:
                    now[skip:] = np.maximum(now[skip:], np.maximum.accumulate(self.rows[-jump])[:-skip])
            now = np.minimum(now, ends)
            on = np.flatnonzero(now >= 0)
            for _ in range(4):
                on = on[one[now[on]] == two[now[on] + k[on]]]
                now[on] += 1
            calls -= len(on)
            if calls < 0:
                return
            for d in on.tolist():
                i = int(now[d])
                now[d] = i + _same(t, i, x, i + int(k[d]))
            self.rows.append(now)
            if (there := np.flatnonzero(now >= n)).size:
                self.least, self.end = cost, n + int(k[there[-1]])
                return
            if 4 * (cost - 8) > now.max():
                return

    def within(self, i: int, j: int, cost: int) -> bool:
        return cost >= 0 and self.rows[cost][j - i + self.low] >= i

    def before(self, i: int, j: int, cost: int) -> int:
        """The last place up to j of row i that is within cost."""
        first = max(0, i - self.low)
        return first + int(np.flatnonzero(self.rows[cost][first - i + self.low : j - i + self.low + 1] >= i)[-1])


class _Table:
    """The whole table of edits, for any texts."""

    def __init__(self, t: str, x: str, skip: int, jump: int):
        n, size = len(t), len(x)
        kind = "int16" if n + size < 32_000 else "int32"
        codes, place = _codes(x, 0)[:-1], np.arange(size + 1, dtype=kind)
        self.cells = np.zeros((n + 1, size + 1), kind)
        for i, c in enumerate(_codes(t, 0)[:-1], 1):
            row = self.cells[i - 1] + 1
            np.minimum(row[1:], self.cells[i - 1, :-1] + (codes != c), out=row[1:])
            row = np.minimum.accumulate(row - place) + place
            if size >= skip:
                np.minimum(row[skip:], np.minimum.accumulate(row[:-skip]) + jump, out=row[skip:])
            self.cells[i] = row
        self.least, self.end = int(self.cells[n].min()), int(size - self.cells[n][::-1].argmin())

    def within(self, i: int, j: int, cost: int) -> bool:
        return self.cells[i, j] <= cost

    def before(self, i: int, j: int, cost: int) -> int:
        return int(np.flatnonzero(self.cells[i, : j + 1] <= cost)[-1])


def _parts(t: str, x: str, skip: int = 3, jump: int = 2, most: float = 0.15) -> list[tuple[int, int, int, int]]:
    """(from, to, first, last): stretches t[from:to] of t with their places in x, in order; [] if t is not near.

    By the table of edits, where a step over ``skip`` or more characters of x costs ``jump``. Read back from the last
    end of least cost, steps over x are put off as long as they may be, so a phrase said twice belongs to its last take."""
    if not x or not t:
        return []
    costs: _Reach | _Table = _Reach(t, x, skip, jump)
    if costs.least is None:
        costs = _Table(t, x, skip, jump)
    i, j, here = len(t), costs.end, costs.least
    out, to, last, jumps = [], i, j - 1, 0
    while i:
        if j and t[i - 1] == x[j - 1]:  # equal characters never cost more than another step
            i, j = i - 1, j - 1
        elif j and costs.within(i - 1, j - 1, here - 1):
            i, j, here = i - 1, j - 1, here - 1
        elif costs.within(i - 1, j, here - 1):
            i, here = i - 1, here - 1
        elif j and costs.within(i, j - 1, here - 1):
            j, here = j - 1, here - 1
        else:
            out.append((i, to, j, last))
            j, here = costs.before(i, j - skip, here - jump), here - jump
            to, last, jumps = i, j - 1, jumps + 1
    out.append((0, to, j, last))
    return out[::-1] if costs.least - jump * jumps <= most * len(t) and all(b >= a for _, _, a, b in out) else []


def _excised(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ts, texts in batches:
        yield pd.Series([[dict(zip(("part", "from", "to", "first", "last"), (k, *p), strict=True)) for k, p in enumerate(_parts(t, x or ""))] for t, x in zip(ts, texts, strict=True)])


def excise(clips: DataFrame, words: DataFrame) -> DataFrame:
    """The parts of each clip's sentences that its transcript keeps, without the stumbles that it leaves out: rec_id,
    clip_id, part (from 0), n_parts, transcript (the part's), first_seg, first_pos, start_ms, last_seg, last_pos, end_ms.
    clips: rec_id, clip_id, first_seg, last_seg, transcript.

    Parts follow each other, three characters or more apart. One that cannot stand alone (too short in characters, words
    or time) goes, unless it is the last. A clip whose sentences are not near its transcript keeps them whole, as one part;
    so does one without word characters. A clip without words has no row. A transcript that is near costs its edits times
    its length; one that is not, the product of it and its own sentences; nothing else is read."""
    keys = ["rec_id", "clip_id"]
    line = character_line(words)
    sentences = line.groupBy("rec_id", "seg_id").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("n")).alias("hi"))
    mine = clips.filter("first_seg <= last_seg").select(*keys, F.explode(F.sequence("first_seg", "last_seg")).alias("seg_id")).join(sentences.hint("merge"), ["rec_id", "seg_id"])
    stretch = _read(mine.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), cells(line))
    both = stretch.join(clips.select(*keys, T.text_of(F.col("transcript")).alias("raw"), T.norm(F.col("transcript")).alias("t")).hint("merge"), keys)
    kind = "array<struct<part:long,`from`:int,`to`:int,first:long,last:long>>"
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("from"), F.length("t").alias("to"), F.lit(0).alias("first"), (F.length("x") - 1).alias("last"))).cast(kind)
    got = both.withColumn("p", _once(_excised, kind)("t", "x")).withColumn("p", F.when(F.size("p") > 0, F.col("p")).otherwise(whole))
    rows = got.select(*keys, "lo", "raw", F.size("p").alias("of"), F.explode("p").alias("p"))
    before = F.when(F.col("p.from") > 0, T.norm_cut(F.col("raw"), F.col("p.from"))).otherwise("")
    said = F.substring(T.norm_cut(F.col("raw"), F.col("p.to")), F.length(before) + 1, F.length("raw"))
    rows = rows.select(*keys, F.col("p.part").alias("part"), F.when(F.col("of") == 1, F.col("raw")).otherwise(F.trim(said, F.lit(SEAM))).alias("transcript"), (F.col("p.part") == F.col("of") - 1).alias("final"), (F.col("lo") + F.col("p.first")).alias("first_place"), (F.col("lo") + F.col("p.last")).alias("last_place"))
    timed = _timed(rows, line, [*keys, "part"], "transcript", "final")
    kept = timed.filter(F.col("final") | T.is_viable(F.col("transcript"), (F.col("end_ms") - F.col("start_ms")) / 1000)).drop("final")
    w = Window.partitionBy(*keys)
    return kept.withColumns({"n_parts": F.count("*").over(w), "part": F.row_number().over(w.orderBy("part")).cast("long") - 1})
