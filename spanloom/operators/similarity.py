"""Alignment of a script's blocks with spoken text: coverage of a block, and each text's best block of a whole script.

The best block is exact: every block is weighed by upper bounds first, and only blocks whose bounds reach the least
coverage that counts and the best one found so far are aligned. Matched runs have k characters at least (2 with ideographs,
else 3), so all that is matched lies in k-grams of both: that bound comes for all blocks of a few hundred at once, by a few
array operations, for either side. Of blocks that pass, the longest common subsequence of the characters in common k-grams is
no less either; it comes for thousands of pairs of a text and a block at once, a bit a character of the block. What is left is
weighed by the longest chain of such runs in order, over the places of equal k-grams only, before it is aligned. Texts stay where they are read; blocks are a stated set that goes to all tasks in groups of bounded size, a pass over the texts each."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _covered(block: str, text: str) -> float:
    """Share of block's characters matched in order by text, in runs of 2 characters at least if block has an ideograph, else 3.

    A text of up to twice block's length is aligned whole. Of a longer one the best window counts: at each stride, at
    the end, and around the longest match; the first at a stride with 0.95 or more settles it."""
    if not block or not text:
        return 0.0
    if block in text:
        return 1.0
    size, least = len(block), 2 if any("\u4e00" <= c <= "\u9fff" for c in block) else 3

    def aligned(part: str) -> float:
        return sum(p.size for p in SequenceMatcher(None, block, part, autojunk=False).get_matching_blocks() if p.size >= least) / size

    if len(text) <= 2 * size:
        return aligned(text)
    width, best = min(len(text), max(size + 24, int(size * 1.8))), 0.0
    for at in range(0, max(1, len(text) - width + 1), max(4, size // 3)):
        best = max(best, aligned(text[at : at + width]))
        if best >= 0.95:
            return best
    best = max(best, aligned(text[len(text) - width :]))
    longest = SequenceMatcher(None, block, text, autojunk=False).find_longest_match()
    if longest.size >= least:
        at = max(0, longest.b - longest.a - 12)
        best = max(best, aligned(text[at : at + width]))
    return best


def _coverage_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for block, text in batches:
        yield pd.Series([_covered(a or "", b or "") for a, b in zip(block, text, strict=True)], dtype="float64")


def coverage(block: Column, text: Column) -> Column:
    """Coverage of block by text, 0 to 1. Containment is settled by a built-in; the rest is aligned."""
    return F.when(F.length(block) == 0, 0.0).when(F.contains(text, block), 1.0).otherwise(F.pandas_udf(_coverage_of, "double")(block, text))


#: Bits of a word that hold characters; the one above takes the carry. Blocks of more words are weighed by an integer each.
BITS, WORDS = 63, 16
#: So many rows of pairs wait to be weighed together, and so many pairs are weighed at a time.
HELD, TOGETHER = 24_000_000, 4_096
#: After so many steps at a time, pairs that cannot come to their need are left.
LOOK = 12


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _count(met: np.ndarray) -> np.ndarray:
    return np.add.reduce(met.view("uint8"), axis=1, dtype="uint16" if met.shape[1] < 1 << 16 else "int64").astype("int64")


def _bits(n: int, words: int, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """n rows of bits with those at (row, place)."""
    bits = np.zeros((n, words), dtype="uint64")
    np.bitwise_or.at(bits, (rows, places // BITS), np.uint64(1) << (places % BITS).astype("uint64"))
    return bits


def _common(places: list[np.ndarray], rows: np.ndarray, first: np.ndarray, counts: np.ndarray, needs: np.ndarray, words: int) -> np.ndarray:
    """For each pair the longest common subsequence, a bit a character of its block; pairs with more steps come first. A pair that
    cannot come to its need any more is left, with no less than it could have come to."""
    full, top = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    most, left = np.zeros(len(first), dtype="int64"), np.arange(len(first))
    state = np.full((words, len(first)), full, dtype="uint64")
    met, one, carry = np.empty_like(state), np.empty_like(state), np.empty(len(first), dtype="uint64")
    last = [np.zeros(len(first), dtype="int64") for _ in places]
    here, more = (np.empty((len(first), words), dtype="uint64") for _ in range(2))
    steps = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left").tolist()  # how many pairs have each step
    for step in range(len(steps)):
        if step and step % LOOK == 0:
            come = words * BITS - np.bitwise_count(state).sum(axis=0, dtype="int64") + np.maximum(counts - step, 0)
            open_ = (come >= needs) & (counts > step)
            if 8 * np.count_nonzero(open_) < 7 * len(left):
                most[left] = come
                last = [r[open_[: len(r)]] for r in last]
                left, first, counts, needs, state = left[open_], first[open_], counts[open_], needs[open_], state[:, open_]
                steps[step:] = np.searchsorted(-counts, -np.arange(step, len(steps)), side="left").tolist()
        m = steps[step]
        if not m:
            break
        s, v, o, c = state[:, :m], met[:, :m], one[:, :m], carry[:m]
        last = [rows.take(first[:m] + step).astype("int64"), *last[:-1]]  # before the first step there is none
        places[0].take(last[0], axis=0, out=here[:m], mode="clip")
        for p, r in zip(places[1:], last[1:], strict=True):
            p.take(r[:m], axis=0, out=more[:m], mode="clip")
            np.bitwise_or(here[:m], more[:m], out=here[:m])
        np.bitwise_and(here[:m].T, s, out=v)
        np.add(s, v, out=o)
        for w in range(1, words):
            np.right_shift(o[w - 1], top, out=c)
            np.add(o[w], c, out=o[w])
        np.bitwise_xor(s, v, out=s)
        np.bitwise_or(s, o, out=s)
        np.bitwise_and(s, full, out=s)
    most[left] = words * BITS - np.bitwise_count(state).sum(axis=0, dtype="int64") + np.maximum(counts - len(steps), 0)
    return most


class Blocks:
    """Blocks of one k, a few hundred at most, that are weighed together."""

    def __init__(self, blocks: Sequence[tuple[int, str]], k: int) -> None:
        self.k, self.blocks = k, sorted(blocks, key=lambda b: len(b[1]))
        self.sizes = np.array([len(t) for _, t in self.blocks])
        self.starts = np.concatenate([[0], np.cumsum(-(-self.sizes // 8) * 8)])  # each block begins at a whole word of 8 bytes
        codes = _codes("".join(t for _, t in self.blocks))
        letters = np.unique(codes)
        self.base = len(letters) + 1  # the last one is any letter that no block has
        self.letter = np.full(int(letters[-1]) + 2, len(letters), dtype="int64")
        self.letter[letters] = np.arange(len(letters))
        owner = np.repeat(np.arange(len(self.blocks)), self.sizes)
        place = np.arange(len(codes)) - (np.cumsum(self.sizes) - self.sizes)[owner]
        begins = np.flatnonzero(place + k <= self.sizes[owner])
        keys = self._keys(codes)[begins]
        self.keys, grams = np.unique(keys, return_inverse=True)
        self.none = len(self.keys)
        self.at = np.full(int(self.starts[-1]), -1, dtype="int64")  # the gram that begins at each character; -1, which no text has, at a block's end
        self.at[self.starts[owner[begins]] + place[begins]] = grams
        self.met = np.zeros(self.none + 1, dtype=bool)
        self.rank = None
        if self.base**k <= 1 << 20:
            self.rank = np.full(self.base**k, self.none, dtype="int64")
            self.rank[self.keys] = np.arange(self.none)
        self.words = -(-self.sizes // BITS)
        small = "uint16" if len(begins) < 1 << 16 else "int32"
        self.row = np.zeros((self.none + 1, len(self.blocks)), dtype=small)  # from 1, within blocks of as many words: where the gram stands in the block
        self.places: dict[int, list[np.ndarray]] = {}
        for words in np.unique(self.words).tolist():
            here = self.words[owner[begins]] == words
            pairs, rows = np.unique(grams[here] * len(self.blocks) + owner[begins][here], return_inverse=True)
            self.row.ravel()[pairs] = np.arange(1, len(pairs) + 1)
            if words <= WORDS:
                self.places[words] = [_bits(len(pairs) + 1, words, rows + 1, place[begins][here] + by) for by in range(k)]

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        """A number for the k characters from each one on, as long as there are k."""
        n, letters = max(0, len(codes) - self.k + 1), self.letter[np.minimum(codes, len(self.letter) - 1)]
        keys = letters[:n]
        for i in range(1, self.k):
            keys = keys * self.base + letters[i : i + n]
        return keys

    def _grams(self, text: str) -> np.ndarray:
        keys = self._keys(_codes(text))
        if self.rank is not None:
            return self.rank[keys]
        if not self.none:
            return np.zeros(len(keys), dtype="int64")
        found = np.minimum(np.searchsorted(self.keys, keys), self.none - 1)
        return np.where(self.keys[found] == keys, found, self.none)

    def bounds(self, text: str) -> np.ndarray:
        """For each block, no less than the characters of it that text can match in order."""
        return self._inside(self._grams(text), 0, len(self.blocks))

    def _inside(self, grams: np.ndarray, low: int, high: int) -> np.ndarray:
        """For the blocks from low to before high, how many characters lie in k-grams that the text has anywhere."""
        self.met[grams] = True
        self.met[-1] = False
        begins = self.met.take(self.at[self.starts[low] : self.starts[high]], mode="wrap")
        self.met[grams] = False
        inside = begins.copy()
        for i in range(1, self.k):
            inside[i:] |= begins[:-i]  # no gram begins in a block's last k - 1 characters, so none reaches into the next
        most = np.add.reduceat(np.bitwise_count(inside.view("uint64")), (self.starts[low:high] - self.starts[low]) // 8, dtype="int64")
        return np.where(self.sizes[low:high] < self.k, self.sizes[low:high], most)  # these can only stand there whole

    def _rows(self, which: np.ndarray, grams: np.ndarray) -> np.ndarray:
        if len(grams) * len(self.blocks) > HELD:
            return np.ascontiguousarray(self.row[grams[:, None], which[None, :]].T)
        return np.ascontiguousarray(self.row.take(grams, axis=0)[:, which].T)  # whole rows are copied faster than picked from

    def _follow(self, which: np.ndarray, rows: np.ndarray, counts: np.ndarray, needs: np.ndarray) -> np.ndarray:
        """For each pair of a text and a block of ``which``, no less than the longest common subsequence of the block and the text's
        characters in common k-grams, ``rows``, and just that if it comes to its need. A character goes with the places of the block
        that its own k-gram and those that begin up to k - 1 before it give it; behind each stretch k - 1 characters begin none."""
        first, most = np.cumsum(counts) - counts, np.zeros(len(which), dtype="int64")
        for words, places in self.places.items():
            mine = np.flatnonzero(self.words[which] == words)
            mine = mine[np.argsort(-counts[mine], kind="stable")]
            for low in range(0, len(mine), TOGETHER):
                some = mine[low : low + TOGETHER]
                most[some] = _common(places, rows, first[some], counts[some], needs[some], words)
        return most

    def _follow_long(self, i: int, grams: np.ndarray) -> int:
        """The same for a block of many words, by one integer."""
        where, full, bits = self._where(i), (1 << int(self.sizes[i])) - 1, {}
        row, last = full, [0] * self.k
        for g in [*grams.tolist(), *[self.none] * (self.k - 1)]:
            if g in where and g not in bits:
                bits[g] = sum(1 << place for place in where[g])
            last = [bits.get(g, 0), *(b << 1 for b in last[:-1])]
            met = 0
            for b in last:
                met |= b
            if met:
                met &= row
                row = (row + met | row - met) & full
        return int(self.sizes[i]) - row.bit_count()

    def _where(self, i: int) -> dict[int, list[int]]:
        """The places in block i of each gram that it has."""
        where: dict[int, list[int]] = {}
        for place, g in enumerate(self.at[self.starts[i] : self.starts[i] + self.sizes[i]].tolist()):
            if g >= 0:
                where.setdefault(g, []).append(place)
        return where

    def in_order(self, grams: list[int], i: int) -> int:
        """The most characters of block i that runs of k or more, in order in both, can match."""
        k, size = self.k, int(self.sizes[i])
        if size < k:
            return size
        where = self._where(i)
        ends = [0] + [size + k] * len(grams) + [size + k] * k  # by length: where in the block the earliest chain of that length ends
        pairs: list[tuple[int, int, int]] = []
        before: dict[int, int] = {}
        done = most = col_before = 0
        for col, g in enumerate(grams):
            rows = where.get(g)
            if not rows:
                continue
            while done < len(pairs) and pairs[done][0] + k <= col:
                _, end, n = pairs[done]
                while ends[n] > end:
                    ends[n], n = end, n - 1
                done += 1
            if col_before + 1 != col:
                before = {}
            now = {}
            for row in rows:
                n = bisect_right(ends, row) - 1 + k
                longer = before.get(row - 1, -1) + 1
                now[row] = n = longer if longer > n else n
                pairs.append((col, row + k, n))
                most = n if n > most else most
            before, col_before = now, col
        return min(most, size)

    def best(self, text: str, least: float, longest: float, found: tuple[float, int] | None) -> tuple[float, int] | None:
        """(coverage, block), or what was found if none here is better. Equal ones go to the least block."""
        return self.best_of([text], least, longest, [found])[0]

    def best_of(self, texts: Sequence[str], least: float, longest: float, found: Sequence[tuple[float, int] | None]) -> list[tuple[float, int] | None]:
        """The same for each text; pairs of a text and a block wait until there are many, and are weighed together."""
        found = list(found)
        waiting, lengths, reached = _Waiting(), self.sizes.tolist(), (self.sizes * least).tolist()
        for n, text in enumerate(texts):
            low = bisect_left(lengths, len(text) / longest)
            high = bisect_right(reached, len(text), low)
            if high == low or not text:
                continue
            grams, need = self._grams(text), max(least, found[n][0]) if found[n] else least
            share = self._inside(grams, low, high) / self.sizes[low:high]
            near = (share >= need).nonzero()[0]
            if not len(near):
                continue
            through = np.concatenate([grams, np.full(self.k - 1, self.none)])  # to the text's last character
            at_once = max(1, HELD // len(through))
            for at in range(0, len(near), at_once):
                some = near[at : at + at_once]
                which = some + low
                rows = self._rows(which, through)
                met = rows > 0
                said = met.copy()
                for i in range(1, self.k):
                    said[:, i:] |= met[:, :-i]
                counts = _count(said)
                most = np.minimum(share[some], np.where(self.sizes[which] < self.k, self.sizes[which], counts) / self.sizes[which])
                keep = (most >= need).nonzero()[0]
                if len(keep):
                    if len(keep) < len(some):
                        rows, said = rows[keep], said[keep]
                    waiting.add(n, grams, which[keep], most[keep], counts[keep], rows.ravel().take(said.ravel().nonzero()[0]))
                    if waiting.held >= HELD:
                        self._settle(texts, waiting, least, longest, found)
        self._settle(texts, waiting, least, longest, found)
        return found

    def _settle(self, texts: Sequence[str], waiting: _Waiting, least: float, longest: float, found: list[tuple[float, int] | None]) -> None:
        """Weighs what is waiting by the longest common subsequence of the characters in common k-grams, and aligns what is left."""
        for n, grams, which, share in self._weighed(waiting, least, found):
            order = grams.tolist()
            for i in np.flatnonzero(self.words[which] > WORDS).tolist():
                share[i] = min(share[i], self._follow_long(int(which[i]), grams) / self.sizes[which[i]])
            for i in np.argsort(-share, kind="stable").tolist():
                need = max(least, found[n][0]) if found[n] else least
                if share[i] < need:
                    break
                block_id, block = self.blocks[which[i]]
                if self.in_order(order, int(which[i])) / len(block) < need:
                    continue
                got = _covered(block, texts[n])
                if len(texts[n]) <= len(block) * longest and got >= least and (not found[n] or (got, -block_id) > (found[n][0], -found[n][1])):
                    found[n] = got, block_id

    def _weighed(self, waiting: _Waiting, least: float, found: list[tuple[float, int] | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """What is waiting and not ruled out, with its bounds."""
        of, which, share, counts, rows = waiting.taken()
        if not of:
            return
        need = np.repeat([max(least, found[n][0]) if found[n] else least for n, _, _ in of], [len(w) for _, _, w in of])
        sizes = self.sizes[which]
        most = self._follow(which, rows, counts, need * sizes - 1e-6)
        share = np.where((sizes >= self.k) & (self.words[which] <= WORDS), np.minimum(share, most / sizes), share)
        good = share >= need
        ends = np.cumsum([len(w) for _, _, w in of])
        for i in np.flatnonzero(np.logical_or.reduceat(good, np.concatenate([[0], ends[:-1]]))).tolist():
            n, grams, w = of[i]
            at = int(ends[i]) - len(w)
            keep = np.flatnonzero(good[at : at + len(w)])
            yield n, grams, w[keep], share[at + keep]


class _Waiting:
    """Pairs of texts and blocks that are to be weighed together: of a text its blocks, their bounds, steps and rows."""

    def __init__(self) -> None:
        self.of, self.share, self.counts, self.rows, self.held = [], [], [], [], 0

    def add(self, n: int, grams: np.ndarray, which: np.ndarray, share: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> None:
        self.of.append((n, grams, which))
        self.share.append(share)
        self.counts.append(counts)
        self.rows.append(rows)
        self.held += len(grams) + len(which) + len(rows)

    def taken(self) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All of them, which wait no longer."""
        of, share, counts, rows = self.of, self.share, self.counts, self.rows
        self.__init__()
        if not of:
            return [], *[np.zeros(0)] * 4
        return of, np.concatenate([w for _, _, w in of]), np.concatenate(share), np.concatenate(counts), np.concatenate(rows)


def best_block(texts: DataFrame, blocks: DataFrame, least: float = 0.45, longest: float = 1.85, group_chars: int = 4_000_000, together: int = 256) -> DataFrame:
    """texts, which have norm, with block_id and coverage of the block of which norm covers most, ``least`` or more; null if
    there is none. Of equal ones the least block_id. A text longer than ``longest`` times a block is no take of it.
    blocks: block_id, norm, a stated set: group_chars characters of it at a time go to all tasks, in a pass of their own.
    Null texts have no block; empty and null blocks are nobody's."""
    if not 0 < longest <= 2:
        raise ValueError("longest: above 0, 2 at most")  # beyond, windows of the text would have to be weighed
    spark = texts.sparkSession
    given = blocks.filter(F.length("norm") > 0).select("block_id", "norm")
    passes = (given.agg(F.sum(F.length("norm"))).first()[0] or 0) // group_chars + 1
    out = texts.withColumns({"_best": F.lit(None).cast("struct<coverage:double,block_id:long>")})
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in texts.schema)}, _best struct<coverage:double,block_id:long>"
    for p in range(passes):
        rows = [tuple(r) for r in given.filter(F.pmod(F.xxhash64("block_id", F.lit(7)), F.lit(passes)) == p).collect()]
        held = spark.sparkContext.broadcast(rows)

        def weigh(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sets = []
            for k in (2, 3):
                mine = sorted((b for b in held.value if k == (2 if any("\u4e00" <= c <= "\u9fff" for c in b[1]) else 3)), key=lambda b: len(b[1]))
                sets += [Blocks(mine[i : i + together], k) for i in range(0, len(mine), together)]
            for b in batches:
                at, had = b.schema.get_field_index("_best"), b.column("_best")
                best = [None] * len(b) if had.null_count == len(b) else [(h["coverage"], h["block_id"]) if h is not None else None for h in had.to_pylist()]
                texts = [text or "" for text in b.column("norm").to_pylist()]
                for s in sets:
                    best = s.best_of(texts, least, longest, best)
                best = pa.array([None if found is None else {"coverage": float(found[0]), "block_id": int(found[1])} for found in best], had.type)
                yield pa.RecordBatch.from_arrays([best if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

        if rows:
            out = out.mapInArrow(weigh, schema)
    return out.select(*texts.columns, F.col("_best.block_id").alias("block_id"), F.col("_best.coverage").alias("coverage"))
