"""Occurrences of many short phrases in texts, with substitutions, by exact parts.

A phrase may differ from a place of the text in none of its characters below 5, in one below 10, else in two. Cut into
one part more than that, one part at least is met as it stands: the places of all parts are looked up at once, and each
is compared in full, so none is missed. Of places that overlap the leftmost counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Characters that are looked at together; a longer text is looked at alone.
CHUNK = 1_000_000


def most_differing(n: int) -> int:
    return 0 if n < 5 else 1 if n < 10 else 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Finder:
    def __init__(self, phrases: list[str]) -> None:
        self.phrases = [p for p in phrases if p]
        codes = [_codes(p) for p in self.phrases]
        self.chars = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes]))
        self.size = np.array([len(c) for c in codes], np.int64)
        parts = defaultdict(lambda: defaultdict(list))
        self.letters = np.zeros((len(codes), max(self.size, default=0)), np.int64)
        for k, c in enumerate(codes):
            self.letters[k, : len(c)] = ids = self._ids(c)
            edges = np.linspace(0, len(c), most_differing(len(c)) + 2).astype(int)
            for a, b in zip(edges, edges[1:], strict=False):
                parts[int(b - a)][int(self._grams(ids, b - a)[a])].append((k, a))
        self.parts = []  # (length, codes in order, first use of each, number of uses, phrases, offsets)
        for n, uses in parts.items():
            known = sorted(uses)
            count = np.array([len(uses[g]) for g in known])
            flat = np.array([u for g in known for u in uses[g]])
            self.parts.append((n, np.array(known, np.int64), np.cumsum(count) - count, count, flat[:, 0], flat[:, 1]))

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        """1 and up for the phrases' characters, 0 for all others."""
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, 0).astype(np.int64)

    def _grams(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for the n characters from each place on; equal ones have equal numbers."""
        out = ids[: len(ids) - n + 1].copy()
        for i in range(1, n):
            out = out * (len(self.chars) + 1) + ids[i : len(ids) - n + 1 + i]
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, phrase, found) by their numbers, without those not found."""
        if not self.phrases or not texts:
            return []
        codes = [_codes(t) for t in texts]
        ends = np.cumsum([len(c) for c in codes])
        ids, total = self._ids(np.concatenate(codes)), int(ends[-1])
        keys = [np.zeros(0, np.int64)]
        for n, known, first, uses, phrase, offset in self.parts:
            if total < n:
                continue
            grams = self._grams(ids, n)
            which = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            met = np.flatnonzero(known[which] == grams)
            which = which[met]
            for i in range(0, len(met), 200_000):
                w, m = which[i : i + 200_000], met[i : i + 200_000]
                reps = uses[w]
                use = np.repeat(first[w] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
                k, start = phrase[use], np.repeat(m, reps) - offset[use]
                fits = (start >= 0) & (start < total)
                k, start = k[fits], start[fits]
                fits = start + self.size[k] <= ends[np.searchsorted(ends, start, "right")]
                k, start = k[fits], start[fits]
                for size in np.unique(self.size[k]):
                    some = self.size[k] == size
                    kk, ss = k[some], start[some]
                    differ = np.zeros(len(kk), np.int8)
                    for j in range(size):
                        differ += ids[ss + j] != self.letters[kk, j]
                    right = differ <= most_differing(int(size))
                    keys.append(kk[right] * total + ss[right])
        key = np.unique(np.concatenate(keys))
        k, start = np.divmod(key, total)
        text = np.searchsorted(ends, start, "right")
        found, last, free = defaultdict(int), None, 0
        for kk, tt, ss, n in zip(k.tolist(), text.tolist(), start.tolist(), self.size[k].tolist(), strict=True):
            if (kk, tt) != last:
                last, free = (kk, tt), 0
            if ss >= free:
                found[tt, kk] += 1
                free = ss + n
        return [(t, p, n) for (t, p), n in found.items()]


def occurrences(texts: DataFrame, id_: str, text: str, phrases: list[str]) -> DataFrame:
    """(id_, phrase, found) for each row of texts and each phrase that it holds. Every text is read whole, in place; the
    phrases are on the driver and go to every task."""
    df = texts.select(id_, text)
    kept = sorted(set(phrases))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(kept)
        for b in batches:
            some = [t or "" for t in b[text]]
            length = np.cumsum([len(t) for t in some])
            at = 0
            while at < len(some):
                end = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + CHUNK, "right")))
                rows = finder.count(some[at:end])
                yield pd.DataFrame({id_: b[id_].iloc[[at + t for t, _, _ in rows]].to_numpy(), "phrase": [finder.phrases[p] for _, p, _ in rows], "found": np.array([n for _, _, n in rows], "int64")})
                at = end

    return df.mapInPandas(counted, f"`{id_}` {df.schema[id_].dataType.simpleString()}, phrase string, found long")
