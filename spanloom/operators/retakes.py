"""Whether a sentence takes up again what another began. All texts are whole; a null text counts as empty.

Whatever heads and containment settle stays in built-in expressions; only the rest is compared character by character,
in Arrow batches. A pair costs its own texts and no other rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import text as T

from . import takes


def _alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, least in batches:
        yield pd.Series([x is not None and y is not None and takes.alike(x, y, n) for x, y, n in zip(a, b, least, strict=True)], dtype="bool")


def comparer():
    """Whether two columns are at least so alike, as a function: made once for a query, so that Spark sees which comparisons
    are the same."""
    return F.pandas_udf(_alike, "boolean")


def _or_alike(settled: Column, open_: Column, a: Column, b: Column, least: float, compare) -> Column:
    """settled, or a and b at least so alike where ``open_``; settled rows are not compared."""
    ask = ~settled & open_
    return settled | (compare or comparer())(F.when(ask, a), F.when(ask, b), F.lit(least))


def restarts(now: Column, then: Column, least: float = 0.70, head: int = 4, compare=None) -> Column:
    """Whether ``then`` opens as ``now`` does, fillers aside: equal heads, a head within the other's opening, or openings
    of 6 to 14 characters that are alike. Texts of under 3 characters never do."""
    a, b = T.strip_fillers(now), T.strip_fillers(then)
    width = F.least(F.lit(14), F.greatest(F.lit(6), F.length(b)))
    x, y = F.left(a, width), F.left(b, width)
    n = F.least(F.length(x), F.length(y))
    anchor = F.least(F.lit(head), n)
    within = lambda p, q: (F.length(p) >= head) & F.contains(F.left(q, F.lit(head + 3)), F.left(p, F.lit(head)))
    opens = ((anchor >= 3) & (F.left(x, anchor) == F.left(y, anchor))) | within(x, y) | within(y, x)
    long_ = (F.length(a) >= 3) & (F.length(b) >= 3)
    return long_ & _or_alike(opens, long_ & (n >= 4), F.left(x, n), F.left(y, n), least, compare)


def aborted(before: Column, after: Column, least: float = 0.72, compare=None) -> Column:
    """Whether ``before`` is a false start of ``after``: a restart, the same 3 characters with three quarters of the
    length, all but its last character somewhere in it, or alike to its opening."""
    p, n = T.norm(before), T.norm(after)
    size = F.length(p)
    three = (F.left(p, F.lit(3)) == F.left(n, F.lit(3))) & (F.length(n) >= F.floor(size * 3 / 4))
    inside = (size >= 4) & F.contains(n, F.left(p, size - 1))
    long_ = (size >= 3) & (F.length(n) >= 3)
    return restarts(before, after, compare=compare) | (long_ & _or_alike(three | inside, long_ & (size >= 5), p, F.left(n, size + 4), least, compare))


def opens_again(before: Column, after: Column, compare=None) -> Column:
    """Whether ``after`` is a take of ``before`` from its beginning: ``before`` is a false start of it, or 4 characters begin both
    and ``after`` has three quarters of the length or more."""
    p, n = T.norm(before), T.norm(after)
    return aborted(before, after, compare=compare) | ((F.length(p) >= 4) & (F.left(p, F.lit(4)) == F.left(n, F.lit(4))) & (F.length(n) >= F.floor(F.length(p) * 3 / 4)))


def _seams(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([takes.overlap(x or "", y or "", takes.Script()) for x, y in zip(a, b, strict=True)], dtype="str")


def seam(before: Column, after: Column) -> Column:
    """What the end of ``before`` and the start of ``after`` say both (takes.overlap), of normal forms; empty if nothing. Only the
    ends go to Python."""
    return F.pandas_udf(_seams, "string")(F.right(before, F.lit(takes.REACH)), F.left(after, F.lit(takes.REACH)))


def related(a: Column, b: Column, compare=None) -> Column:
    """Whether two sentences are takes of one: either is a false start of the other, or 4 characters begin both."""
    x, y = T.norm(a), T.norm(b)
    return aborted(a, b, compare=compare) | aborted(b, a, compare=compare) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (F.left(x, F.lit(4)) == F.left(y, F.lit(4))))
