"""Best-fit packing: ids against whole-text encoding, the plan against packing one by one, and difficult rows."""

import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import packing, sstable

from .edge import ROWS, docs, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def best_fit(lengths, size):
    """Sequences of best-fit-decreasing, a piece at a time."""
    spaces, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(spaces, x)
        if at < len(spaces):
            left = spaces.pop(at) - x
        else:
            left, n = size - x, n + 1
        bisect.insort(spaces, left)
    return n


def test_plan_equals_packing_one_by_one():
    rng = random.Random(1)
    for k in range(300):
        size = rng.choice([1, 2, 7, 20, 64])
        counts = {x: rng.choice([1, 2, 3, 10, 1000]) for x in rng.sample(range(1, size + 1), rng.randint(1, min(size, 12)))}
        bins, placed = {}, 0
        for length, low, high, first, per, at in packing.plan(counts, size):
            for r in range(high - low):
                bins.setdefault(first + r // per, []).append((at + r % per * length, length))
            placed += high - low
        assert placed == sum(counts.values()) and len(bins) == best_fit([x for x, n in counts.items() for _ in range(n)], size), (k, counts)
        for parts in bins.values():
            ends = 0
            for at, length in sorted(parts):
                assert at == ends
                ends += length
            assert ends <= size


def test_plan_does_not_grow_with_counts():
    rng = random.Random(2)
    sizes = [len(packing.plan({x: rng.randint(1, most) for x in range(1, 4097)}, 4096)) for most in (10**3, 10**6, 10**9)]
    assert max(sizes) < 40_000


def check(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = 0
        for at, length in sorted(parts):
            assert at == ends
            ends += length
        assert ends <= size
    assert len(by) == best_fit([r["length"] for r in rows], size)


def test_query_against_whole_texts(spark, whole):
    rows = packing.op11_best_fit_packing(spark, SF).collect()
    check(rows, 4096)
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)


def test_pieces_equal_whole_text_encoding(whole):
    rng, encoder = random.Random(3), packing.Encoder(packing.default_tokenizer())
    assert encoder.by_piece
    signs = ["a", "B", " ", " ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "'s", "'LL", "don't", "12", "½", "²", "!", "...", "é", "É", "é", "ß", "ªº", "µ", "×", "漢字", "ΟΔΟΣ", "İ", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "_", "«b»", "word", "naïve-x", "Ⅷ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizer(spark):
    some = spark.createDataFrame([(1, "a  b\n"), (2, None)], "doc_id long, text string")
    path = sstable.default_tokenizer()
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(path).encode("a  b\n", add_special_tokens=False).ids)
    assert sorted((r["doc_id"], r["length"]) for r in packing.pack(some, tokenizer=path).collect()) == [(1, n + 1), (2, 1)]


def test_difficult_rows(spark, whole):
    rows = packing.pack(docs(spark), size=16, ids=True).collect()
    check(rows, 16)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(of) == len({r[0] for r in ROWS}) and [r["length"] for r in of[2]] == [1] == [r["length"] for r in of[3]] == [r["length"] for r in of[4]]
    long = sorted(of[5], key=lambda r: r["piece"])
    ids = np.frombuffer(b"".join(r["ids"] for r in long), "<u4").tolist()
    assert ids == [*whole.encode(ROWS[4][1], add_special_tokens=False).ids, 1] and [r["start"] for r in long] == list(range(0, len(ids), 16))
    assert len(of[6]) == 2 * len(of[1])
    assert packing.pack(empty(spark)).count() == 0


def test_sequences_hold_the_pieces(spark):
    packed = packing.pack(docs(spark), size=64, ids=True)
    pieces = {(r["sequence_id"], r["offset"]): r["ids"] for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert r["ids"] == b"".join(v for (s, _), v in sorted(pieces.items()) if s == r["sequence_id"]) and len(r["ids"]) == 4 * r["n_ids"]


def test_one_length_over_many_files(spark):
    some = spark.range(3000, numPartitions=7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c").otherwise("a").alias("text"))
    check(packing.pack(some, size=9).collect(), 9)
