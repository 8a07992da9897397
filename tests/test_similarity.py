"""Each text's best block against all pairs."""

import random
import re

from spanloom.operators import similarity
from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"


def all_pairs(text, blocks, least=0.45, longest=1.85):
    best = None
    for i, b in sorted(blocks):
        if b and text and len(text) <= len(b) * longest:
            c = similarity._covered(b, text)
            if c >= least and (best is None or c > best[0]):
                best = c, i
    return best


def random_case(rng):
    alphabet = rng.choice(["ab", "abcdefgh", "漢字仮名交文a", "あいうえお"])
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    blocks = [(i, make(rng.choice([1, 2, 3, 5, 9, 20, 60]))) for i in range(12)] + [(12, ""), (14, "abcabc"), (13, "abcabc")]
    texts = [make(rng.randint(0, 80)) for _ in range(10)]
    for _, b in blocks:
        t = list(b)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 2)] = make(rng.randint(0, 3))
        texts.append("".join(t))
    return texts, blocks


def test_bounds_are_bounds():
    rng = random.Random(1)
    for _ in range(60):
        texts, blocks = random_case(rng)
        for k in (2, 3):
            mine = [(i, b) for i, b in blocks if b and k == (2 if re.search("[一-鿿]", b) else 3)]
            if mine:
                held = similarity.Blocks(mine, k)
                for t in texts:
                    for (_, b), most in zip(held.blocks, held.bounds(t), strict=True):
                        if len(t) <= 2 * len(b):
                            assert similarity._covered(b, t) * len(b) <= most + 1e-9, (b, t)


def test_random_texts_against_all_pairs(spark):
    rng = random.Random(2)
    for together, chars in ((256, 4_000_000), (2, 4_000_000), (3, 60)):
        texts, blocks = random_case(rng)
        df = spark.createDataFrame([*enumerate(texts), (99, None)], "i long, norm string")
        got = similarity.best_block(df, spark.createDataFrame([*blocks, (50, None)], "block_id long, norm string"), group_chars=chars, together=together)
        assert got.columns == ["i", "norm", "block_id", "coverage"]
        for r in got.collect():
            want = all_pairs(r["norm"] or "", blocks)
            assert (r["coverage"], r["block_id"]) == (want or (None, None)), r


def test_published_scores():
    """A near match counts, a fragment does not."""
    block = "為什麼以前全世界的電腦只認識英文不認識中文"
    assert similarity._covered(block, "為什麼以前全世界的電腦只認識英文不認識中文") == 1.0
    assert similarity._covered(block, "為什麼以前全世界的電腦只認得英文不認識中文") >= 0.80
    assert similarity._covered(block, "為什麼以前全") < 0.35


def bare(t):
    return "".join(c for c in t if c.isalnum()).lower()


def test_query_against_all_pairs(spark):
    blocks = [(r["item_id"], bare(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r["doc_id"], r["line"]): (r["coverage"], r["block_id"]) for r in catalog.queries()["coverage_score"](spark, SF).collect()}
    lines = {(r["doc_id"], i): bare(x) for r in docs for i, x in enumerate((r["text"] or "").split("\n"))}
    some = random.Random(3).sample(sorted(lines), 500) + sorted(got)
    for k in some:
        want = all_pairs(lines[k], blocks)
        assert (round(want[0], 6), want[1]) == got[k] if want else k not in got, k
    assert got
    last = catalog.queries()["last_take_per_block"](spark, SF).collect()
    assert {r["block_id"] for r in last} == {b for c, b in got.values() if c >= 0.85}


def test_unlike_blocks_are_not_aligned(monkeypatch):
    """Texts of the same few words in another order pass no bound; a part of a block with other words around it does."""
    import random

    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    blocks = [(i, "".join(rng.choices(words, k=30))) for i in range(50)]
    held, called, plain = similarity.Blocks(blocks, 3), [0], similarity._covered

    def counted(a, b):
        called[0] += 1
        return plain(a, b)

    monkeypatch.setattr(similarity, "_covered", counted)
    for _ in range(20):
        held.best("".join(rng.choices(words, k=30)), 0.85, 1.85, None)
    assert called[0] == 0
    at = blocks[7][1]
    assert held.best(at[: len(at) * 9 // 10] + "zzzz", 0.85, 1.85, None)[1] == 7 and called[0] == 1


def test_many_texts_at_once_against_all_pairs(monkeypatch):
    """Texts that wait together, in parts of any size, blocks of many words and letters of any plane: as all pairs say."""
    rng = random.Random(7)
    for held, together, words, letters in ((8_000_000, 4_096, 16, "abcd"), (300, 3, 16, "abcdefghij"), (2_000, 50, 1, "abcdefgh"), (900, 7, 2, "漢字仮名交文a𠀀𠀁"), (500, 9, 16, [chr(c) for c in range(0x4E00, 0x5200)])):
        monkeypatch.setattr(similarity, "HELD", held)
        monkeypatch.setattr(similarity, "TOGETHER", together)
        monkeypatch.setattr(similarity, "WORDS", words)
        make = lambda n, letters=letters: "".join(rng.choice(letters) for _ in range(n))
        blocks = [(i, make(rng.choice([1, 2, 3, 9, 62, 63, 64, 126, 127, 150, 200]))) for i in range(25)]
        texts = [make(rng.randint(0, 260)) for _ in range(25)] + [""]
        for _, b in blocks:
            parts = [make(rng.randint(0, 4)) + b[i : i + 8] for i in range(0, len(b), 9)]
            texts += ["".join(parts), "".join(rng.sample(parts, len(parts))), b[: len(b) * 2 // 3] + make(5)]
        for k in (2, 3):
            mine = [b for b in blocks if k == (2 if re.search("[一-鿿]", b[1]) else 3)]
            if mine:
                before = [(0.5, 99) if i % 5 == 0 else None for i in range(len(texts))]
                got = similarity.Blocks(mine, k).best_of(texts, 0.45, 1.85, before)
                for text, had, one in zip(texts, before, got, strict=True):
                    want = all_pairs(text, mine)
                    assert one == (max(had, want, key=lambda x: (x[0], -x[1])) if had and want else want or had), text


def test_unlike_blocks_are_ruled_out_together(monkeypatch):
    """Of texts in the blocks' own syllables, few pairs come to the search for runs in order, which goes pair by pair."""
    rng = random.Random(8)
    syllables = "the and ing tion re ha er es on in nt ou st ed at sh wh ble ly an ti or en th ea nd".split()
    make = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    blocks, texts, called = [(i, make(rng.randrange(40, 110))) for i in range(120)], [make(rng.randrange(40, 110)) for _ in range(60)], [0]
    plain, held = similarity.Blocks.in_order, similarity.Blocks(blocks, 3)

    def counted(self, grams, i):
        called[0] += 1
        return plain(self, grams, i)

    monkeypatch.setattr(similarity.Blocks, "in_order", counted)
    got = [held.best(t, 0.45, 1.85, None) for t in texts]
    assert got == [all_pairs(t, blocks) for t in texts]
    assert called[0] < 100
