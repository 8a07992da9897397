"""The license scan against sliding windows: what is planted is found, what is found is there, whatever else the text says."""

import random
import time

from spanloom.llm import licenses

RNG = random.Random(12)
PROSE = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return [RNG.choice(PROSE) for _ in range(n)]


def common(a, b):
    """The longest common subsequence of two lists of words."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(row[j - 1] + 1 if x == y else max(row[j], now[-1]))
        row = now
    return row[-1]


def edited(words, share):
    out = []
    for w in words:
        r = RNG.random()
        out += [] if r < share / 3 else [RNG.choice(PROSE)] if r < 2 * share / 3 else [w, RNG.choice(PROSE)] if r < share else [w]
    return out


def test_against_sliding_windows():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.LEAST)
    for n in range(60):
        name = RNG.choice(sorted(licenses.NOTICES))
        notice = licenses.words_of(licenses.NOTICES[name])
        said, front = edited(notice, RNG.choice([0.0, 0.05, 0.1, 0.3, 0.6])), prose(RNG.randint(0, 60))
        words = front + said + prose(RNG.randint(0, 60))
        got = scanner(" ".join(words))
        for m in got:  # sound: no match claims more than the best alignment of its window
            t = licenses.words_of(licenses.NOTICES[m.name])
            assert m.coverage == m.aligned / len(t) >= licenses.LEAST - 1e-9 and m.aligned <= common(t, words[m.start : m.end])
        width = licenses.SPREAD * len(notice)
        best = max(common(notice, words[i : i + width]) for i in range(0, max(1, len(words) - len(notice) // 2), 5)) / len(notice)
        mine = [m for m in got if m.start < len(front) + len(said) and m.end > len(front)]
        if best >= licenses.LEAST + 0.12:
            assert any(m.name == name or common(licenses.words_of(licenses.NOTICES[m.name]), said) >= common(notice, said) for m in mine), (n, name, best)
        if best < licenses.LEAST:
            assert all(m.name != name for m in got)
        assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))


def test_copies_repeat_and_tie():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.LEAST)
    name = min(licenses.NOTICES, key=lambda k: len(licenses.NOTICES[k]))
    notice = licenses.words_of(licenses.NOTICES[name])
    began = time.time()
    words = []
    for _ in range(4000):
        words += prose(30) + notice
    got = scanner(" ".join(words))
    assert time.time() - began < 60
    assert [m.start for m in got if m.name == name] == [i * (30 + len(notice)) + 30 for i in range(4000)]
    twice = licenses.Scanner({"a": licenses.NOTICES[name], "b": licenses.NOTICES[name]}, licenses.LEAST)(" ".join(prose(9) + notice))
    assert [m.name for m in twice] == ["a"]  # of equal templates the first
    assert scanner(None) == scanner("") == scanner(" ".join(prose(500))) == []


def test_a_notice_in_a_long_text(spark):
    name = sorted(licenses.NOTICES)[0]
    notice = licenses.words_of(licenses.NOTICES[name])
    text = " ".join(prose(100_000) + notice + prose(100_000))
    rows = licenses.scan(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string"), out="found").collect()
    assert [[(m["license"], m["start"], m["end"]) for m in r["found"]] for r in rows] == [[(name, 100_000, 100_000 + len(notice))]] * 2 + [[]]
