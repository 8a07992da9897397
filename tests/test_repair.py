"""The repair loop against a plain loop a recording."""

import random
from collections import namedtuple

from spanloom.operators import anomalies, repair, takes

Row = namedtuple("Row", "rec_id place start_ms end_ms text norm bare first_seg last_seg anchored verified total_ms")
Found = namedtuple("Found", "rec_id step first last kind win_start win_end")


def plain(clips, rounds):
    """clips: [id, start, end, text, seg, verified] of one recording."""
    total = max(c[2] for c in clips)
    for n in range(rounds + 1):
        clips = sorted(clips, key=lambda c: (c[1], c[2], c[0]))
        fold, found = anomalies._Candidates(90_000, 15_000), []
        for i, (_, s, e, t, seg, v) in enumerate(clips):
            found += fold.push(Row(1, i, s, e, t, takes.bare(t), takes.bare(t), seg or 0, seg or 0, seg is not None, v, total))
        merged = anomalies._Merged(90_000, 5)
        for f in sorted(found, key=lambda f: (f[1], f[2], f[3], f[4])):
            merged.push(Found(*f))
        windows = merged.held
        if not windows:
            return clips, n, True
        if n == rounds:
            return clips, n, False
        own = {i: next((k for k, w in enumerate(windows) if w[0] <= i < w[1]), None) for i in range(len(clips))}
        out = [c for i, c in enumerate(clips) if own[i] is None]
        for k in range(len(windows)):
            mine = {c[0]: c for i, c in enumerate(clips) if own[i] == k}
            out += [[i, s, e, t, mine[i][4], True] for i, s, e, t in repair.judged([tuple(c[:4]) for c in mine.values()])]
        clips = out


def test_against_a_plain_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for rec in range(30):
        at, mine = 0, []
        for i in range(rng.randint(1, 9)):
            text = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 20)))
            if mine and rng.random() < 0.5:
                said = mine[-1][3]
                text = rng.choice([said + text, said[-8:] + text, said[:5] + text, text[:6] * 2 + text])
            at += rng.choice([0, 500, 40_000])
            mine.append([i, at, at + 2_000, text, None if rng.random() < 0.1 else i, rng.random() < 0.1])
            at += 2_000
        rows += [(rec, *c[:4], c[4], c[4], c[5]) for c in mine]
        want[rec] = plain(mine, 3)
    df = spark.createDataFrame(rows, "rec_id long, clip_id long, start_ms long, end_ms long, text string, first_seg long, last_seg long, verified boolean")
    got = {}
    for r in repair.repair(df, most_rounds=3).collect():
        got.setdefault(r["rec_id"], []).append(r)
    assert {w[1] for w in want.values()} >= {0, 1} and sum(len(w[0]) for w in want.values()) < len(rows)
    for rec, (clips, rounds, settled) in want.items():
        assert sorted((r["clip_id"], r["start_ms"], r["end_ms"], r["text"], r["first_seg"], r["verified"]) for r in got[rec]) == sorted(map(tuple, clips)), rec
        assert {(r["rounds"], r["settled"]) for r in got[rec]} == {(rounds, settled)}


def test_verified_pairs_are_left_alone(spark):
    rows = [(1, 1, 0, 2000, "today we talk about", 1, 1), (1, 2, 2100, 5000, "today we talk about systems", 2, 2), (2, 1, 0, 5000, None, 1, 1)]
    df = spark.createDataFrame(rows, "rec_id long, clip_id long, start_ms long, end_ms long, text string, first_seg long, last_seg long")
    out = {(r["rec_id"], r["clip_id"]): (r["verified"], r["rounds"], r["settled"]) for r in repair.repair(df).collect()}
    assert out == {(1, 2): (True, 1, True), (2, 1): (False, 0, True)}
    never = {(r["rec_id"], r["clip_id"]) for r in repair.repair(df, judge=lambda w: w.filter("false")).collect()}
    assert never == {(2, 1)}
    assert repair.repair(df.limit(0)).count() == 0


FIELDS = "rec_id long, clip_id long, start_ms long, end_ms long, text string, first_seg long, last_seg long"
Parted = namedtuple("Parted", [*Row._fields, "part"])


def whole(clips):
    """clips: [id, start, end, text, seg] of one recording. Until nothing is new: all windows, long ones too, and pairs that go over
    a window's end in the next round. Also the most windows of a round, and how many pairs were put off."""
    total, clips, most, off = max(c[2] for c in clips), [[*c, False, 0] for c in clips], 0, 0
    for n in range(1000):
        clips = sorted(clips, key=lambda c: (c[1], c[2], c[0]))
        fold, found, windows, seams = anomalies._Candidates(90_000, 15_000, True), [], [], []
        for i, (_, s, e, t, seg, v, part) in enumerate(clips):
            found += fold.push(Parted(1, i, s, e, t, takes.bare(t), takes.bare(t), seg or 0, seg or 0, seg is not None, v, total, part))
        for _, step, first, last, _, start, end in sorted(found, key=lambda f: f[1:5]):
            h = next((h for h in windows if max(first, h[0]) < min(last, h[1])), None)
            if h is None:
                windows.append([first, last, start, end])
            elif max(end, h[3]) - min(start, h[2]) <= 90_000:
                h[:] = min(first, h[0]), max(last, h[1]), min(start, h[2]), max(end, h[3])
            elif step == anomalies.PAIR:
                seams.append(clips[first])
        own = [next((k for k, w in enumerate(windows) if w[0] <= i < w[1]), None) for i in range(len(clips))]
        new = any(k is not None and not c[5] for k, c in zip(own, clips, strict=True))
        new |= any(j is not None and j == k and c[6] != d[6] for j, k, c, d in zip(own, own[1:], clips, clips[1:], strict=False))
        if not new:
            return clips, n, not windows, most, off
        most, off = max(most, len(windows)), off + len(seams)
        after = [c for k, c in zip(own, clips, strict=True) if k is None]
        for k in range(len(windows)):
            mine = {c[0]: c for j, c in zip(own, clips, strict=True) if j == k}
            after += [[i, s, e, t, mine[i][4], True, 0] for i, s, e, t in repair.judged([tuple(c[:4]) for c in mine.values()])]
        for c in after:
            c[6] = sum((a[1], a[2], a[0]) < (c[1], c[2], c[0]) for a in seams)
        clips = after


def test_the_whole_job_against_a_plain_loop(spark):
    rng, rows, want = random.Random(9), [], {}
    for rec in range(40):
        at, mine = 0, []
        for i in range(rng.choice([3, 12, 40, 120])):
            text = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(8, 20)))
            if mine and rng.random() < 0.7:
                said = mine[-1][3]
                text = rng.choice([said + text, said[-8:] + text, said[-8:] + text, text[:6] * 2 + text])
            at += rng.choice([0, 500, 500, 40_000])
            mine.append([i, at, at + rng.choice([2_000, 20_000, 30_000, 70_000, 100_000]), text, None if rng.random() < 0.1 else i])
            at = mine[-1][2]
        rows += [(rec, *c, c[4]) for c in mine]
        want[rec] = whole(mine)
    got = {}
    for r in repair.repair(spark.createDataFrame(rows, FIELDS)).collect():
        got.setdefault(r["rec_id"], []).append(r)
    assert max(w[3] for w in want.values()) > 20 and sum(w[4] for w in want.values()) > 20 and {w[2] for w in want.values()} == {True, False}
    for rec, (clips, rounds, settled, _, _) in want.items():
        assert sorted((r["clip_id"], r["start_ms"], r["end_ms"], r["text"], r["first_seg"], r["verified"]) for r in got[rec]) == sorted(tuple(c[:6]) for c in clips), rec
        assert {(r["rounds"], r["settled"]) for r in got[rec]} == {(rounds, settled)}


def test_nothing_is_left_out(spark):
    """More false starts than any number of windows a round; takes longer than a window; words said again over a window's end; clips
    without sentences before one another."""
    short, long_ = "today we talk about", "today we talk about systems"
    rows = [(1, 2 * k + j, 60_000 * k + 2_100 * j, 60_000 * k + 2_100 * j + 2_000, (short, long_)[j], 2 * k + j, 2 * k + j) for k in range(50) for j in range(2)]
    rows += [(2, 1, 0, 60_000, short, 1, 1), (2, 2, 60_000, 130_000, long_, 2, 2)]
    rows += [(3, 1, 0, 30_000, "qwertyuiop asdfgh", 1, 1), (3, 2, 30_000, 60_000, "asdfgh " + short, 2, 2), (3, 3, 60_000, 95_000, long_ + " zxcvbnmjkl", 3, 3), (3, 4, 95_000, 100_000, "zxcvbnmjkl and more", 4, 4)]
    rows += [(4, k, 60_000 * k, 60_000 * k + 2_000, f"{k} words of its own", None, None) for k in range(1, 31)]
    out = {}
    for r in repair.repair(spark.createDataFrame(rows, FIELDS)).collect():
        out.setdefault(r["rec_id"], []).append((r["clip_id"], r["text"], r["verified"], r["rounds"], r["settled"]))
    assert sorted(out[1]) == [(2 * k + 1, long_, True, 1, True) for k in range(50)]
    assert out[2] == [(2, long_, True, 1, True)]
    assert sorted(out[3]) == [(k, t, True, 2, True) for k, t in enumerate(("qwertyuiop", "asdfgh", long_, "zxcvbnmjkl and more"), 1)]
    assert sorted((r[0], *r[2:]) for r in out[4]) == [(k, True, 1, False) for k in range(1, 31)]


def test_merging_without_a_limit(spark):
    """Every candidate that meets no other has its window."""
    rows = [(1, 1 + k % 2, 3 * k, 3 * k + 2, "seam", 100_000 * k, 100_000 * k + 20_000) for k in range(2000)]
    out = anomalies.merge(spark.createDataFrame(rows, anomalies.CANDIDATES)).select("window_id", "first", "n_merged").collect()
    assert sorted(r["first"] for r in out) == [3 * k for k in range(2000)] and {r["n_merged"] for r in out} == {1} and len({r["window_id"] for r in out}) == 2000
