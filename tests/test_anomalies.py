"""Anomaly windows: published cases, repeats against brute force, merging against a plain loop."""

import random

from spanloom.operators import anomalies
from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"
CLIPS = "rec_id long, clip_id long, start_ms long, end_ms long, text string, first_seg long, last_seg long, verified boolean, total_ms long"


def test_cases(spark):
    clips = [
        (1, 1, 80_000, 85_000, "前段結論非常明確因為系統架構", 14, 14, None, 120_000),
        (1, 2, 85_400, 92_000, "因為啊，因為系統架構已經完成模組化設計並將訊號轉換", 15, 15, None, 120_000),
        (1, 3, 92_500, 98_000, "將訊號轉換成標準向量格式輸出", 16, 16, None, 120_000),
        (2, 1, 33_000, 51_600, "完美的監控工具其實已經在你家裡了對就是WiFi你大概也聽過WiFi訊號撞到人體會產生細微摔", 6, 6, None, 70_000),
        (2, 2, 51_700, 62_000, "對就是你家路由器發出的訊號你大概也聽過WiFi訊號撞到人體會出現細微衰減與相位變化", 7, 7, None, 70_000),
        (3, 1, 0, 5_000, "今天我們來談核心", 1, 2, None, 100_000),
        (3, 2, 4_000, 9_000, "完全不同的內容在此", 2, 3, None, 100_000),
        (4, 1, 0, 5_000, "今天我們來談核心", 1, 1, True, 100_000),
        (4, 2, 5_500, 9_000, "今天我們來談核心系統", 2, 2, True, 100_000),
        (5, 1, 50_000, 52_000, "沒有句子的片段在這裡", None, None, None, 100_000),
        (6, 1, 0, 100_000, "研究者推測資料研究者推測資料", 1, 1, None, 100_000),  # too long a window
        (7, 1, 5, 6, None, 1, 1, None, 6),
        (7, 2, 5, 6, "", 2, 2, None, 6),
    ]
    got = {}
    for r in anomalies.merge(anomalies.candidates(spark.createDataFrame(clips, CLIPS))).collect():
        got.setdefault(r["rec_id"], []).append((r["first"], r["last"], r["win_start"], r["win_end"], sorted(r["kinds"])))
    assert got == {
        1: [(0, 3, 77_000, 101_000, ["repeat", "seam"])],
        2: [(0, 2, 30_000, 65_000, ["seam"])],
        3: [(0, 2, 0, 15_000, ["retake"])],
        5: [(0, 1, 42_000, 60_000, ["loose"])],
    }


def slow_repeat(s, least=6, most=24, gap=12):
    for k in range(min(most, len(s) // 2), least - 1, -1):
        for i in range(len(s) - 2 * k + 1):
            if s.find(s[i : i + k], i + k, min(len(s), i + 2 * k + gap)) >= 0:
                return i, k
    return 0, 0


def test_repeats_against_brute_force():
    rng = random.Random(1)
    for n in range(3000):
        text = "".join(rng.choice("ab" if n % 3 else "abcdef") for _ in range(rng.randint(0, 60)))
        if n % 2 and text:
            at, k = rng.randrange(len(text)), rng.randint(1, 30)
            text = text[:at] + text[at : at + k] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) + text[at:]
        got = anomalies.repeat_inside(text)
        assert (got if got[1] else (0, 0)) == slow_repeat(text), text


def slow_merge(rows, longest, most):
    held = []
    for _, first, last, kind, start, end in rows:
        for h in held:
            if max(first, h["first"]) < min(last, h["last"]):
                if max(end, h["end"]) - min(start, h["start"]) <= longest:
                    h.update(first=min(first, h["first"]), last=max(last, h["last"]), start=min(start, h["start"]), end=max(end, h["end"]), n=h["n"] + 1, kinds=h["kinds"] + [kind] * (kind not in h["kinds"]))
                break
        else:
            if len(held) < most:
                held.append(dict(first=first, last=last, start=start, end=end, kinds=[kind], n=1))
    return [(h["first"], h["last"], h["start"], h["end"], h["kinds"], h["n"]) for h in held]


def test_merging_against_a_plain_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    for rec in range(60):
        mine = []
        for _ in range(rng.randint(1, 25)):
            first, start = rng.randint(0, 20), rng.randint(0, 200)
            mine.append((rng.choice([1, 2, 4]), first, first + rng.randint(1, 4), rng.choice(["retake", "seam", "repeat"]), start, start + rng.randint(15, 80)))
        mine = sorted(set(mine), key=lambda r: r[:4])
        mine = [m for i, m in enumerate(mine) if not i or m[:4] != mine[i - 1][:4]]
        want[rec] = slow_merge(mine, 90, 5)
        rows += [(rec, *m) for m in mine]
    got = {}
    for r in anomalies.merge(spark.createDataFrame(rows, "rec_id long, step int, first long, last long, kind string, win_start long, win_end long"), 90, 5).orderBy("rec_id", "window_id").collect():
        got.setdefault(r["rec_id"], []).append((r["first"], r["last"], r["win_start"], r["win_end"], r["kinds"], r["n_merged"]))
    assert got == want


def test_query(spark):
    rows = catalog.queries()["anomaly_windows"](spark, SF).collect()
    assert any("seam" in r["kinds"] for r in rows) and any("loose" in r["kinds"] for r in rows) and all(r["win_end"] - r["win_start"] <= 90_000 for r in rows)
