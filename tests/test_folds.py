"""Sentences, pauses and chunks: published cases, and chunks against whole lists."""

import random

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import folds, takes

WORDS = "rec_id long, seg_id long, pos long, word string, start_ms long, end_ms long"


def bare(t):
    return "".join(c for c in t if c.isalnum()).lower()


def test_pauses(spark):
    cases = [
        ([("例如", 0, 0.2), ("你", 0.2, 0.35), ("自己", 0.35, 0.6), ("例如", 0.85, 1.05), ("你", 1.05, 1.2), ("帶著", 1.2, 1.45), ("自己", 1.45, 1.7), ("手機", 1.7, 2.0)], ["例如你自己", "例如你帶著自己手機"]),
        ([("今天我們", 0, 0.62), ("來介紹核心系統", 0.63, 1.54), ("核心系統的實測表現", 1.96, 3.12)], ["今天我們來介紹核心系統", "核心系統的實測表現"]),
        ([("第一階段", 0, 0.6), ("完成採集,", 0.6, 1.6), ("並透過", 1.6, 2.05)], ["第一階段完成採集,", "並透過"]),
        ([("例", 10, 10.12), ("如", 10.12, 10.24), ("你", 10.24, 10.56), ("例", 10.62, 10.74), ("如", 10.74, 10.86), ("你", 10.86, 11.0), ("攜帶裝置進入測試區。", 11.0, 12.2)], ["例如你", "例如你攜帶裝置進入測試區。"]),
        ([("請大家", 20, 20.45), ("仔", 20.45, 20.78), ("仔", 20.78, 20.92), ("細細觀察數據變化。", 20.92, 22.1)], ["請大家仔仔細細觀察數據變化。"]),
        ([("好的。", 0, 0.4), ("是", 0.4, 0.6)], ["好的。", "是"]),
        ([(None, 0, 1), ("a", 1, 2)], ["a"]),
    ]
    rows = [(1, s, i, w, round(a * 1000), round(b * 1000)) for s, (ws, _) in enumerate(cases) for i, (w, a, b) in enumerate(ws)]
    got = {}
    for r in folds.split_at_pauses(spark.createDataFrame(rows, WORDS)).orderBy("seg_id", "part").collect():
        ws = [w for w in rows if w[1] == r["seg_id"] and w[4] >= r["start_ms"] and w[5] <= r["end_ms"]]
        assert r["n_words"] == len(ws)
        got.setdefault(r["seg_id"], []).append("".join(w[3] or "" for w in ws))
    assert [got[s] for s in range(len(cases))] == [want for _, want in cases]


def test_sentence_rules(spark):
    def run(*rows):
        """Segments (gap, text, further columns), 1 s each, to the numbers of segments of their sentences."""
        at, out = 0, []
        for i, (gap, text, *more) in enumerate(rows):
            at += gap
            out.append({"rec_id": 1, "seg_id": i, "start_ms": at, "end_ms": at + 1000, "text": text, "speaker": None, "target": None, "first_ms": 0, "first_n": 1, "last_ms": 0, "last_n": 1} | (more[0] if more else {}))
            at += 1000
        df = spark.createDataFrame(out, "rec_id long, seg_id long, start_ms long, end_ms long, text string, speaker string, target boolean, first_ms long, first_n long, last_ms long, last_n long")
        return [r["n_segs"] for r in folds.sentences(df).orderBy("sent_id").collect()]

    assert run((0, "第一句話"), (100, "第二句話")) == [2]
    assert run((0, "第一句話"), (800, "第二句話")) == [1, 1]
    assert run((0, "今天天氣好。"), (250, "我們出門")) == [1, 1]
    assert run((0, "今天天氣很好"), (0, "我們", {"first_ms": 1300, "first_n": 2})) == [1, 1]
    assert run((0, "第一階段完成採集,", {"last_ms": 1000, "last_n": 4}), (0, "並透過")) == [1, 1]
    assert run((0, "第一階段完成採集,", {"last_ms": 400, "last_n": 4}), (0, "並透過")) == [2]
    assert run((0, "短,"), (190, "並")) == [1, 1] and run((0, "短,"), (170, "並")) == [2]
    assert run((0, "TAKE 1"), (160, "開場")) == [1, 1] and run((0, "TAKE 1"), (140, "開場")) == [2]
    assert run((0, "短"), (0, "こんにちは")) == [1, 1]
    assert run((0, "短", {"target": True}), (0, "句", {"target": False})) == [1, 1]
    assert run((0, "短", {"speaker": "A"}), (0, "句", {"speaker": "B"})) == [1, 1] and run((0, "短", {"speaker": "A"}), (0, "句")) == [2]
    assert run(*[(0, "短")] + [(0, "句")] * 6, (120, "句")) == [7, 1]  # with this one it is 8 s long
    assert run((0, None), (0, ""), (0, "句")) == [3]


UNITS = "rec_id long, seg_id long, start_ms long, end_ms long, text string"


def test_chunk_cases(spark):
    two = [(1, 1, 0, 240_000, "開場介紹智慧家庭技術發展"), (1, 2, 240_500, 485_000, "說明毫米波雷達與感測器配置"), (1, 3, 487_400, 750_000, "進入下一個獨立主題討論隱私保護機制"), (1, 4, 751_000, 920_000, "總結未來應用場景與挑戰")]
    back = [(2, 1, 0, 410_000, "前面七分鐘順利講完的第一大段內容"), (2, 2, 411_200, 478_000, "緊接著介紹硬體架構的連接方式"), (2, 3, 479_500, 486_000, "這套無線訊號感測系統最大的優勢是可以穿牆"), (2, 4, 488_600, 500_000, "這套無線訊號感測系統最大的優勢是可以穿牆偵測呼吸"), (2, 5, 501_000, 880_000, "最後總結實驗數據與臨床驗證結果")]
    one = [(3, 1, 40_000, 250_000, "a"), (3, 2, 253_000, 520_000, None)]
    got = [tuple(r) for r in folds.chunks(spark.createDataFrame(two + back + one, UNITS)).orderBy("rec_id", "chunk_id").collect()]
    assert got == [(1, 1, 0, 486_200, 2), (1, 2, 486_200, 920_000, 2), (2, 1, 0, 478_750, 2), (2, 2, 478_750, 880_000, 3), (3, 1, 35_000, 520_000, 2)]


def whole(units, target, pause, longest):
    """Chunks of one recording with all its units at hand; cuts are numbers of the last unit."""
    total, n, cuts, start, first = max(u[1] for u in units), len(units), [], 0 if units[0][0] < 30_000 else units[0][0] - 5_000, 0

    def back(i, low):
        while i > low:
            hit = [b for b in range(max(low, i - 4), i + 1) if any(takes.related(units[b][2], a[2]) for a in units[i + 1 : i + 5])]
            if not hit or hit[0] <= low:
                return i
            i = hit[0] - 1
        return i

    gap = lambda i: units[i + 1][0] - units[i][1]
    while total - start > longest:
        low, cut = first, None
        for i in range(first, n - 1):
            length = units[i][1] - start
            if length >= 0.65 * target and low == first:
                low = i
            if length >= target and gap(i) >= pause:
                safe = back(i, low)
                if safe == i or gap(safe) >= 400:
                    cut = safe
                    break
            if length >= longest:
                tried = [back(c, max(first + 1, low)) for c in range(max(first + 1, low), i + 1)]
                cut = max(tried, key=gap, default=i)
                if gap(cut) < 0:
                    cut = i
                break
        if cut is None:
            break
        start = units[cut][1] + max(0, gap(cut)) // 2
        cuts.append((start, cut))
        first = cut + 1
    return cuts


def test_chunks_against_whole_lists(spark):
    rng, rows, want = random.Random(4), [], {}
    for rec in range(40):
        at, units = rng.choice([0, 0, 50_000]), []
        for i in range(rng.randint(1, 60)):
            at += rng.choice([0, 0, 100, 500, 900, 2500])
            text = units[-rng.randint(1, min(4, len(units)))][3] if units and rng.random() < 0.3 else "".join(rng.choice("abcdefghijklm") for _ in range(8))
            units.append((at, at + rng.randint(500, 9000), None, text))
            at = units[-1][1]
            rows.append((rec, i, units[-1][0], at, text))
        want[rec] = whole([(a, b, takes.Take(t, t), t) for a, b, _, t in units], 20_000, 800, 45_000)
    got = {}
    for r in folds.chunks(spark.createDataFrame(rows, UNITS), 20_000, 800, 45_000).orderBy("rec_id", "chunk_id").collect():
        got.setdefault(r["rec_id"], []).append((r["end_ms"], r["n_units"]))
    assert sum(map(len, want.values())) > 60
    for rec, cuts in want.items():
        ends, n = [], 0
        for end, k in got[rec]:
            n += k
            ends.append((end, n - 1))
        assert ends[:-1] == cuts and n == sum(r[0] == rec for r in rows), rec


def test_stripped_text_is_an_end_of_the_normal_form(spark):
    texts = ["好，那麼完美的監控工具", "那。其實x", "OK, ok、Go On", "所以", "那麼", "x那麼", "  對 - 就是 a_b"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.norm(F.col("t")).alias("n"), T.strip_fillers(F.col("t")).alias("s")).collect():
        assert r["n"].endswith(r["s"])


def test_restart_cases(spark):
    from spanloom.operators import retakes

    cases = [
        ("完美的監控工具誕生了 德國卡爾斯魯爾理工學院的資安研究團", "完美的監控工具誕生了", True),
        ("每個人的走路知識", "每個人的走路姿態 骨架大小都會在空間中擾動", True),
        ("完美的監控工具誕生了", "好，那麼完美的監控工具誕生了，德國卡爾斯魯爾...", True),
        ("結果很嚇人 每位受試者留下40段證藏", "結果很嚇人 每位受試者留下40段正常步行資料", True),
        ("以前常用通道狀態資訊", "CSI來分析，但通常得刷改特定網卡", False),
        ("這套系統", "不需要改裝硬體，因為這套系統直接讀取路由器訊號", False),
        ("打開了潘朵拉的盒子對就是WiFi你大概也聽過", "你大概也聽過WiFi訊號撞到人體會出現細微衰減", False),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", retakes.restarts(F.col("a"), F.col("b"))).collect())


CLIPS = "rec_id long, clip_id long, start_ms long, end_ms long, t_first long, t_last long, wall long, cut_head boolean, cut_tail boolean, splice boolean, role string, total_ms long"


def test_sanitized_cases(spark):
    no = (None,) * 3
    rows = [
        (1, 1, 4_920, 10_000, 5_000, 10_100, None, *no, None, 30_000), (1, 2, 10_050, 10_380, 10_120, 10_350, None, *no, None, 30_000),
        (2, 1, 50_000, 90_000, 50_100, 89_800, None, *no, None, 120_000), (2, 2, 55_000, 65_000, 55_100, 64_900, None, *no, None, 120_000), (2, 3, 10_000, 20_000, 10_100, 19_900, None, *no, None, 120_000),
        (3, 1, 4_920, 6_080, 5_000, 6_100, 6_115, None, True, None, "prefix", 20_000), (3, 2, 6_260, 6_700, 6_300, 6_680, None, None, None, True, "continuation", 20_000),
        (4, 1, 0, 1_000, None, None, None, *no, None, 900), (4, 2, 950, 1_000, None, None, None, *no, None, 900),
    ]
    got = {}
    for r in folds.sanitize(spark.createDataFrame(rows, CLIPS)).orderBy("rec_id", "clip_id").collect():
        got.setdefault(r["rec_id"], []).append((r["start_ms"], r["end_ms"], r["n_clips"]))
    assert got == {1: [(4_920, 10_380, 2)], 2: [(10_000, 20_000, 1), (50_000, 90_000, 2)], 3: [(4_920, 6_115, 1), (6_260, 6_700, 1)], 4: [(0, 900, 2)]}


def plain_sanitized(rows, least=450, room=350):
    """In three passes over lists."""
    cs = []
    for _, i, s, e, first, last, wall, ch, ct, sp, role, total in rows:
        s, e = max(0, min(total, s)), max(0, min(total, e))
        if last is not None and e < last:
            e = min(total, last + 40) if wall is None else min(min(total, last + 40), max(last, wall))
        elif wall is not None and e > wall:
            e = max(last if last is not None else s + 150, wall)
        if e <= s:
            e = min(total, s + 500)
        cs.append(dict(i=i, s=s, e=e, first=s if first is None else first, last=s + 200 if last is None else last, head=bool(ch or sp or role == "continuation"), tail=bool(ct or role == "prefix")))
    flat = []
    for c in sorted(cs, key=lambda c: (c["s"], c["e"], c["i"])):
        if not flat:
            flat += [c] if c["e"] > c["s"] else []
            continue
        p = flat[-1]
        if c["e"] <= p["e"] + 50:
            continue
        if c["s"] < p["e"]:
            at, low, high = max(p["last"], min(c["first"], (p["e"] + c["s"]) // 2)), p["s"] + 150, c["e"] - 150
            if high < low:
                continue
            p["e"] = c["s"] = max(low, min(high, at))
        if c["e"] - c["s"] >= 150:
            flat.append(c)
    out = []
    for c in flat:
        m = out[-1] if out else None
        if m and not m["tail"] and not c["head"] and (c["e"] - c["s"] < least or m["e"] - m["s"] < least) and c["e"] > m["e"] and 0 <= c["s"] - m["e"] <= room:
            m["e"] = c["e"]
        else:
            out.append(c)
    return [(c["s"], c["e"]) for c in out if c["e"] > c["s"]]


def test_sanitized_against_lists(spark):
    rng, rows, maybe = random.Random(9), [], lambda x: rng.choice([None, x])
    for rec in range(60):
        for i in range(rng.randint(1, 12)):
            s = rng.randint(0, 6_000)
            e = s + rng.choice([0, 100, 300, 440, 900, 3_000])
            rows.append((rec, i, s, e, maybe(s + rng.randint(0, 80)), maybe(e + rng.randint(-200, 120)), maybe(e + rng.randint(-100, 200)), maybe(rng.random() < 0.3), maybe(rng.random() < 0.3), maybe(rng.random() < 0.2), rng.choice([None, "none", "prefix", "continuation"]), 7_000))
    got = {}
    for r in folds.sanitize(spark.createDataFrame(rows, CLIPS)).orderBy("rec_id", "clip_id").collect():
        got.setdefault(r["rec_id"], []).append((r["start_ms"], r["end_ms"]))
    for rec in range(60):
        assert got.get(rec, []) == plain_sanitized([r for r in rows if r[0] == rec]), rec
        assert all(a[1] <= b[0] for a, b in zip(got.get(rec, []), got.get(rec, [])[1:], strict=False))
