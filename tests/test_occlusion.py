"""Take occlusion: published cases, and what holds for any spans."""

import random

from pyspark.sql import functions as F

from spanloom.operators import occlusion, retakes, takes
from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"
UNITS = "rec_id long, unit_id long, start_ms long, end_ms long, words array<struct<w:string,start_ms:long,end_ms:long,closes:boolean>>, parent_id long, role string, splice boolean, verified boolean"


def bare(text):
    return "".join(c for c in text if c.isalnum()).lower()


def unit(rec, i, words, parent=None, role=None, splice=None, verified=None):
    ws = [(bare(w), round(a * 1000), round(b * 1000), w[-1] in "。！？!?") for w, a, b in words]
    return (rec, i, ws[0][1], ws[-1][2], ws, parent, role, splice, verified)


def run(spark, units, script=()):
    out = occlusion.occlude(spark.createDataFrame(units, UNITS), script).orderBy("rec_id", "start_ms").collect()
    return {(r["rec_id"], r["unit_id"]): r for r in out}


def test_cases(spark):
    units = [
        unit(1, 10, [("終端裝置將結果回傳給主機，", 10, 13), ("也就是說我們", 13.2, 14.8)], 1),
        unit(1, 11, [("也就是說我們的設備", 15.2, 16.5)], 2),
        unit(1, 12, [("也就是說我們的設備會公開廣播通道摘要。", 17, 22)], 2),
        unit(2, 15, [("取得原始數據之後", 40, 43), ("研究團隊將信號轉換", 43, 46)], None, "prefix"),
        unit(2, 16, [("研究團隊把信號轉換成高解析度頻譜圖", 46.8, 53)], None, "continuation", True),
        unit(3, 1, [("前面的話到這裡", 1, 3), ("研究團", 3, 4)]),  # three characters are too few
        unit(3, 2, [("研究團隊把信號轉換", 4.5, 9)]),
        unit(4, 1, [("這是第一句的開頭然後核心系統", 0, 4)]),  # one word: cut in proportion
        unit(4, 2, [("核心系統運作穩定", 4.2, 8)]),
        unit(5, 1, [("前面的話到這裡研究團隊", 0, 3)], None, None, None, True),
        unit(5, 2, [("研究團隊把信號轉換", 4, 9)], None, None, None, True),
        unit(6, 1, [("前面的話到這裡研究團隊", 0, 3)]),
        unit(6, 2, [("研究團隊把信號轉換", 29, 35)]),  # too far
    ]
    got = run(spark, units)
    assert sorted(k for k in got if k[0] == 1) == [(1, 10), (1, 12)]
    assert (got[1, 10]["end_ms"], got[1, 10]["wall_after"], got[1, 10]["cut_tail"]) == (13_000, 13_199, True) and got[1, 12]["start_ms"] == 17_000
    assert (got[2, 15]["end_ms"], got[2, 15]["role"], got[2, 16]["role"]) == (43_000, "prefix", "continuation")
    assert (got[4, 1]["end_ms"], got[4, 1]["n_chars"], got[4, 1]["wall_after"]) == (10 * 4000 // 14 + (10 * 4000 % 14 * 2 >= 14), 10, 10 * 4000 // 14 + (10 * 4000 % 14 * 2 >= 14))
    assert not got[5, 1]["cut_tail"] and not got[6, 1]["cut_tail"]
    assert (got[3, 1]["n_chars"], got[3, 1]["cut_tail"]) == (10, False)


def test_with_a_script(spark):
    units = [
        unit(1, 1, [("今天我們來深入探討", 10, 12.1), ("核心系統的效能", 12.2, 14)]),
        unit(1, 2, [("核心系統的效能", 15, 16.8), ("與延遲表現非常出色。", 16.8, 19.5)]),
        unit(2, 5, [("波束成形技術會把無線能量精準送到裝置", 20, 25)]),
        unit(2, 6, [("這種為了讓連線更穩的設計把訊號精準送到裝置卻也留下了反射特徵", 25.5, 32)]),
        unit(3, 1, [("今天我們來談", 1, 3)]),
        unit(3, 2, [("今天我們來談核心系統", 4, 8)]),
    ]
    got = run(spark, units, [bare("今天我們來深入探討核心系統的效能與延遲表現非常出色。")])
    assert (got[1, 1]["end_ms"], got[1, 1]["role"], got[1, 2]["role"], got[1, 2]["splice"]) == (12_100, "prefix", "continuation", True)
    assert (3, 1) not in got and got[3, 2]["cut_head"]
    got = run(spark, units, [bare("波束成形技術會把無線能量精準送到裝置。"), bare("這種為了讓連線更穩的設計把訊號精準送到裝置，卻也留下了反射特徵。")])
    assert got[2, 5]["n_chars"] == 18 and not got[2, 5]["cut_tail"]


def test_stutter_and_difficult_units(spark):
    units = [unit(1, 1, [("簡單的", 0, 0.5), ("簡單的", 0.6, 1.1), ("模型就能還原", 1.1, 3)]), unit(2, 1, [("hello", 0, 1), ("hello", 1, 2), ("there", 2, 3), ("friend", 3, 4)])]
    units += [(3, 1, 5, 6, [], None, None, None, None), (3, 2, 7, 8, None, None, None, None, None), (3, 2, 7, 8, None, None, None, None, None)]
    out = occlusion.occlude(spark.createDataFrame(units, UNITS)).collect()
    got = {(r["rec_id"], r["unit_id"]): r for r in out}
    assert len(out) == 5 and (got[1, 1]["start_ms"], got[1, 1]["first_char"], got[1, 1]["wall_before"], got[1, 1]["n_chars"]) == (600, 3, 500, 9)
    assert (got[2, 1]["start_ms"], got[2, 1]["first_char"]) == (1000, 5) and got[3, 2]["n_chars"] == 0
    assert occlusion.occlude(spark.createDataFrame([], UNITS)).count() == 0


def test_neighbours_share_nothing(spark):
    """Random spans that say again what follows: what is kept does not end as what follows begins."""
    rng, units, text = random.Random(2), [], {}
    for rec in range(60):
        at, said = 0, ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        for i in range(8):
            ws = said[i * 6 : i * 6 + 6] + said[i * 6 + 6 : i * 6 + 6 + rng.choice([0, 0, 1, 3])]
            units.append(unit(rec, i, [(w, at + k, at + k + 0.9) for k, w in enumerate(ws)]))
            text[rec, i] = "".join(ws)
            at += len(ws) + rng.choice([0, 1])
    got = run(spark, units)
    kept, cut = {}, 0
    for k, r in got.items():
        kept[k] = text[k][r["first_char"] : r["first_char"] + r["n_chars"]]
        cut += r["cut_tail"]
    assert cut > 100
    ids = sorted(got)
    for a, b in zip(ids, ids[1:], strict=False):
        if a[0] == b[0]:
            assert not any(kept[a].endswith(kept[b][:k]) for k in range(5, 40) if len(kept[b]) >= k), (a, kept[a], kept[b])
    gone = {k: text[k][len(kept[k]) :] for k in kept if got[k]["cut_tail"]}
    assert sum(text[k[0], k[1] + 1].startswith(gone[k][:4]) for k in gone) > 0.9 * len(gone)  # the rest begin a little later


def test_predicates_agree_with_columns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 24))) for _ in range(40)] + ["那麼核心系統", "核心系統的", "ok那核心", ""]
    pairs = [(i, rng.choice(texts), rng.choice(texts)) for i in range(400)]
    from spanloom.functions import text as T

    df = spark.createDataFrame(pairs, "i long, a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("i", "a", "b", T.strip_fillers(a).alias("sa"), T.strip_fillers(b).alias("sb"), retakes.restarts(a, b).alias("r"), retakes.aborted(a, b).alias("x"), retakes.related(a, b).alias("y"), retakes.opens_again(a, b).alias("o"), retakes.seam(F.lower(F.regexp_replace(a, "[^\\p{L}]", "")), F.lower(F.regexp_replace(b, "[^\\p{L}]", ""))).alias("s")).collect():
        one, two = takes.Take(bare(r["a"]), r["sa"]), takes.Take(bare(r["b"]), r["sb"])
        assert (takes.restarts(one, two), takes.aborted(one, two), takes.related(one, two), takes.opens_again(one, two)) == (r["r"], r["x"], r["y"], r["o"]), r
        assert r["s"] == takes.overlap(one.norm, two.norm, takes.Script())


def test_query(spark):
    rows = catalog.queries()["take_occlusion"](spark, SF).collect()
    assert sum(r["cut_tail"] for r in rows) > 20 and all(r["start_ms"] <= r["end_ms"] for r in rows)


def test_overlap_cases():
    """A seam with characters behind it, one after a rephrased start, an echo in the middle of a sentence."""
    both = lambda a, b, script=(): takes.overlap(bare(a), bare(b), takes.Script([bare(x) for x in script]))
    assert both("完美的監控工具對就是WiFi你大概也聽過WiFi訊號撞到人體會產生細微摔", "對就是你家路由器發出的訊號你大概也聽過WiFi訊號撞到人體會出現細微衰減").startswith("你大概也聽過wifi訊號撞到人體會")
    assert both("波束成形技術會把無線能量精準送到裝置", "這種為了讓連線更穩的設計把訊號精準送到裝置卻也留下了反射特徵") == ""
    assert both("前面一段話核心系統的效能呃", "核心系統的效能與延遲表現") == "核心系統的效能"
    assert both("前面一段話核心系統", "核心系統運作", ["核心系統就是核心系統"]) == "" and both("前面一段話這核心系統", "這核心系統運作") == "這核心系統"
    assert both("abc", "abc") == "" and both("", "x") == ""


def test_units_are_narrow_in_python(spark):
    """A unit goes to the fold as a text and arrays of numbers, not as a struct a word."""
    import io
    from contextlib import redirect_stdout

    words = "array<struct<w:string,start_ms:long,end_ms:long,closes:boolean>>"
    rows = [(1, 1, 0, 900, [("今天天氣晴朗", 0, 900, None)]), (1, 2, 1000, 2000, [("", 1000, 1000, False), ("謝謝收看再見", 1000, 2000, True)]), (1, 3, 2100, 2200, []), (1, 4, 2300, 2400, None)]
    df = occlusion.occlude(spark.createDataFrame(rows, f"rec_id long, unit_id long, start_ms long, end_ms long, words {words}"))
    assert sorted((r["unit_id"], r["n_chars"]) for r in df.collect()) == [(1, 6), (2, 6), (3, 0), (4, 0)]
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    fold = next(x for x in out.getvalue().splitlines() if "Exchange" in x or "Sort" in x)
    assert fold and "spoken" in out.getvalue()
