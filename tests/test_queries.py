"""Every query against its DuckDB SQL on the smallest tables; folds and fuzzy matching against small cases."""

import random
from collections import namedtuple
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import folds, fuzzy, retakes, similarity, spans
from spanloom.plans import catalog
from spanloom.sinks import cut_table
from spanloom.sources import recognised

SF = "/root/testdata/sf0.001"
Row = namedtuple("Row", "rec_id seg_id pos word same")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    want = sorted(repr(r) for r in duck.sql(f"SELECT {', '.join(f'"{c}"' for c in names)} FROM ({catalog.oracle_sql()[name]}) z").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_chunk_windows(spark):
    d = spark.createDataFrame([(1, 2_400_000), (2, 0), (3, None), (4, 1_080_500)], "rec_id long, total long")
    got = [tuple(r) for r in spans.chunk_windows(d, "rec_id", "total").orderBy("rec_id", "chunk").collect()]
    assert got == [(1, 0, 0, 1_080_000), (1, 1, 1_075_000, 2_160_000), (1, 2, 2_155_000, 2_400_000), (4, 0, 0, 1_080_000), (4, 1, 1_075_000, 1_080_500)]
    short = spans.chunk_windows(spark.createDataFrame([(1, 2_100), (2, 2_600), (3, 1_000)], "rec_id long, total long"), "rec_id", "total", 1_000, 100, 300)
    assert [tuple(r) for r in short.orderBy("rec_id", "chunk").collect()] == [(1, 0, 0, 1_000), (1, 1, 900, 2_100), (2, 0, 0, 1_000), (2, 1, 900, 2_000), (2, 2, 1_900, 2_600), (3, 0, 0, 1_000)]


def test_digits_count_towards_viability(spark):
    cases = [("2024 10 15", True), ("1234567890", True), ("12 ab", False), ("漢字 a1b", True), ("漢字仮名", True), ("a", False), (None, False), ("", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.is_viable(df["t"])).collect())


def test_loops(spark):
    def run(text):
        rows = [(1, i // 7, i % 7, w) for i, w in enumerate(text.split())]
        return " ".join(r["word"] for r in folds.drop_loops(spark.createDataFrame(rows, "rec_id long, seg_id long, pos long, word string")).orderBy("seg_id", "pos").collect())

    assert run("thank you very thank you very thank you very much") == "thank you very much"
    assert run("a a a b") == "a a a b" and run("a a a a b") == "a b"
    assert run("a b a b a b") == "a b a b a b" and run("one two three") == "one two three"
    assert run("Thank you very, thank you very thank YOU very much") == "Thank you very, much"
    assert run("... - ! ? a") == "... - ! ? a"  # nothing but marks is no repeat
    assert run("p q r " * 24 + "end") == _whole("p q r " * 24 + "end")


def _whole(text):
    """The same with all words at hand: the longest group that repeats is tried first."""
    w, out, i = text.split(), [], 0
    while i < len(w):
        for n in range(8, 0, -1):
            reps = 1
            while w[i + reps * n : i + (reps + 1) * n] == w[i : i + n]:
                reps += 1
            if reps >= (3 if n >= 3 else 4):
                out += w[i : i + n]
                i += reps * n
                break
        else:
            out.append(w[i])
            i += 1
    return " ".join(out)


def test_loops_against_whole_lists():
    rng = random.Random(1)
    texts = ["x " * 500 + "y", "p q r " * 100 + "end"] + [" ".join(rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randint(0, 120))) for k in range(400)]
    texts += [" ".join(" ".join([" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))] * rng.randint(1, 6)) for _ in range(12)) for _ in range(200)]
    for text in texts:
        state, out = folds.Loops(8, 3), []
        for i, w in enumerate(text.split()):
            out += state.push(Row(1, 0, i, w, w))
        assert " ".join(x[3] for x in out + state.close()) == _whole(text)


def test_sanitize(spark):
    clips = spark.createDataFrame([(1, 1, 0, 5000), (1, 2, 4000, 9000), (1, 3, 4500, 9040), (1, 4, 9200, 9500), (1, 5, 20000, 20000)], "rec_id long, clip_id long, start_ms long, end_ms long")
    got = [tuple(r)[2:] for r in folds.sanitize(clips).orderBy("start_ms").collect()]
    assert got == [(0, 4000, 1), (4000, 9500, 3), (20000, 20500, 1)]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_chunk_at_pause(spark):
    units = spark.createDataFrame([(1, 1, 0, 300_000), (1, 2, 300_500, 485_000), (1, 3, 487_400, 700_000), (1, 4, 700_100, 920_000)], "rec_id long, seg_id long, start_ms long, end_ms long")
    got = [tuple(r)[2:] for r in folds.chunks(units).orderBy("chunk_id").collect()]
    assert got == [(0, 486_200, 2), (486_200, 920_000, 2)]


def test_containment_of_many_blocks(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz0123456789"), (2, "xyz"), (3, "")], "doc_id long, norm string")
    blocks = spark.createDataFrame([(1, "cdefghijklmnopqrstuvwxyz0123"), (2, "xyz"), (3, ""), (4, "cdefghijklmnopqrstuvwxyz9999")], "block_id long, norm string")
    for anchor in (1, 3, 12, 24, 100):
        assert sorted(map(tuple, spans.containment(docs, blocks, anchor, few=0).collect())) == [(1, 1), (1, 2), (2, 2)]
    assert sorted(map(tuple, spans.containment(docs, blocks).collect())) == [(1, 1), (1, 2), (2, 2)]
    again = docs.union(docs.filter("doc_id = 2")).union(spark.createDataFrame([(None, "axyz"), (3, None)], docs.schema))
    for few in (0, 512):
        assert sorted(map(str, (tuple(r) for r in spans.containment(again, blocks, few=few).collect()))) == ["(1, 1)", "(1, 2)", "(2, 2)", "(2, 2)", "(None, 2)"]


def test_overlap_counts_against_all_pairs(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        start = rng.randint(0, 60)
        rows.append((rng.choice([1, 2]), i, start, start + rng.choice([0, 0, 1, 2, 7, 20])))
    got = {tuple(r) for r in spans.overlap_counts(spark.createDataFrame(rows, "k long, i long, start_ms long, end_ms long"), "k", "i").collect()}
    n = {a[1]: sum(a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3] for b in rows) for a in rows}
    assert got == {(a[0], a[1], n[a[1]]) for a in rows if n[a[1]]}


def test_listing_holds_whole_text(spark, tmp_path):
    turns = ["Hello there, this is a long turn: it ends after the 20th character.", None, "短い。 {ok} %s\nnext line"]
    spark.createDataFrame([(7, i, "user", t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = catalog.queries()["transcript_listing_whole"](spark, str(tmp_path)).collect()
    n = [sum(c.isalnum() for c in t or "") for t in turns]
    want, at = [], 0
    for i, t in enumerate(turns):
        at += ((7 * 31 + i * 17) % 13) * 100 if i else 0
        start, at = at, at + 60 * max(n[i], 1)
        want.append(f"[Sentence ID: {i:3d}] {start / 1000:6.2f}s -> {at / 1000:6.2f}s | {t or ''}")
    assert row["listing"] == "\n".join(want)


def _occurrences(phrase, text):
    """The reference's loop."""
    n, at, count = len(phrase), 0, 0
    while at + n <= len(text):
        hit = sum(a != b for a, b in zip(phrase, text[at : at + n], strict=True)) <= (0 if n < 5 else 1 if n < 10 else 2)
        count, at = count + hit, at + (n if hit else 1)
    return count


def test_fuzzy_occurrences_against_loop():
    rng = random.Random(4)
    for alphabet in ("ab", "abcdefgh", "漢字仮名ab", "a𝄞b"):
        make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
        phrases = sorted({make(n) for n in (1, 4, 5, 7, 9, 10, 12, 13) for _ in range(4)})
        texts = ["", "a" * 50, *(make(rng.randint(0, 300)) for _ in range(40)), *(p[:-1] + "z" + p for p in phrases)]
        want = {(t, p): n for t, x in enumerate(texts) for p, y in enumerate(phrases) if (n := _occurrences(y, x))}
        assert {(t, p): n for t, p, n in fuzzy.Finder(phrases).count(texts)} == want


def test_fuzzy_occurrence_count_reads_whole_documents(spark, duck):
    got = {(r["doc_id"], r["phrase"]): r["found"] for r in catalog.queries()["fuzzy_occurrence_count"](spark, SF).collect()}
    norm = r"lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g'))"
    items = [r[0] for r in duck.sql(f"SELECT {norm} FROM benchmark").fetchall()]
    phrases = {x[:k] for x in items for k in (4, 7, 12) if len(x) >= k}
    docs = duck.sql(f"SELECT doc_id, {norm} FROM documents ORDER BY doc_id LIMIT 12").fetchall()
    want = {(i, p): n for i, x in docs for p in phrases if (n := _occurrences(p, x))}
    assert {k: n for k, n in got.items() if k[0] in {i for i, _ in docs}} == want
    assert {len(p) for _, p in got} == {4, 7, 12}


def test_coverage_by_the_rule(spark):
    cases = [
        ("abcdefghij", "abcde" + "-" * 10 + "fghij", 1.0),  # twice as long: aligned whole
        ("abcdefghij", "-" * 60 + "abcde" + "-" * 20 + "fghij" + "-" * 60, 1.0),  # a window holds 24 characters more
        ("abcdefghij", "-" * 61 + "abcde" + "-" * 24 + "fghi", 0.9),  # 33 characters at the end, between two strides
        ("あいうえお", "あい" + "-" * 5, 0.0),  # no ideograph: runs of 3
        ("漢字仮名い", "漢字" + "-" * 5, 0.4),
        ("abcdefghij", "abXdeXghX", 0.0),
        ("abc", "xxabcxx", 1.0),
        ("", "abc", 0.0),
        ("abc", "", 0.0),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b string, t string, want double")
    for r in df.withColumn("got", similarity.coverage(df["b"], df["t"])).collect():
        assert r["got"] == pytest.approx(r["want"]), cases[r["i"]]


def test_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in catalog.queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_fillers_with_commas_between(spark):
    cases = [("那。其實x", "其實x"), ("...那麼，其實 好x", "x"), ("OK, ok、Go On", "goon"), ("所以", ""), (None, ""), ("這那麼", "這那麼")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r["got"] for r in df.select(T.strip_fillers(df["t"]).alias("got")).collect()] == [w for _, w in cases]


def test_words_as_shown(spark):
    cases = [("漢 字 x y", "漢字x y"), ("a ( b ) c", "a (b) c"), ("100 % of it , ok ?", "100% of it, ok?"), ("「 go 」 on", "「go」on"), ("ア ー ok", "アーok"), ("a 𝄞 b", "a 𝄞 b"), ("", "")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r["got"] for r in df.select(T.join_for_display(F.split("t", " ")).alias("got")).collect()] == [w for _, w in cases]


def test_earlier_takes_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(1, 60), rng.randint(4, 40)) for _ in range(200)] + [("c", None, 5), ("c", 1, 5)]
    got = sorted(map(tuple, folds.earlier_takes(spark.createDataFrame(rows, "head string, doc_id long, n long")).collect()))
    known = [r for r in rows if r[1] is not None]
    want = [(max((a[1] for a in known if a[0] == b[0] and a[1] < b[1] and b[2] >= a[2] * 3 // 4), default=None), b[1]) for b in known]
    assert got == sorted(w for w in want if w[0] is not None)


def test_word_groups_in_ideographs(spark):
    rows = [(1, 0, i, w, 100 * i, 100 * i + 90) for i, w in enumerate("漢字" * 30)] + [(1, 1, 0, " ", 6000, 6001), (1, 1, 1, "好。”", 6100, 6200), (1, 1, 2, None, 6200, 6210), (1, 1, 3, "ok", 6200, 6300)]
    got = folds.word_groups(spark.createDataFrame(rows, "rec_id long, seg_id long, pos long, word string, start_ms long, end_ms long"), cjk=True).orderBy("group_id").collect()
    assert [len(r["words"]) for r in got] == [24, 24, 13, 1] and got[-1]["start_ms"] == 6200


def _bare(t):
    return "".join(c for c in t or "" if c.isalnum() or c == "_").lower()


def _plain_retakes(t, u):
    """(restarts, aborted) by the rules, with plain strings that have no fillers."""
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    p, n = _bare(t), _bare(u)
    if min(len(p), len(n)) < 3:
        return False, False
    w = min(14, max(6, len(n)))
    x, y = p[:w], n[:w]
    k = min(len(x), len(y))
    again = x[: min(4, k)] == y[: min(4, k)] or (len(x) > 3 and x[:4] in y[:7]) or (len(y) > 3 and y[:4] in x[:7]) or (k > 3 and like(x[:k], y[:k]) >= 0.7)
    false = (p[:3] == n[:3] and len(n) >= len(p) * 3 // 4) or (len(p) > 3 and p[:-1] in n) or (len(p) > 4 and like(p, n[: len(p) + 4]) >= 0.72)
    return again, again or false


def test_retakes_against_plain_rules(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 24))) for _ in range(60)] + [None, "", "漢字仮名", "漢字仮名まじり文", "a𝄞bcde"]
    pairs = [(i, rng.choice(texts), rng.choice(texts)) for i in range(600)]
    for k in range(0, 600, 3):  # near copies
        t = list(pairs[k][1] or "abc")
        t[rng.randrange(len(t)) if t else 0 : 1] = ["z"]
        pairs[k] = (k, pairs[k][1], "".join(t))
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    for r in df.select("i", "a", "b", retakes.restarts(a, b).alias("r"), retakes.aborted(a, b).alias("x"), retakes.related(a, b).alias("y")).collect():
        one, two = _plain_retakes(r["a"], r["b"]), _plain_retakes(r["b"], r["a"])
        p, n = _bare(r["a"]), _bare(r["b"])
        assert (r["r"], r["x"], r["y"]) == (*one, one[1] or two[1] or (len(p) > 3 and p[:4] == n[:4])), r


def test_recognised_words(spark, tmp_path):
    js = ['{"results":[{"languageCode":"en"},{"alternatives":[{"words":[{"word":" a ","startOffset":"1.5s","endOffset":"1.51s"},{"word":" "},{"word":"b"}]},{"words":[{"word":"no"}]}]}]}', "{", None, "{}"]
    df = spark.createDataFrame(list(enumerate(js)), "k long, js string")
    assert sorted(tuple(r) for r in recognised.words_of(df, "k", "js", F.lit(100)).collect()) == [(0, 1, 0, "a", 1600, 1620), (0, 1, 2, "b", 100, 120)]
    (tmp_path / "one.json").write_text(js[0])
    assert [r["word"] for r in recognised.read_words(spark, str(tmp_path)).orderBy("pos").collect()] == ["a", "b"]


def test_cut_table(spark, tmp_path):
    df = spark.createDataFrame([(2, "x", 1005, 2000, 'say "hi"'), (1, None, 0, 1004, None)], "place long, topic string, s long, e long, t string")
    c = F.col
    line = cut_table.csv_line(c("place"), c("topic"), c("s"), c("e"), F.lit(4567), F.lit(-120), F.lit(None).cast("long"), c("t"), F.lit("v"), F.lit("a"))
    cut_table.write_cut_table(df.select("place", line.alias("line")), f"{tmp_path}/cut")
    got = "".join(p.read_text() for p in sorted((tmp_path / "cut").glob("part-*"))).splitlines()
    assert got == ["\ufeff" + ",".join(cut_table.COLUMNS), '1,"",0.00,1.00,1.00,4.57,-0.12,,"","v","a"', '2,"x",1.01,2.00,1.00,4.57,-0.12,,"say ""hi""","v","a"']
