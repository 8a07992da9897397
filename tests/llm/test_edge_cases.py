"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest

from spanloom.llm import decontaminate, fingerprint, htmltext, langid, licenses, mixing, neardup, secret_scan, sstable, wordpiece
from spanloom.llm.common import new_folder

from .edge import CLASHES, ROWS, docs, empty


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (4, "café")], "item_id long, text string")


def kept(out, n=len(ROWS)):
    rows = out.collect()
    assert len(rows) == n and all(r[c] == c for r in rows for c in CLASHES)
    return rows


def test_decontaminate(spark, bench):
    rows = kept(decontaminate.decontaminate(docs(spark), bench, mode="flag"))
    hit = {r["doc_id"]: r["n_hit"] for r in rows}
    assert hit[1] == 13 and hit[6] == 13 and hit[7] == 1 and hit[2] == hit[3] == hit[5] == 0
    kept(decontaminate.decontaminate(docs(spark), bench), len(ROWS) - 4)
    spans = {r["doc_id"]: r["text"] for r in kept(decontaminate.decontaminate(docs(spark), bench, mode="spans"))}
    assert spans[1] == "The " and spans[2] is None and spans[9] == "one"
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(docs(spark), bench.limit(0)).count() == len(ROWS)


def test_decontaminate_join_path(spark, bench):
    some = docs(spark, extra=False)
    a = decontaminate.report(some, bench).toPandas()
    b = decontaminate.report(some, bench, max_broadcast=0).toPandas()
    cut = lambda p: sorted(map(str, p.itertuples(index=False)))
    assert cut(a) == cut(b)


def test_decontaminate_word_does_not_depend_on_what_follows(spark):
    """Lower case of a capital sigma before a full stop and a letter is another than before a space."""
    some = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒ"), (2, "οδος αβ")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "ΟΔΟΣ ΑΒ")], "item_id long, text string")
    for options in ({}, {"max_broadcast": 0}):
        assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(some, item, **options).collect()} == {1: 2, 2: 0}


def test_secrets(spark):
    rows = kept(secret_scan.scan(docs(spark), out="secrets"))
    assert all(r["secrets"] == [] for r in rows)
    assert secret_scan.scan(empty(spark)).count() == 0


def test_mix(spark):
    rows = kept(mixing.mix(docs(spark), out="mixture"))
    for r in rows:
        assert 0 <= r["mixture"]["taken"] <= 3 * r["mixture"]["size"]
    assert {r["doc_id"]: r["mixture"]["size"] for r in rows}[2] == 0
    assert mixing.mix(empty(spark)).count() == 0
    assert set(mixing.mixed(docs(spark)).columns) == set(docs(spark).columns)


def test_fingerprint(spark):
    df = docs(spark).withColumn("fp", fingerprint.fingerprint("text"))
    rows = kept(df)
    by = {r["doc_id"]: r["fp"] for r in rows}
    assert by[2] == by[3] == by[4] == [] and by[1] == by[6] and len(by[5]) == fingerprint.BINS
    kept(fingerprint.with_next(docs(spark), "doc_id", "text", "following"))
    assert fingerprint.with_next(empty(spark), "doc_id", "text", "following").count() == 0


def test_language(spark):
    known = langid.fit(docs(spark))
    rows = {r["doc_id"]: r["found"] for r in kept(langid.predict(docs(spark), known, out="found"))}
    assert rows[2]["lang"] == rows[3]["lang"] == rows[8]["lang"] == "und"
    assert langid.fit(empty(spark)) == {}
    assert {r["language"]["lang"] for r in langid.predict(docs(spark, False), {}).collect()} == {"und"}
    assert "language" in langid.keep_known(docs(spark), known).columns


def test_near_duplicates(spark):
    found = neardup.classes(docs(spark))
    of = {(r["doc_id"], r["h1"]): r["class_id"] for r in found.collect()}
    assert found.count() == len(ROWS)
    label = {d: c for (d, _), c in of.items()}
    assert label[1] == label[6] == 1 and label[2] == label[3] == 2 and label[4] != label[3]
    out = neardup.keep_one(docs(spark))
    assert set(out.columns) == set(docs(spark).columns)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "2", "4", "5", "None", "7", "8", "9"])
    assert neardup.keep_one(empty(spark)).count() == 0


def test_shards(spark):
    made = sstable.write_shards(docs(spark), new_folder(spark, "tokens"), shards=3)
    rows = sstable.read_documents(spark, made, values=True).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert next(r["ids"] for r in rows if r["doc_id"] == 2) == [0]
    found = sstable.look_up(made, [6, 99, None]).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["6", "6", "None"]
    assert sstable.read_documents(spark, sstable.write_shards(empty(spark), new_folder(spark, "tokens"))).count() == 0


def test_token_counts(spark):
    rows = {r["doc_id"]: r["tokens"] for r in kept(wordpiece.count_tokens(docs(spark), out="tokens"))}
    assert tuple(rows[2]) == tuple(rows[4]) == (0, 0, 0) and rows[5]["n_words"] == 20000
    assert wordpiece.count_tokens(empty(spark)).count() == 0


def test_licenses(spark):
    assert all(r["found"] == [] for r in kept(licenses.scan(docs(spark), out="found")))
    assert licenses.scan(empty(spark)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain text only"), (4, "<p>never closed <!-- <p>hidden"), (5, "<script>var a='<p>x</p>'"), (6, "<div>" * 3000 + "x")], "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert out[1] == out[2] == out[5] == "" and len(out) == 6
    assert htmltext.extract(pages.limit(0)).count() == 0
