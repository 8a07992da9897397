"""Costs that grow with a text's length, and results that do not depend on the path taken."""

import random
import re
import time

from spanloom.llm import decontaminate, secret_scan


def test_token_rule_is_linear(spark):
    part = "abcdefghij_-"
    texts = ["eyJ" * 100_000, f"x eyJ{part}.{part}.s y", f"eyJeyJ{part}.{part}.sig.eyJ{part}.{part}.t", "eyJshort.abcdefghijk.x", f"eyJ{part}.short.x eyJ{part}.{part}.", f"eyJ{part}.{part}.a-eyJ{part}.{part}.b", ("eyJ" + "a" * 40 + "!") * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "jwt"] for r in secret_scan.scan(df).collect()}
    assert time.time() - began < 60
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+")
    assert got == {i: [m.span() for m in plain.finditer(t)] if i else [] for i, t in enumerate(texts)}
    assert any(r == [["eyj"]] for r in secret_scan.trigram_query(next(r.pattern for r in secret_scan.RULES if r.kind == "jwt")))


def test_spans_of_a_long_text(spark):
    rng = random.Random(1)
    item = [f"w{rng.randint(0, 999)}" for _ in range(40)]
    words = []
    for _ in range(6000):
        words += item if rng.random() < 0.5 else [f"v{rng.randint(0, 999)}" for _ in range(20)]
    df = spark.createDataFrame([(1, "; ".join(words)), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for options in ({}, {"max_broadcast": 0}):
        began = time.time()
        out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, mode="spans", **options).collect()}
        assert time.time() - began < 60
        assert out[1].split("; ") == [w for w in words if w[0] == "v"] + ([""] if words[-1][0] == "w" else []) and out[2] == ""


def test_both_paths_agree(spark):
    """Windows of several items, short items, copies and null ids; rows that a shuffle has dealt."""
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 13, 14, 20])))) for i in range(12)] + [(20, None)]
    docs = [(rng.choice([None, 1, 2, 3]), " ".join(word() for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    docs += [(7, docs[0][1])] * 30 + [(8, f"x {items[k][1]} y, {items[k][1].upper()}") for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, two = (sorted(map(str, decontaminate.report(df, bench, **o).collect())) for o in ({}, {"max_broadcast": 0}))
    assert one == two and len(one) == len(docs)
    for mode in ("spans", "flag", "documents"):
        one, two = (sorted(map(str, decontaminate.decontaminate(df, bench, mode=mode, **o).collect())) for o in ({}, {"max_broadcast": 0}))
        assert one == two
