"""Every stage of the pipeline keeps what it should and nothing else, on given documents and difficult rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import langid, mixing, sstable

from .test_methods import _classes, tokenizer

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "12345 !!! ½"), (None, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output as lists of rows."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id % 20 = 3")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    nameless = some.limit(3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("one of its own kind "), F.col("text")))
    docs.unionByName(some).unionByName(odd).unionByName(nameless).withColumns({"hit": F.lit("hit"), "_key": F.lit(1), "language": F.lit("x")}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    held, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < 4:
            assert sorted(out.columns) == sorted(now.columns)
            out.write.parquet(f"{folder}/{name}.parquet")
            out = spark.read.parquet(f"{folder}/{name}.parquet")
        held.append((name, now.collect(), out.collect()))
        now = out
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, held[-1][2]))
    return {name: (before, after) for name, before, after in held}


def rows(found):
    return collections.Counter((r["doc_id"], r["text"]) for r in found)


def test_language(spark, stages):
    before, after = stages["language_id"]
    some = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string")
    told = langid.predict(some, langid.fit(langid.training_rows(some)), out="p").collect()
    want = collections.Counter((r["doc_id"], r["text"]) for r in told if r["p"]["lang"] != "und" and r["p"]["margin"] >= langid.MIN_MARGIN)
    assert rows(after) == want and not {r["doc_id"] for r in after} & {9001, 9002, 9003, 9004}
    prose = [r for r in before if r["text"] and len(re.findall(r"[^\W\d_]", r["text"])) >= 200]
    kept = rows(after)
    assert sum((r["doc_id"], r["text"]) in kept for r in prose) >= 0.99 * len(prose)


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    texts = {i: r["text"] for i, r in enumerate(sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)))}
    ids = [r["doc_id"] for r in sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]
    label = _classes(texts)
    groups = collections.defaultdict(list)
    for i in texts:
        groups[label[i]].append(i)
    assert len(after) == len(groups) < len(before)
    kept = rows(after)
    for members in groups.values():
        assert sum(kept[ids[i], t] for i, t in {(m, texts[m]) for m in members}) >= 1
        known = [ids[m] for m in members if ids[m] is not None]
        if len(known) == len(members):
            assert any(d == min(known) for d, _ in ((ids[m], 0) for m in members if kept[ids[m], texts[m]]))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_contamination(spark, stages):
    before, after = stages["decontaminate"]
    grams = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r["text"])] if w for i in range(max(1, len(w) - 12))}

    def clean(t):
        w, hit = words(t), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
        return not hit or 20 * len(hit) < len(w)

    assert rows(after) == collections.Counter((r["doc_id"], r["text"]) for r in before if clean(r["text"])) and len(after) < len(before)


def test_mix(spark, stages):
    before, after = stages["mix_sources"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, taken = collections.Counter(), collections.Counter()
    for r in before:
        own[r["source"]] += size(r["text"])
    for r in after:
        taken[r["source"]] += size(r["text"])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    total, left, target = sum(own.values()), dict(weights), {}
    room = total
    while left:  # targets stop at three times the source, the excess is shared again
        share = {s: room * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 3 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * own[s]
            room -= target[s]
            del left[s]
    longest = max(size(r["text"]) for r in before)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + longest for s in own)
    count = rows(before)
    assert all(n <= 3 * count[k] for k, n in rows(after).items()) and set(rows(after)) <= set(count)
    assert sum(mixing.MOST * size(r["text"]) for r in before) >= sum(taken.values())


def test_tokens(stages):
    before, after = stages["token_shards"]
    encoder = tokenizer()
    ids = {t: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for t in {r["text"] for r in before}}
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in after) == collections.Counter((r["doc_id"], ids[r["text"]]) for r in before)
    at = 0
    for r in sorted(after, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert sstable.END_ID == 0


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
