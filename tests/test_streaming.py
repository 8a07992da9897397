"""A replay of files in any cut and order equals the batch; a restart goes on from the checkpoint; late rows are left out."""

import datetime
import random

import pytest

from spanloom.operators import folds
from spanloom.streaming.sentences import stream_sentences

SCHEMA = "rec_id long, seg_id long, start_ms long, end_ms long, text string, speaker string, target boolean, first_ms long, first_n long, last_ms long, last_n long, ts timestamp"
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for rec in (1, 2, 3):
        at = 0
        for seg in range(40):
            at += rng.choice([0, 100, 130, 190, 260, 600])
            end = at + rng.choice([300, 1500])
            text = rng.choice(["短", "今天天氣好", "今天天氣很好，", "好。", "TAKE 1", "こんにちは", "", None])
            out.append((rec, seg, at, end, text, rng.choice(["A", "A", "A", "B", None]), rng.choice([True, True, True, False]), rng.choice([0, 1300]), 2, rng.choice([100, 900]), 2, ZERO + datetime.timedelta(milliseconds=end)))
            at = end
    return out


END = (9, 0, 0, 1, "end", None, None, 0, 1, 0, 1, ZERO + datetime.timedelta(days=1))


def feed(spark, folder, batches, start=0):
    for i, b in enumerate(batches, start):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i:03d}")


def run(spark, folder, out, check):
    df = stream_sentences(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder), idle_ms=5_000)
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert not query.isActive and query.exception() is None


def read(spark, out):
    return sorted(tuple(r) for r in spark.read.schema(folds.SENTENCE).parquet(out).filter("rec_id <> 9").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_batch(spark, rows, tmp_path, seed):
    want = sorted(tuple(r) for r in folds.sentences(spark.createDataFrame(rows, SCHEMA)).collect())
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[-1].timestamp() + rng.uniform(0, 9))  # within the delay of ten seconds
    cuts = sorted(rng.sample(range(1, len(late)), 5))
    batches = [late[a:b] for a, b in zip([0, *cuts], [*cuts, len(late)], strict=True)] + [[END]]
    feed(spark, f"{tmp_path}/in", batches[:3])
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    feed(spark, f"{tmp_path}/in", batches[3:], 3)
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")  # goes on from the checkpoint
    assert read(spark, f"{tmp_path}/out") == want


def test_a_late_row_is_left_out(spark, rows, tmp_path):
    mine = [r for r in rows if r[0] == 1]
    late, rest = mine[5], mine[:5] + mine[6:]
    feed(spark, f"{tmp_path}/in", [rest, [END], [late], [(*END[:-1], END[-1] + datetime.timedelta(days=1))]])
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    assert read(spark, f"{tmp_path}/out") == sorted(tuple(r) for r in folds.sentences(spark.createDataFrame(rest, SCHEMA)).collect())
