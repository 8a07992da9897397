"""Mixing: the join path, equal rows, a solve that is given too few steps."""

import random

import pytest

from spanloom.llm import mixing


def docs(spark, n=400):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return spark.createDataFrame(rows + rows[:50] + [(None, "x y", "b")] * 3, "doc_id long, text string, source string")


def test_both_paths_agree(spark):
    df = docs(spark)
    one, two = (sorted(map(str, mixing.mix(df, **o).collect())) for o in ({}, {"max_broadcast": 0}))
    assert one == two and len(one) == df.count()


def test_too_few_steps_are_told(spark, monkeypatch):
    real = mixing.solve
    monkeypatch.setattr(mixing, "solve", lambda h, s, most=mixing.MOST: real(h, s, most, 1))
    with pytest.raises(RuntimeError, match="miss their targets"):
        mixing.mix(docs(spark)).count()
