"""Prefix trie: the SQL on given tables, a plain trie on difficult rows, blocks and deep chains."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.llm import conversations

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, group=20, most=4):
    """The nodes by dictionaries; rows of one conversation have turns of their own numbers, or equal content."""
    turns = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k in members:
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ids = ",".join(map(str, sorted(ends.get(k, []))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children.get(k, [])), sum(x not in children for x in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(str, out))


def run(spark, rows, **options):
    return sorted(str(tuple(r)) for r in conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA), **options).collect())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = conversations.op13_prefix_trie(spark, SF)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(f'SELECT {", ".join(f'"{c}"' for c in df.columns)} FROM ({conversations.SQL})').fetchall()))


ROWS = (
    [(c, t, "user", f"shared {t}") for c in range(20, 40) for t in range(4)]
    + [(c, t, "a" if t % 2 else None, None if t == 2 else f"x {c % 3} {t}") for c in range(40, 52) for t in range(c - 38)]
    + [(61, 0, "u", "no base here"), (62, 0, "u", "a\x0bb c"), (None, 0, "u", "nobody"), (-5, 0, "u", "below"), (-20, 0, "u", "below"), (0, None, "u", "first"), (0, 0, "u", "second")]
    + [(c, t, "u", "same") for c in (101, 102, 103) for t in range(5)]
    + [(7, 1, "r", "tie"), (7, 1, "r", "tie"), (8, 1, "ab", "c"), (9, 1, "a", "bc")]
)


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_against_plain_version(spark, block):
    assert run(spark, ROWS, block=block) == plain(ROWS)


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y z", ""])) for c in range(120) for t in range(rng.randint(0, 7))]
    assert run(spark, rows, block=6) == plain(rows)


def test_a_long_conversation_takes_few_rounds(spark, monkeypatch):
    """Two of 3,000 turns that part late, and one hot id: rounds follow branches, not turns."""
    rows = [(20, t, "u", "same" if t != 2990 else "a") for t in range(3000)] + [(40, t, "u", "same" if t != 2990 else "b") for t in range(3000)] + [(60, 0, "u", "same")]
    rounds, real = [], conversations.materialize
    monkeypatch.setattr(conversations, "materialize", lambda df, tag: (rounds.append(tag), real(df, tag))[1])
    got = conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA), block=500).collect()
    assert rounds.count("open") <= 4
    by = {(r["conv_id"], r["depth"]): r for r in got}
    assert len(got) == 1 + 2990 + 2 * 10 and by[20, 0]["n_leaves"] == 2 and by[20, 2990]["n_children"] == 2 and by[40, 2991]["parent_conv_id"] == 20
    assert by[20, 0]["saved_tokens"] == 2990 + 1 and by[20, 1]["ends_sha256"] == hashlib.sha256(b"60").hexdigest()


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.prefix_trie(none).count() == 0
    assert run(spark, [(None, 1, "u", "x")]) == []
    more = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("rank", "block", "words", "a", "b", "_row", "part", "depth", "k1")})
    assert sorted(str(tuple(r)) for r in conversations.prefix_trie(more).collect()) == plain(ROWS)
