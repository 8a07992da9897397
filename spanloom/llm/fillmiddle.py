"""Fill-in-the-middle transformation of whole texts, by lines, with DuckDB inside mapInArrow.

Each Arrow batch is registered with an in-process DuckDB connection, which cuts texts into lines, draws the cuts and the
form from the SHA-256 of seed and id, and hands Arrow back; no row passes through Python. A worker has one connection
with one thread and a bounded memory that may spill to the worker's own disk; nothing outlives a batch. A text costs its own
length, and batches are bounded in bytes, so no key, source or group of copies meets another row.

``transform`` gives the texts, ``restore`` rebuilds the originals from text and form alone.

Defined results: a null text is empty, and an empty text is plain, with no lines; a null id draws as the empty string; a
text that holds one of the marks is plain, so that marks can be found again; repeated rows are transformed alike; an
empty table gives no rows; all columns are kept but those that have a new column's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

SEED, RATE, SUFFIX_FIRST = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Columns id and t to n, form, prefix_chars, middle_chars, output.
CUT = rf"""
drawn AS (SELECT *, sha256('{{seed}}:' || coalesce(CAST(id AS VARCHAR), '')) h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') units FROM given),
numbers AS (SELECT *, CAST(len(units) AS BIGINT) n, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) h{i + 1}" for i in range(4))} FROM drawn),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) lo, greatest(h1 % (n + 1), h2 % (n + 1)) hi,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {{rate}} THEN 'plain' WHEN h4 % 100 < {{suffix_first}} THEN 'spm' ELSE 'psm' END form FROM numbers),
parts AS (SELECT *, coalesce(array_to_string(list_slice(units, 1, lo), ''), '') p, coalesce(array_to_string(list_slice(units, lo + 1, hi), ''), '') m, coalesce(array_to_string(list_slice(units, hi + 1, n), ''), '') s FROM formed),
made AS (SELECT *, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS "output" FROM parts)"""

#: Columns form and o to t.
REBUILT = f"""CASE form WHEN 'plain' THEN o
  WHEN 'psm' THEN substr(split_part(o, '{SUFFIX}', 1), {len(PREFIX) + 1}) || split_part(o, '{MIDDLE}', 2) || split_part(split_part(o, '{SUFFIX}', 2), '{MIDDLE}', 1)
  ELSE split_part(split_part(o, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(o, '{MIDDLE}', 2) || substr(split_part(o, '{PREFIX}', 1), {len(SUFFIX) + 1}) END"""


@lru_cache(1)
def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": True})


def _by_duckdb(df: DataFrame, query: str, given: dict[str, str], added: dict[str, str]) -> DataFrame:
    """df with the ``added`` columns (name: type), in place of those of df whose names clash with them. query makes
    these, in order, of the table ``batch``, whose columns are ``given`` (name there: column of df)."""
    bounded_batches(df.sparkSession)
    taken = {n.lower() for n in added}
    kept = [f for f in df.schema if f.name.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for b in batches:
            con.register("batch", pa.table({name: b[c] for name, c in given.items()}))
            got = con.sql(query).to_arrow_table().combine_chunks()
            con.unregister("batch")
            new = [got[n].combine_chunks() for n in added]
            yield pa.record_batch([*(b[f.name] for f in kept), *new], names=[*(f.name for f in kept), *added])

    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in added.items())).fields])
    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output. ``rate`` of
    100 texts are transformed, ``suffix_first`` of 100 of these as spm."""
    added = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    cut = CUT.format(seed=seed, rate=rate, suffix_first=suffix_first)
    query = f"WITH given AS (SELECT id, coalesce(t, '') t FROM batch), {cut} SELECT {', '.join(f'"{n}"' for n in added)} FROM made"
    return _by_duckdb(docs, query, {"id": doc_id, "t": text}, added)


def restore(made: DataFrame, form: str = "form", output: str = "output", out: str = "restored") -> DataFrame:
    """made with the text rebuilt from form and output."""
    return _by_duckdb(made, f'SELECT {REBUILT} "{out}" FROM batch', {"form": form, "o": output}, {out: "string"})


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sha = lambda c: F.sha2(F.col(c), 256)
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


SQL = (
    "WITH given AS (SELECT doc_id id, coalesce(text, '') t FROM documents), "
    + CUT.format(seed=SEED, rate=RATE, suffix_first=SUFFIX_FIRST)
    + f', o AS (SELECT id, n, form, prefix_chars, middle_chars, "output" o FROM made) SELECT id doc_id, n, form, prefix_chars, middle_chars, sha256(o) output_sha256, sha256({REBUILT}) restored_sha256 FROM o'
)
