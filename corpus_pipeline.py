"""A training-data pipeline over ``documents``; its stages are operators of spanloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return
the columns of documents; the last writes token shards and returns what it reads back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, langid, mixing, neardup, sstable
from spanloom.llm.common import new_folder, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or two languages as good as equal."""
    return langid.keep_known(docs, langid.fit(langid.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each class of near-duplicates."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a 20th or more of the words lies in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words meet their targets."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sorted-string-table shards; what the shards hold, as read back."""
    return sstable.read_documents(spark, sstable.write_shards(docs, new_folder(spark, "tokens")))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_shards", write_tokens),
]

#: The stages compress, hash and tokenize, which SQL cannot express: a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents: doc_id, start, n_tokens, ids_crc32 of the mix, in order of doc_id.

    Null and letterless texts go in the first stage; of repeated rows and copies one stays; null ids are kept and come
    first; extra columns are carried to the last stage; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with scratch(spark, f"{name}-work"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
