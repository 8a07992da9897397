"""Language identification by compression.

Each language has a dictionary: raw content sampled from labelled texts. A text is compressed with zstandard
against each of them, and the language whose dictionary leaves the fewest bytes is the answer. The margin is
the share of bytes by which the best beats the second; below ``min_margin`` the answer is rejected.

Texts are lower-cased and runs of anything but letters become one space. Whole texts are compressed, in pieces
of ``PIECE`` bytes so that the dictionary counts throughout; short texts at a higher level that finds shorter
matches, and behind ``CARRIER`` bytes of the dictionary itself, whose own size is taken off: alone, a few words
would be stored as they are, whatever the dictionary.

Training: ``fit`` takes up to ``SAMPLES`` labelled texts of each language, chosen by a hash of the id, and
``WINDOW`` characters of each from a place that the hash names, up to ``DICTIONARY`` bytes a language. Both
bounds are parameters; they do not grow with the table.

Defined results: a null text, one without a letter, or any text when nothing is labelled: ``und``, score 0;
equal sizes go to the first language in the order of names, with margin 0. All columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table

SAMPLES, WINDOW, DICTIONARY = 1500, 400, 256 * 1024
PIECE, LEVEL, SHORT, SHORT_LEVEL, CARRIER = 4096, 9, 600, 19, 1000
MIN_MARGIN = 0.002
OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", samples: int = SAMPLES, window: int = WINDOW, size: int = DICTIONARY) -> dict[str, bytes]:
    """language -> dictionary content, from a bounded sample of the rows with a text and a lang."""
    rows = labelled.select(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return {}
    every = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], max(1, r["count"] // samples))))
    some = rows.filter(F.pmod("h", F.element_at(every, F.col("lang"))) == 0)
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - window, F.lit(1))).cast("int") + 1
    cut = some.select("lang", "h", F.substring(F.col("text"), start, F.lit(window)).alias("cut")).toPandas().sort_values(["lang", "h", "cut"])
    out = {}
    for name, part in cut.groupby("lang"):
        texts = list(dict.fromkeys(fold(x) for x in part["cut"]))
        out[name] = " ".join(x for x in texts if x).encode()[:size]
    return {k: v for k, v in sorted(out.items()) if len(v) >= 8}


class Classifier:
    def __init__(self, contents: dict[str, bytes]) -> None:
        self.langs = list(contents)
        self.long = [(name, self._compressor(c, LEVEL)) for name, c in contents.items()]
        self.short = []
        for name, c in contents.items():
            coder, carrier = self._compressor(c, SHORT_LEVEL), c[:CARRIER] + b" "
            self.short.append((name, coder, carrier, len(coder.compress(carrier))))

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and its margin."""
        folded = fold(text) if text else ""
        if not self.langs or not any(map(str.isalpha, folded)):  # signs such as ½ are no letters
            return "und", 0.0
        data = folded.encode("utf-8", "replace")
        if len(data) <= SHORT:
            sizes = sorted((max(1, len(c.compress(carrier + data)) - alone), name) for name, c, carrier, alone in self.short)
        else:
            pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            sizes = sorted((sum(len(c.compress(p)) for p in pieces), name) for name, c in self.long)
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], margin


def predict(docs: DataFrame, contents: dict[str, bytes], text: str = "text", out: str = "language") -> DataFrame:
    """docs with ``out``: struct(lang string, margin double)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # languages x DICTIONARY bytes

    @F.pandas_udf("lang string, margin double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([known(x) for x in texts], columns=["lang", "margin"])

    (name,) = fresh(docs, out)
    df = docs.withColumn(name, classify(F.col(text)))
    return df if name == out else df.withColumnRenamed(name, out)


def keep_known(docs: DataFrame, contents: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without those whose language is rejected: no letter, or a margin below min_margin."""
    (name,) = fresh(docs, "_language")
    df = predict(docs, contents, text, name)
    return df.filter((F.col(name)["lang"] != "und") & (F.col(name)["margin"] >= min_margin)).drop(name)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.filter(~F.coalesce(held_out(doc_id), F.lit(True)))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(training_rows(docs)))
    margin = F.col("language")["margin"]
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("language")["lang"].alias("lang_pred"), (margin / (margin + 0.02)).alias("score"),
        ((F.col("language")["lang"] != "und") & (margin >= MIN_MARGIN)).alias("accepted"),
    )
