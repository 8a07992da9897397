"""Small tables of difficult rows."""

LONG = "word and another one " * 5000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 3),
    (4, "  \t\n ", "en", "b", 3),
    (5, LONG, "en", "a", 5),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 6),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 6),
    (None, "a text without an id, with a few words of its own", "en", None, 7),
    (7, "ünïcödé 漢字 \U0001f600 naïve café", "fr", "c", 8),
    (8, "12345 !!! ---", "de", "c", 8),
    (9, "one", "de", "c", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for working columns or results.
CLASHES = "_scan hit _hit row key _key _kinds _whole spans size target mix _size _bin _salt _u language count licenses bits next _bucket _first _k _h1 _h2 _n _row _W".split()


def docs(spark, extra=True):
    df = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHES}) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
