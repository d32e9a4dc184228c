import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
CLEAN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river"
#: (doc_id, text, lang, source, n_chars): nulls in every column, empty, wordless, short and very long texts, ties, repeated rows.
ROWS = [
    (1, CLEAN, "en", "a", len(CLEAN)), (1, CLEAN, "en", "a", len(CLEAN)), (2, CLEAN, "en", "b", 1), (None, CLEAN, None, None, None),
    (3, None, "en", "a", None), (4, "", None, "a", 0), (5, " \n\t ... !", "fr", None, 9), (6, "one", "en", "b", 3),
    (7, LONG, "en", "c", len(LONG)), (8, "é\x01ü ñandú password=abcdefgh12 tail", "es", "b", 30), (None, None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHING = ("id", "rk", "node", "band", "score", "size", "target", "words", "h", "spans", "start", "_rk", "k1", "n", "s")


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select(
        "*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
