import duckdb
import pytest

TABLES = "documents pages benchmark labels embeddings".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


@pytest.fixture(scope="session")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="session")
def long_text():
    return "\n".join(f"word{i % 701} and {i} more things" for i in range(8000))


@pytest.fixture(scope="session")
def odd(spark, long_text):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a clashing name."""
    rows = [
        (1, "one two three four five\nsix seven eight\nnine ten eleven", "en", "a", 10),
        (1, "one two three four five\nsix seven eight\nnine ten eleven", "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, "de", "b", None),
        (None, "no id but words and an é in it", None, None, 4),
        (None, "no id but words and an é in it", None, None, 4),
        (4, " \t\n\x0b\x0c\r ", "fr", None, 7),
        (5, long_text, "en", "a", 1),
        (6, long_text, None, "b", 1),
        (7, "a", "es", "c", 1),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    extra = "row size text_key words start line fp place rank stratum shard window at".split()
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(extra)))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
