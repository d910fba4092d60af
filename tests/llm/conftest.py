import pytest

#: Nulls, empty and blank texts, ties, repeated rows, other alphabets, and one text longer than most.
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the old barn today", "en", "b"),
    (2, "the quick  brown fox jumps over the lazy dog and runs far away from the old barn today", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n\r\x0b\x0c ", "fr", "a"),
    (6, "One", "en", "c"),
    (6, "One", "en", "c"),
    (7, "One two", None, "c"),
    (8, "été çà Straße 漢字 ﷽  x", "de", "a"),
    (9, "The quick brown fox jumps over the lazy dog and runs far away from the old barn today!", "en", None),
    (10, "word " * 9000 + "end", "en", "a"),
    (None, "One two", "en", "c"),
    (12, "▁ literal\x00null", "en", "a"),
    (13, "O ne", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark):
    """The edge cases with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    for name in ("n", "h", "size", "norm", "fp", "block", "shard", "segment", "uid", "copies", "kept", "score", "g", "c", "p"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
