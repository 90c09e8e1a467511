import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text) as a documents table with extra columns whose names clash with internal ones."""
    def rows(*docs):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               *(T.StructField(c, T.StringType()) for c in ("lang", "source")), T.StructField("n_chars", T.LongType()),
                               *(T.StructField(c, T.StringType()) for c in ("k", "r", "th", "h", "u", "toxicity", "k_", "t", "n"))])
        data = [(d, t, "en", "s", len(t) if t is not None else None, *"krthutxyz") for d, t in docs]
        return spark.createDataFrame(data, schema).coalesce(2)
    return rows


ODD = [(1, None), (2, ""), (3, "   \n "), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, None),
       (5, "word " * 30_000), (6, "a b\nc d e f g\n" * 40), (7, "a b\nc d e f g\n" * 40), (8, "été 한국 <|endoftext|> x")]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return make(*ODD)
