import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def word_model():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) pairs, with the other columns of the table."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)

    return make


ODD = [
    (1, None), (2, ""), (3, " "), (4, "word"), (5, "word"), (None, "no id here at all"), (6, "x" * 20_000), (7, "The cat — sat\ton the mat.\n" * 300),
    (7, "The cat — sat\ton the mat.\n" * 300), (8, "日本語 😀 ﬁ é́ <|endoftext|> <s></s>"), (9, "\x00\x01 ▁▁ token"),
]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, repeated rows, unusual characters."""
    return ODD
