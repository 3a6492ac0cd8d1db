import pytest

ROWS = [
    (5, None, "en", "a", 1),
    (6, "", "en", "a", 2),
    (7, "the cat sat on the mat and then the dog sat on the log near the old mill", "en", "b", 3),
    (8, "the cat sat on the mat and then the dog sat on the log near the old mill", "en", None, 4),
    (9, "the cat sat on the mat and then the dog sat on the log near the old barn", None, "b", 5),
    (10, "<|endoftext|> 12 ½ it's  \n\n tab\tend 😀 中文 é e\u0301", "fr", "b", 6),
    (11, "one two", "en", "b", 7),
    (12, "!!! ??? 123", "en", "b", 8),
    (13, "word " * 30000, "en", "b", 9),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, and columns whose names operators use themselves."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, score int").withColumnRenamed("score", "n")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n int")
