import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_place` string, held_out string, Score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, ties, repeated rows and clashing extra columns."""
    long = "the of and word, " * 30_000
    rows = [
        (1, "The cat and the dog of the house.\nThe cat and the dog of the house.", "en", "a", 5, "x", "y", 0.5),
        (1, "The cat and the dog of the house.\nThe cat and the dog of the house.", "en", "a", 5, "x", "y", 0.5),
        (2, "le chat et la maison de la rue", "fr", "a", 5, None, None, None),
        (3, None, "en", "b", None, None, None, None),
        (4, "", None, None, 0, None, None, None),
        (5, " \n\t ", "fr", "b", 3, None, None, None),
        (None, "le chat et la maison de la rue", "fr", None, 3, None, None, None),
        (6, "12 34 !! <|endoftext|> é́ \x1c 日本", None, "b", 3, None, None, None),
        (7, long, "en", "a", len(long), None, None, None),
        (8, "le chat et la maison de la rue", "fr", "c", 3, None, None, None),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
