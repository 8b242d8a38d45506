import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = "word " * 30_000 + "the end"
    rows = [
        (1, "the cat sat on the mat and it was a good day for all of us to see", "en", "a", 5),
        (1, "the cat sat on the mat and it was a good day for all of us to see", "en", "a", 5),
        (2, "", "en", "a", 0),
        (3, None, "en", "b", None),
        (4, long, "en", "b", len(long)),
        (5, "le chat est sur la table et il est dans la maison avec les amis pour une fois", None, None, 9),
        (None, "le chat est sur la table et il est dans la maison avec les amis pour une fois", "fr", "b", 9),
        (6, "12 34 -- !!", "fr", "", 3),
        (7, " \t\n\r\x0b\x0c", "fr", "b", 6),
        (8, "漢字 かな 漢字 😀 é   x", "fr", "b", 6),
        (9, "the cat sat on the mat and it was a good day for all of us to see!", "en", "a", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS features", "'x' AS verdict", "2.5 AS language", "'y' AS fingerprint", "7 AS shard", "'z' AS unit", "doc_id AS encoding", "0 AS bucket")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
