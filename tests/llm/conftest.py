import pytest

WORDS = "river stone light garden winter letter silver narrow market window simple forest bridge summer yellow travel morning answer circle island".split()


def sentence(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with every odd case: nulls in each column, empty and blank texts, a very long one, ties, repeated rows."""
    long = sentence(1, 40_000)
    return [
        (1, sentence(10, 30), "en", "a", 1), (2, sentence(10, 30), "en", "a", 1), (2, sentence(10, 30), "en", "a", 1), (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " \t\n ", "de", None, 3), (6, long, "en", None, len(long)),
        (None, sentence(11, 25), "fr", "c", None), (None, None, None, None, None), (7, "Öl ünd ß 漢字 😀 " + sentence(12, 20), "de", "a", 9), (8, "one two", "en", "d", 7), (9, "12345 ...", "en", "d", 9), (-3, sentence(13, 50), "en", "", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """With columns whose names clash with those that operators make or use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(edge_rows, schema)
    from pyspark.sql import functions as F

    for name in ("score", "size", "target", "id", "key", "part", "n", "start", "length", "rank", "_rank", "comp", "accepted", "taken", "kept", "n_email"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
