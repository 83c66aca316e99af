import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " tail", None, "b", None),
        (4, "", "en", "b", 0),
        (5, None, "de", None, None),
        (6, " \t\n ", "de", "c", 3),
        (7, LONG, "en", "c", 9),
        (None, "no id has this text at all", None, None, None),
        (8, "one two", "fr", "a", 7),
        (9, "ONE two", "fr", "d", 7),
        (10, "Mail an.b@c.org or +1 (974) 555-3436, card 4929348385146306!", "en", "a", 2),
        (11, "12345 %% 678", None, "a", 2),
    ]
    schema = "doc_id long, text string, lang string, source string, size long"
    return spark.createDataFrame(rows, schema).selectExpr("*", "0 as n", "'x' as id", "0 as sid", "0 as shard", "0 as row", "'k' as host", "'p' as path")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
