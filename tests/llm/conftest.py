import pytest

#: Columns that have the names operators use for themselves.
CLASHES = "row string, digest string, shard int, slot int, score string, kept string, node string, length string, _t string, _text string, _id string, _c0 string, _k string, page string"

LONG = "word salad and more " * 6000
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "one two three four five six seven"), (6, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "null id text here is fine"), (7, LONG), (8, LONG), (9, "Ünïcödé 漢字 🙂 text"), (10, "!!! ??? 123"), (11, "\0\x01 control \x7f")]


@pytest.fixture(scope="session")
def edges(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", "src0", len(t or ""), *["x"] * 2, 1, 2, *["x"] * 10) for i, t in EDGES]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
