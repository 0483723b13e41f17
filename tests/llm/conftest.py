import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    """Documents of the smallest tables' rows."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 3, "x", 1.0),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 3, "x", 1.0),
        (2, None, None, None, None, None, None),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg.", "de", "b", 5, "y", 2.0),
        (4, "", "en", "a", 0, "", 0.0),
        (5, " \t\n ", "en", None, 4, "z", None),
        (6, "word " * 60_000, "en", "a", 300_000, "w", 1.0),
        (7, "▁ \U0001f40d\x00 mixed é\n\n", None, "c", 9, "v", 1.0),
        (8, "12 34 !!", "fr", "c", 8, "u", 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp double")
