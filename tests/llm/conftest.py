import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and a column whose name operators use inside."""
    long = " ".join(f"word{i % 977} again" for i in range(20_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog today", "en", "a", 50), (2, None, None, None, None), (3, "", "fr", "b", 0), (4, long, "en", "a", len(long)), (5, "the quick brown fox jumps over the lazy dog today", "en", "a", 50),
            (5, "the quick brown fox jumps over the lazy dog today", "en", "a", 50), (None, "no id 😀 <|endoftext|> x", "en", "a", 7), (7, "  \t\n ", "en", "a", 5), (8, "x" * 5000, "en", "b", 5000), (9, "é漢字 it's 'll 12345 mail a@b.example.com", "de", "c", 40)]
    made = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id string")
    return made


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
