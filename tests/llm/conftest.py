import pytest

MESSY = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick  brown fox\tjumps over the lazy dog", "en", "a"),
    (2, "the quick  brown fox\tjumps over the lazy dog", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \n ", "fr", "b"),
    (6, " ", None, None),
    (None, "le renard brun saute par-dessus le chien", "fr", "b"),
    (None, None, None, None),
    (7, "le renard brun saute par-dessus le chien", "fr", ""),
    (8, "password = hunter22hunter and É unicode 😀 token: 'abc'", None, "c"),
    (9, "word " * 60_000 + "end", "en", "c"),
    (10, "x" * 200_000, "en", "c"),
    (11, "word " * 60_000 + "end", "en", "c"),
    (12, "1234 5678 !!", "en", "c"),
    (-13, "one two", "en", "c"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, blank and very long texts, copies, a repeated row, names that operators use themselves."""
    rows = [(*r, -1, "x", True, 0.5, 7) for r in MESSY]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, sha string, kept boolean, score double, fp bigint")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture
def as_documents(tmp_path):
    """Write a DataFrame as the table documents and return its folder."""

    def write(df, name="documents"):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
