import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, score double, _n long, key string, taken long, component_id long, words string, guess int"
BASE = "The river ran past the old mill and over the stones into the quiet valley below the hills"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, and columns with clashing names."""
    rest = (7, 8, 0.5, 9, "k", 1, 2, "w", 0)
    rows = [
        (1, BASE, "en", "a", 10, *rest),
        (2, "", "en", "a", 0, *rest),
        (3, None, None, None, None, *[None] * 9),
        (4, " \t\n ", "en", "b", 4, *rest),
        (None, BASE + " today", None, None, 5, *rest),
        (5, BASE, "en", "b", 10, *rest),
        (5, BASE, "en", "b", 10, *rest),
        (6, "word " * 30_000 + "end", "en", "a", 1, *rest),
        (7, "éÀ \x1c ß x <|endoftext|> a|b 日本語 \x00 z", "fr", "c", 1, *rest),
        (8, BASE.upper(), "en", None, 1, *rest),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
