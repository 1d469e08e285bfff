import pytest

ODD_TEXTS = [
    None, "", " \t\n", "a", "Short text.", "The same words stand here again and again for a while.", "The same words stand here again and again for a while.",
    "ünïcödé wörds über ällés, señor! 😀 été", "12345 67890 !!! ???", "word " * 20_000, "x" * 50_000, "line one\n\nline three\nline four\n", "\u0000control   separators",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents: nulls, empties, long texts, repeated rows, a null id, columns whose names the operators use."""
    rows = [(i, t, ("en", "fr", None)[i % 3], None if i % 4 == 0 else f"s{i % 2}", i, 1.0, "x", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "A row without an id has words too.", "en", "s1", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_words int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < -1")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
