import pytest

#: Rows that every operator has to survive: null, empty and blank texts, ties, repeated rows, null ids.
ODD_TEXTS = [None, "", " \t\n\x0b\f\r ", "a", "a b", "word " * 30000, "x" * 200000, "é ß 漢字 😀   nbsp", "\n\n\n"]


@pytest.fixture()
def odd_docs(spark):
    rows = [(i, t, "en", "s", 0, 7, "row", "w") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "a", "en", "s", 0, 7, "row", "w"), (None, "a null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, h string")
