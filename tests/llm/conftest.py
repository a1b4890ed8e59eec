import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and long texts, odd spacing, ties and repeats."""
    return [
        None, "", " ", "  ", "\n", "a  b", "a \n b", "a\n  b", "a   b  ", "x \t\ny", "don't  stop it's 12 34",
        "<|endoftext|> a<|endoftext|>", "É ñ 漢字 🎉 " * 5, "w" * 3000, "ab " * 4000, "a", "a", "Zeile\r\nzwei  \n drei",
    ]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None):
        """Rows with extra columns whose names clash with results."""
        rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, f"src{i % 3}", None, 7, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string")

    return make
