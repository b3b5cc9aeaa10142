import pytest

TEXTS = {
    "null": None, "empty": "", "blank": " \n ", "word": "That it.", "symbols": "!!! --- ###\n%%%", "long": "the quick brown fox jumps over it. " * 8000, "accents": "Été où l'âme naïve rêve — 漢字 🙂\n\nfin ",
    "spaces": "  two  spaces   three \n\n a ", "nul": "a\0b c",
}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns whose names operators use."""
    rows = [(i, t, None if i % 3 == 0 else "en", "s" if i % 2 else None, 9, "x") for i, t in enumerate(TEXTS.values())]
    rows += [rows[3], rows[3], (100, TEXTS["word"], "en", "s", 9, "x"), (None, "no id here at all now", "en", "s", 9, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score int, shard string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
