import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, letters of many kinds, extra columns that clash."""
    rng = random.Random(5)
    texts = ["", None, " ", "one", "Two WORDS", "a\x00b \x0b c", "Ünï ÇÖDE日本 ſK", "x" * 5000, prose(rng, 30000), prose(rng, 300)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(10 + i, prose(rng, rng.randrange(1, 200)), None, None, None) for i in range(30)]
    rows += [(9, texts[9], "en", "s", 5), (None, "no id here", "fr", "s", 3), (None, None, None, None, None), (9, texts[9], "en", "s", 5)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "key", "part", "start", "n", "count", "text_", "component", "words", "bucket"):
        df = df.withColumn(name, df.doc_id)
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
