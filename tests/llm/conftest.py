"""Awkward documents: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, part int, label int, cls int, salt int, score double"
LINE = "A long line of text that many of the documents have in common, word by word"
BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("word30", "other"), None, "b"),
    (4, None, "en", None),
    (5, "", None, "b"),
    (6, "  \t\n ", "en", "c"),
    (7, "12 34 %%", "en", ""),
    (8, "one", "en", "a"),
    (9, "Éa ñ\n" + LINE, "fr", "a"),
    (10, LINE + "\nb\n" + LINE.upper(), "en", "b"),
    (11, "x\n" + "  " + LINE + "\t", "en", "b"),
    (12, LINE, None, "c"),
    (13, "c\n\n" + LINE + "\n", "en", "c"),
    (14, "long " * 30_000, "en", "a"),
    (15, "one", "en", "a"),
    (15, "one", "en", "a"),
    (15, "another text of the same id", "de", "a"),
    (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "r", 1, 2, 3, 4, 0.5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
