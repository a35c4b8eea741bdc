import random

import pytest

TEXTS = [None, "", " \n\t", "word", "café naïve “quoted” … 漢字 ​", "line one\nline one\nline two", "a" * 70_000, "<|startoftext|> don't STOP 12:30!", "\x00\x01 bytes", "x " * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, repeated and very long texts, null and repeated ids, and columns whose names clash with results."""
    rows = [(k, t, "en", "src1", 0, "clash") for k, t in enumerate(TEXTS)]
    rows += [(3, "word", "en", "src1", 0, "clash"), (None, "nobody's words", None, None, None, None), (2, "another text of that id", None, "src0", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def prose(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))
