import random

import pytest
from helpers import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and extra columns with names the operators use."""
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000))
    common = "\n".join(" ".join(words(rng, 12)) for _ in range(8))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, common, None, "a", 1), (3, common, None, "a", 1), (4, common, "en", "b", 1), (5, long, "en", "a", 1), (6, long, "en", None, 1),
        (None, common, "en", "c", 1), (None, None, None, None, None), (7, "one", "en", "a", 3), (8, "a" * 3000, "en", "a", 3000), (9, "é😀\x00  " * 90, "xx", "a", 9), (3, "another text under the same id " * 9, "en", "a", 2), (10, " \n\t ", "en", "a", 4),
    ]
    extra = ["key", "n", "size", "home", "at", "label", "pii", "found", "gone", "places", "line", "version", "uid", "block", "round", "ids", "kept", "stats", "score", "first_doc", "n_words", "words", "root", "to"]
    schema = SCHEMA + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], schema)
