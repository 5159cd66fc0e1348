import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

LONG = "long " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "plain words make a small text of a dozen words or so here", "en", "a", 1, "x"),
        (1, "plain words make a small text of a dozen words or so here", "en", "a", 1, "x"),
        (2, "", None, None, None, None),
        (3, None, "en", None, 2, "y"),
        (None, "plain words make a small text of a dozen words or so here", "en", "a", 3, None),
        (5, LONG, "de", "b", 4, "z"),
        (6, " \t\n ", "de", "b", 5, "z"),
        (7, "write to me@site.org or +1 (017) 555-7713 now", "fr", "c", 6, "n"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label long, key string")
