import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"
PROSE = "the river bends past an old mill where farmers bring grain in autumn and children swim in summer while the miller counts sacks and writes names in a ledger that nobody reads anymore because the ink has faded and every page smells of flour and dust from long ago"
#: Every column a query does not need, under names that operators might use themselves.
EXTRA = "row string, fp long, mask long, pattern long, rank long, count long, m string, words string, line string, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"{w}{k % 97}" for k in range(400) for w in PROSE.split()[:20])
    rows = [
        (1, None, "en", "web"),
        (2, "", None, None),
        (3, " \t\n \r\n", "en", None),
        (4, "a", "en", "web"),
        (5, PROSE, "en", "web"),
        (6, PROSE, "en", "web"),
        (7, PROSE.upper(), "en", "web"),
        (8, long, "de", "news"),
        (9, long + " end", "de", "news"),
        (10, "Ünïcode spaces and naïve words,   kept as they are", "fr", "web"),
        (11, f"{PROSE}\n{PROSE}\n{PROSE} today", "en", "web"),
        (12, "one two three\n" * 40, "en", "web"),
        (13, "a|b|c <d> #e $f %g &h *i\n" + PROSE, None, "web"),
    ]
    return [*rows, rows[4]]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(i, t, a, b, len(t or ""), *["x", 1, 2, 3, 4, 5, "m", "w", "l", "k"]) for i, t, a, b in edge_rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
