import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row["doc_id"]: (row["text"] or "").encode() for row in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must survive: nulls, empty, blank, very long, repeated rows, columns with clashing names."""
    rows = [
        (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "a", "en"), (None, "no id here at all", "fr"),
        (5, "the same words " * 20_000, "en"), (6, "x" * 300_000, "de"), (7, "the cat and the dog", "en"),
        (7, "the cat and the dog", "en"), (8, "12 34 !!", "en"), (9, "é ß ñ € 　 ｗｉｄｅ", "fr"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.selectExpr("*", "'x' AS score", "1 AS words", "2 AS fp", "3 AS rank", "4 AS block", "5 AS body")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
