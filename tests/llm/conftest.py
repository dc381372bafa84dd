import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    return DATA


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "a", 0.5), (1, base, "a", 0.5), (2, base.upper(), "b", None), (3, None, None, None), (4, "", "x", 1.0), (5, " \n\t ", "x", 1.0),
        (6, "word", "x", 1.0), (7, ("lorem ipsum dolor " * 9000) + base, "y", 0.0), (None, base + " thirteen", "n", 0.1), (8, "é日本 😀 " * 30, "u", 2.0), (3, "again the same id but another text here", "z", 0.0),
        (9, "x" * 70_000, "w", 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, key double").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
