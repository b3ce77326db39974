import tempfile

import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def shared(spark):
    """The tests' own shared folder; a cluster names its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="llm-"))
    return spark


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text, source) with nulls, empty and long texts, ties and repeated rows."""
    base = "Of the and heron with ined thon reat one two three four five six seven eight nine ten eleven twelve. "
    long = base * 400 + "é" * 300
    rows = [
        (1, base * 3, "b"), (2, base * 3, "a"), (3, (base * 3).replace("seven", "zeven", 1), None), (4, "", "a"), (5, None, "b"), (6, " \n\t ", "b"),
        (7, long, "c"), (7, long, "c"), (8, long + " tail", "c"), (9, "x" * 120, ""), (10, "x" * 49, None), (11, "x" * 50, "a"), (None, base * 3, "a"),
        (12, "one", "a"), (13, "one", "a"), (14, "日本語 text mit ümlaut\nand\nlines\nlines\n", "d"), (15, "other " * 60, None), (16, "a b c d e f " * 30, "d"),
    ]
    return [Row(doc_id=i, text=t, source=s) for i, t, s in rows]


@pytest.fixture(scope="session")
def frame(shared, odd_texts):
    """The odd texts with further columns whose names the operators use themselves."""
    schema = "doc_id long, text string, source string, rid long, label string, kept boolean, _found string, n_words int, size int, node long"
    return shared.createDataFrame([(*r, 5, "x", False, "y", 3, 4, 9) for r in odd_texts], schema)


@pytest.fixture(scope="session")
def empty(frame):
    return frame.where("doc_id < -1")
