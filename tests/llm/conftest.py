import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of the smallest tables."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten"
    rows = [
        (1, None, None, 5), (2, "", "a", 5), (None, same, "a", None), (3, same, None, 1), (3, same, None, 1),
        (4, same, "b", 2), (5, same + " eleven", "b", 2), (6, "two words", "a", 0), (7, " \t\n ", "c", 0),
        (8, "A\nB\n" + same + "\n" + same, "c", 0), (9, long, "a", 0), (10, "ß é 漢字 \U0001f600 tab\tnew\x0bline", "a", 0),
        (None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for name in ("kept", "size", "n_words", "target", "token", "id", "n", "key", "component_id", "a.b", "spans", "rejected_by", "n_lines", "epochs", "_k", "_s", "_key", "_gone", "_d"):
        docs = docs.withColumn(name, docs["source"])
    return docs
