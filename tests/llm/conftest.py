from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _row string, key string, target double, rank int, _gone string"

#: Null and blank texts, null ids and sources, repeated rows, one very long text, and columns whose names clash.
ODD = [
    (1, "Plain words of a first text. " * 5, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", "en", "b", 5),
    (5, "one", "en", "b", 3),
    (5, "one", "en", "b", 3),
    (None, "a row without an id has words too", "en", "c", 30),
    (7, "x" * 3000 + " éü 😀 中文    end", "de", "c", 3000),
    (8, " ".join(f"w{i % 700}é" for i in range(30_000)), "fr", "a", 200_000),
    (9, "Plain words of a first text. " * 5, "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, None, "r", "k", 0.5, 7, "g") for r in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in ODD]
