from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, vid string, chunk string, held_out int, rate string, score string"


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies; clashing extra columns."""
    rng = random.Random(4)
    words = [f"w{i}é" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    some = " ".join(rng.choice(words) for _ in range(200))
    near = some.replace(some.split()[100], "changed", 1)
    texts = [(1, "Same text, twice over."), (2, "Same text, twice over."), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, long), (8, long + " x"), (9, some), (10, near), (None, "Same text, twice over."), (None, None), (1, "Same text, twice over."), (11, "one"), (12, "two words"), (13, "ONE"), (14, "a\x00b 　 c\u0085d"), (15, "repeat this line\n" * 30), (2, "other text under a known id")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), k, "v", "c", 1, "r", None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
