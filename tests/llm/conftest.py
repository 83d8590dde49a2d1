"""Small documents with all that is awkward: nulls, empty and repeated texts, ties, columns of clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, h long, ids array<int>"


def awkward() -> list[tuple]:
    pick = random.Random(5)
    words = ["the", "of", "and", "Alpha", "beta,", "gamma", "délta", "日本", "x1", "#tag", "to", "is"]
    texts = [None, "", " \t\n ", "one", "two words", "a b c", "A B C", "line\nline\nline\nother line", "x" * 3000, "a b " * 4000]
    texts += [" ".join(pick.choices(words, k=pick.randint(3, 120))) for _ in range(60)]
    texts += [texts[20]] * 40 + [texts[21] + " tail"] * 3
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, 5, 0.5, 3, 9, [1]) for i, t in enumerate(texts)]
    return [*rows, rows[25], rows[25], (None, "no id here at all", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
