"""Small frames with the rows that every operator must bear: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names operators use for themselves
EXTRA = ", size long, shard int, slot int, copies int, score double, fp long, h long, component_id long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    text = words(rng, 40)
    return [
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4), (6, "one", "en", None, 3), (7, words(rng, 60_000), "en", "c", 9), (8, text + " end", "en", "a", 1),
        (None, text, None, "b", 1), (None, None, None, None, None), (9, "é中 \x00 ✓ don't", "xx", "c", 1), (1, "another text with the same id", "en", "a", 1),
    ]


def odd_docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, 6, 7, 8) for r in odd_rows()], DOCS + EXTRA)


def no_docs(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


def docs(spark, texts: list, sources: list | None = None):
    return spark.createDataFrame([(i, t, "en", (sources or ["a"] * len(texts))[i], 0) for i, t in enumerate(texts)], DOCS)
