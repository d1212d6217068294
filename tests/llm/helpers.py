"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

EXTRA = "doc_id long, text string, lang string, rep long, place string, sig string, score double, y int, h int, _runs string, _items string, _score double, spans string, z string"


def odd_docs(spark, texts):
    """doc_id, text and lang, with columns whose names the operators use inside."""
    rows = [(i, t, "en" if (i or 0) % 2 else "fr", 7, "p", "s", 0.5, 1, 2, "r", "i", 0.1, "sp", "z") for i, t in texts]
    return spark.createDataFrame(rows, EXTRA)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = ["w" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + "uvwxyz"[i // 100 % 6] for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(w if rng.random() > share else "new" + str(rng.randrange(10**6)) for w in text.split())
