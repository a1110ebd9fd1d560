"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int = 120, vocabulary: int = 4000) -> str:
    """Reproducible sentences of made-up words."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]
    for k in range(9, n, 10):
        words[k] += "."
    return " ".join(words)


def docs(spark, texts, ids=None):
    """A documents table of texts, with ids 0, 1, 2, ... unless given."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in zip(ids, texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts() -> list[str | None]:
    """Null, empty, blank, one word, a very long text, one without white space, and odd characters."""
    return [None, "", " \t\n ", "word", prose(5, 30_000), "x" * 50_000, "é  İ K 𝄞 a\x00b", "a. b! c? d"]
