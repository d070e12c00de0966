"""Shared rows and plain versions for the tests of the training-data operators."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def components(texts: dict[int, str | None], width: int, similarity: float) -> dict[int, int]:
    sets = {k: shingles(t, width) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                both = len(x & y)
                if 100 * both >= round(100 * similarity) * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {k: root(k) for k in texts}


LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(40000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a", 58, 7, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 1, "y"),
    (4, " \t\r\n ", "en", "b", 5, 1, "y"),
    (5, "12345 !!! ???", None, "b", 13, 1, "z"),
    (6, "The quick  brown\tfox jumps over the lazy dog near the river", "en", "a", 59, 7, "x"),
    (7, "The quick brown fox jumps over the lazy dog near the river", "en", "a", 58, 7, "x"),
    (7, "The quick brown fox jumps over the lazy dog near the river", "en", "a", 58, 7, "x"),
    (8, LONG, "en", "a", len(LONG), 7, "x"),
    (9, LONG + " tail", "en", "a", len(LONG) + 5, 7, "x"),
    (10, "une phrase en français où les accents é è ê sont là", "fr", None, 50, 3, "q"),
    (11, "the same the same the same " * 200, "en", "a", 5400, 3, "q"),
    (None, "a row without an id, in plain English words", "en", "a", 42, 3, "q"),
    (12, "emoji 🙂 and 你好 and ▁ mark", "en", "a", 24, 3, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id string"


def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame(ROWS, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows) -> dict[int, str | None]:
    return {r["doc_id"]: r["text"] for r in rows}
