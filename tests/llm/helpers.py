"""Small tables and plain versions of what the operators compute."""

from __future__ import annotations

import random

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string"


def documents(spark, rows):
    """A documents table with clashing extra columns; rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y") for r in rows], DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts() -> list:
    """Null, empty, blank, repeated, non-ASCII and long texts."""
    rng = random.Random(5)
    return [None, "", " \n\t ", "one", "two words", "same text here again", "same text here again", "Ünïcödé É é ß\n\nligne", " ".join(words(rng, 20_000)), "x" * 100_000]


def simhash(text: str | None, size: int) -> int:
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def classes(keys: list, linked) -> list[int]:
    """For each key the least index of its component under linked(a, b)."""
    of = list(range(len(keys)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [root(i) for i in range(len(keys))]
