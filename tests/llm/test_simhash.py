import random

import numpy as np
import pytest

from tests.llm.helpers import classes, documents, odd_texts, simhash, words
from trussline.llm import simhash as S


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [words(rng, 120) for _ in range(n)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = f"w{rng.randrange(400)}"
            out.append(" ".join(c))
    return out


def test_components_equal_brute_force(spark):
    texts = near_copies(1, 40) + odd_texts()
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(documents(spark, rows), 3, 3).collect()}
    fps = [simhash(t, 3) for _, t in rows]
    roots = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {rows[i][0]: (f"{fps[i]:016x}", rows[roots[i]][0]) for i in range(len(rows))}
    assert len(set(roots)) < len(rows) - 40


@pytest.mark.parametrize("threshold", [0, 1, 3, 4, 6])
def test_every_pair_within_the_threshold_shares_an_anchor(spark, threshold, monkeypatch):
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = [base]
    for k in range(1, 8):
        x = base.copy()
        for i in range(len(x)):
            for bit in rng.choice(64, k, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(bit)
        fps.append(x)
    # One dense cluster, larger than a block, so that blocks are compared with each other.
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 64).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 64).astype(np.uint64))
    fps = np.unique(np.concatenate([*fps, dense]))
    monkeypatch.setattr(S, "BLOCK", 16)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(np.uint64(np.int64(r.a).view(np.uint64)), np.uint64(np.int64(r.b).view(np.uint64))) for r in S.linked(df, threshold).collect()]
    at = {int(x): i for i, x in enumerate(fps)}
    joined = {(at[int(a)], at[int(b)]) for a, b in edges} | {(at[int(b)], at[int(a)]) for a, b in edges}
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= threshold for i, j in joined)
    want = classes([int(x) for x in fps], lambda a, b: (a ^ b).bit_count() <= threshold)
    assert classes(list(range(len(fps))), lambda i, j: (i, j) in joined) == want


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (2, "z z z z z"), (None, "other words stand here")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, -1), (-1, 7), (2, 2), (7, 7), (7, 7)]
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    text = " ".join(words(random.Random(3), 5000))
    whole = S.shingle_hashes(text, 3)
    monkeypatch.setattr(S, "CHUNK", 700)
    assert (S.shingle_hashes(text, 3) == whole).all()


def test_short_sequences_over_several_chunks(monkeypatch):
    texts = [" " * 40 + "one two", "a" * 30 + " " + "b" * 30, "c" + " " * 40, " " * 40, "d" * 20 + "\n" * 40 + "e f g"]
    whole = [S.shingle_hashes(t, 3).tolist() for t in texts]
    monkeypatch.setattr(S, "CHUNK", 8)
    assert [S.shingle_hashes(t, 3).tolist() for t in texts] == whole
