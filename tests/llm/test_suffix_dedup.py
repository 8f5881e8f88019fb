import hashlib
import random
from collections import Counter

import pytest

from tests.llm.helpers import documents, odd_texts
from trussline.llm import suffix_dedup as S


def plain(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for (doc, _), t in zip(rows, raw):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared = [letters(k) for k in (150, 199, 200, 201, 260, 420, 900)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.4 else letters(rng.randrange(1, 300)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text))
    for i in range(12):  # near copies
        t = list(rows[3][1] + shared[5] + letters(600))
        for _ in range(3):
            t[rng.randrange(len(t))] = "Z"
        rows.append((n + i, "".join(t)))
    return rows + [(500 + i, rows[i][1]) for i in range(4)]


def check(spark, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in S.dedup_substrings(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_equals_brute_force(spark):
    check(spark, rows_of(1))


def test_hot_grams_are_dealt_by_more_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_REGIONS", 3)
    check(spark, rows_of(2, 40))


def test_one_passage_in_many_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_REGIONS", 8)
    rng = random.Random(7)
    letters = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = letters(230)
    check(spark, [(i, letters(rng.randrange(90)) + passage + letters(rng.randrange(90))) for i in range(60)])


def test_windows_are_read_off_the_sorted_order(monkeypatch):
    rng = random.Random(8)
    letters = lambda k: bytes(rng.randrange(97, 123) for _ in range(k))
    gram, right, left = letters(S.GRAM), letters(200), letters(120)
    texts = [letters(30) + left + gram + right[:100] + letters(60), letters(10) + left + gram + right[:90] + letters(80), letters(150) + gram + letters(140)]
    anchors = [150, 130, 150]
    # The first two share 120 bytes before the anchor and GRAM + 90 from it; the third has 150 and GRAM + 140.
    both, alone = (110 - S.GRAM, 120), (max(0, 60 - S.GRAM), min(150, S.LENGTH - S.GRAM))
    assert S.repeated_windows(texts, anchors, [1, 1, 1]) == [[both], [both], []]
    assert S.repeated_windows(texts, anchors, [1, 1, 2])[2] == [alone]
    assert S.repeated_windows(texts[2:], anchors[2:], [2]) == [[alone]] and S.repeated_windows(texts[2:], anchors[2:], [1]) == [[]]
    monkeypatch.setattr(S, "deep_shallow", lambda strings, depth=0: (list(range(len(strings))), [0] * len(strings)))
    assert S.repeated_windows(texts, anchors, [1, 1, 1]) == [[], [], []]


def test_periodic_and_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:-2])] + [(20, "ab" * 400), (21, "x" * 199), (22, "x" * 200), (23, "q" * 201), (None, "null id " * 40), (None, "null id " * 40), (24, "abc" * 100 + "é" * 150)]
    check(spark, rows)
    assert S.dedup_substrings(documents(spark, [])).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 100) for _ in range(30_000))
    want = {(int(a), int(b)) for a, b in _starts([text])}
    monkeypatch.setattr(S, "CHUNK", 4096)
    assert {(int(a), int(b)) for a, b in _starts([text])} == want


def _starts(texts):
    import numpy as np

    for number, offset, pieces in S._chunks(texts):
        r = S.regions(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]))
        for lo, hi, k, key in zip(r["lo"], r["hi"], r["text"], r["key"]):
            for s in range(lo, hi + 1):
                yield s + offset[k], key


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_order(seed):
    rng = random.Random(seed)
    base = bytes(rng.randrange(97, 99) for _ in range(80))
    strings = [base[: rng.randrange(81)] + bytes(rng.randrange(97, 99) for _ in range(rng.randrange(12))) for _ in range(60)]
    order, lcp = S.deep_shallow(strings, 0, rng.choice([0, 4, 16]))
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = lcp[k]
        assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])
