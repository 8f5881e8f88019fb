import hashlib
import random
import zlib

import numpy as np

from tests.llm.helpers import documents, odd_texts
from trussline.llm import periodic_runs as P


def brute_runs(w):
    """Every maximal stretch per period, kept where the period is its smallest."""
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def planted(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        w = []
        for _ in range(rng.randrange(6)):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            w += (unit * rng.randrange(1, 9))[rng.randrange(len(unit)) :] + [rng.randrange(3) for _ in range(rng.randrange(5))]
        yield w


def test_extensions_equal_plain_comparison():
    rng = random.Random(2)
    for w in [x for x in sequences(3, 60) if len(x) > 3] + [[1] * 500, [1, 2] * 300]:
        s = np.array(w + [99])
        levels = P.grammar(s)
        for level in levels:
            text = {}
            for k, a, b in zip(level.sym.tolist(), level.start[:-1].tolist(), level.start[1:].tolist(), strict=True):
                assert text.setdefault(k, w_of(s, a, b)) == w_of(s, a, b)
        i = np.array([rng.randrange(len(w)) for _ in range(40)])
        j = np.array([rng.randrange(len(w)) for _ in range(40)])
        for x, y, f, b in zip(i, j, P.extensions(levels, i, j, True), P.extensions(levels, i, j, False), strict=True):
            if x == y:
                continue
            plain = next((k for k in range(len(s) - max(x, y)) if s[x + k] != s[y + k]), len(s) - max(x, y))
            back = next((k for k in range(min(x, y)) if s[x - 1 - k] != s[y - 1 - k]), min(x, y))
            assert (f, b) == (plain, back)


def w_of(s, a, b):
    return tuple(s[a:b].tolist())


def test_runs_equal_brute_force(monkeypatch):
    for batch, most in ((1 << 18, 1 << 21), (40, 64)):
        monkeypatch.setattr(P, "BATCH_WORDS", batch)
        monkeypatch.setattr(P, "CANDIDATES", most)
        texts = [[b"%d" % x for x in w] for w in sequences(batch, 300)] + [[b"a"] * 200, [b"a", b"b", b"c"] * 70, [b"a"] * 5, [b"a"] * 6]
        got = P._judged(list(range(len(texts))), texts).to_pylist()
        for row, w in zip(got, texts, strict=True):
            runs = brute_runs(w)
            assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == runs
            gone = {i for a, n, q in runs for i in range(a + q, a + n)}
            assert row["collapsed"].encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_registered_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["x", "y", "Z", "é"]) for _ in range(rng.randrange(120)))) for i in range(400)]
    rows += list(enumerate([t if t is None or len(t) < 50_000 else t[:3000] for t in odd_texts()], 1000)) + [(7, "a a a a a a a"), (7, "a a a a a a a"), (None, "b " * 9)]
    rows += [(i, t) for i, t in ((2000, "go on " * 40_000), (2001, "\x01 \x00 " * 8))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        w = planted(doc_id, text)
        # The long text has one run by construction, unless it is planted, which keeps period and all.
        runs = brute_runs(w) if len(w) < 5000 else [(0, len(w), 2)] if len(set(w)) == 2 else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        digest = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, kept))
    key = lambda r: tuple((x is None, x) for x in r)
    assert len(got) == len(rows)
    seen = {r[0] for r in want}
    assert sorted((tuple(r) for r in got if r.doc_id in seen), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert P.periodic_runs(documents(spark, [])).collect() == []
