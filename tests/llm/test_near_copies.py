import random

import corpus_pipeline
from tests.llm.helpers import classes, documents, odd_texts, words
from trussline.llm import near_copies


def grams(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def near(a, b):
    x, y = grams(a), grams(b)
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def changed(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
    return ws


def corpus(rng):
    out = []
    for _ in range(25):
        ws = words(rng, rng.randrange(40, 160), 5000)
        out += [" ".join(changed(rng, ws, rng.randrange(0, 1 + len(ws) // 30))) for _ in range(4)]
    shared = " ".join(words(rng, 30, 5000))
    return out + [shared + " " + " ".join(words(rng, 25, 5000)) for _ in range(20)] + odd_texts()


def check(spark, rows):
    got = [r.doc_id for r in corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()]
    root = classes([t for _, t in rows], near)
    assert sorted(got) == sorted({root[i]: rows[root[i]][0] for i in range(len(rows))}.values())


def test_every_pair_at_the_similarity_is_found(spark):
    check(spark, list(enumerate(corpus(random.Random(3)))))


def test_blocks_of_a_common_shingle(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    monkeypatch.setattr(near_copies, "OFTEN", 10**9)
    monkeypatch.setattr(near_copies, "SHARED", 0)
    monkeypatch.setattr(near_copies, "SPAN", 64)
    check(spark, list(enumerate(corpus(random.Random(4)))))


def test_frequent_shingles_lead_to_a_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FREQUENT", 2)
    check(spark, list(enumerate(corpus(random.Random(6)))))
    monkeypatch.setattr(near_copies, "LISTED", 9)
    check(spark, list(enumerate(corpus(random.Random(7)))))


def test_candidates_come_from_fingerprints(spark):
    rng = random.Random(8)
    long = [words(rng, 400, 5000) for _ in range(6)]
    texts = [t for ws in long for t in (" ".join(ws), " ".join([*ws[:-1], "other"]))] + [None, "", "one"]
    sets = {t: near_copies.shingles(t) for t in texts}
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = documents(spark, rows).selectExpr("doc_id", "xxhash64(text) as th", "text")
    got = {frozenset((r.a, r.b)) for r in near_copies._alike(near_copies._heads(docs)).collect()}
    fps = {near_copies.set_key(s): near_copies.fingerprint(s) for s in sets.values() if len(s)}
    close = {frozenset((a, b)) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= near_copies.DIFFERING}
    pairs = [frozenset(near_copies.set_key(sets[t]) for t in texts[k : k + 2]) for k in range(0, 12, 2)]
    assert got == close and sum(p in got for p in pairs) >= 4


def test_one_row_of_a_group_stays_and_no_other_goes(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(words(rng, 40, 5000)) for _ in range(4))
    rows = [(1, a), (7, a), (7, b), (3, c), (3, c), (None, d), (None, d), (None, a)]
    got = corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (7, b), (3, c), (0, d)])


def test_empty_table(spark):
    assert corpus_pipeline.near_copies(spark, documents(spark, []), "").collect() == []
