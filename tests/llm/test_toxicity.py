import random

import numpy as np

from tests.llm.helpers import documents, words
from trussline.llm import toxicity as T

BAD = ["vile", "nasty", "awful", "rotten"]


def brute_segments(scores):
    """All maximal segments by recursion on the definition: the best segment, then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if not best or best[0] <= 0:
        return []
    _, _, a, b = best
    return brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_segments_equal_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        scores = [round(rng.uniform(-3, 2), 6) for _ in range(rng.randrange(14))]
        got = T.segments(scores)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
        assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in got)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        w = words(rng, rng.randrange(20, 200), 150)
        for _ in range(toxic * rng.randrange(2, 5)):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(w), toxic))
    return rows


def fitted(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_held_out_documents(spark):
    model = fitted(spark, corpus(1, 400) + [(None, "x", 1), (900, None, 0), (901, "", 1), (902, "a", None)])
    test = corpus(2, 200)
    odd = [(1000, None), (1001, ""), (1002, "?! ..."), (None, "vile nasty"), (1003, "word " * 30_000 + "vile nasty rotten awful " + "word " * 30_000)]
    got = T.score_documents(documents(spark, [(i, t) for i, t, _ in test] + odd), model).collect()
    assert len(got) == len(test) + len(odd)
    by_id = {r.doc_id: r for r in got}
    y = np.array([t for *_, t in test])
    p = np.array([by_id[i].predicted for i, *_ in test])
    assert (p == y).mean() >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by_id[1000].predicted == by_id[1001].predicted == by_id[1002].predicted == 0
    long = by_id[1003]
    assert long.predicted == 1 and (long.worst_start, long.worst_end) == (30_000, 30_004)


def test_without_labels(spark):
    model = fitted(spark, [])
    assert [r.predicted for r in T.score_documents(documents(spark, [(1, "vile")]), model).collect()] == [0]
    one = fitted(spark, [(1, "a b", 1), (2, "a b", 1)])
    assert [r.predicted for r in T.score_documents(documents(spark, [(1, "vile")]), one).collect()] == [1]
    assert T.score_documents(documents(spark, []), model).count() == 0


def test_extremes_solve_their_equation_and_bound_random_text():
    score, share = np.array([2.0, -1.0, 0.5, -1.2]), np.array([0.05, 0.2, 0.1, 0.65])
    rate, log_k = T._extremes(score, share)
    assert abs((share * np.exp(rate * score)).sum() - 1) < 1e-6 and rate > 0
    # In texts drawn from the background the best segment exceeds its extreme-value bound in few.
    rng = np.random.default_rng(1)
    n, over = 400, 0
    for _ in range(300):
        best = max((s for *_, s in T.segments(rng.choice(score, n, p=share).tolist())), default=0)
        over += rate * best > log_k + np.log(n) + 3
    assert over / 300 <= np.exp(-3) + 0.03


def test_repeated_rows_and_ids_are_bounded_in_the_sample(spark):
    rows = [(1, "vile words", 1)] * 500 + corpus(3, 60)[2:]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert T.sampled(docs, labels).where("text = 'vile words'").count() == 1
    got = T.score_documents(docs, T.fit(docs, labels)).where("doc_id = 1").collect()
    assert len(got) == 500 and len({r.score for r in got}) == 1
