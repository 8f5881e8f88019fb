import random

import numpy as np

from tests.llm.helpers import documents, words
from trussline.llm import quality as Q


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = int(rng.random() < 0.8)
        w = words(rng, rng.randrange(30, 200), 300)
        if not good:
            w = rng.choice([[x.upper() + "!!" for x in w], [x + rng.choice(["$$$", "###"]) for x in w], [x + " |" for x in w], [x for x in w[:20] for _ in range(12)]])
        rows.append((i, " ".join(w), good))
    return rows


def fitted(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return Q.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))


def test_held_out_documents(spark):
    model = fitted(spark, corpus(1, 400) + [(None, "x", 1), (900, None, 0), (901, "", 1), (902, "a", None)])
    test = corpus(2, 200)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, "W1!! W2!!"), (1003, "W1!! W7!! " * 60_000), (1004, "w1 w2 é"), (1004, "w1 w2 é")]
    got = Q.score_documents(documents(spark, [(i, t) for i, t, _ in test] + odd), model).collect()
    assert len(got) == len(test) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert np.mean([by_id[i].predicted == y for i, _, y in test]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for i in (1000, 1001, 1002):
        assert abs(by_id[i].score - model.base) < 1e-6 and by_id[i].similarity == 0
    assert by_id[1003].predicted == 0


def test_votes_equal_brute_force():
    features, rng = Q._Features(), random.Random(3)
    bags = [Q.bag(t, features) for _, t, _ in corpus(5, 120)]
    labels = np.array([float(rng.random() < 0.5) for _ in bags])
    m = Q.learn(bags, labels, 0.8)
    score, near = Q.vote(m, bags[:20])
    for s, top, b in zip(score, near, bags, strict=False):
        x = Q.dense([b], m.idf)[0].astype(float) @ m.axes
        cos = sorted(((float(x @ v) / np.linalg.norm(x), y) for v, y in zip(m.vectors.astype(float), labels, strict=True)), reverse=True)[: Q.NEIGHBOURS]
        weight = {1: 0.8 / labels.mean(), 0: 0.2 / (1 - labels.mean())}
        cast = {y: sum(max(c, 0) ** Q.POWER * weight[y] for c, z in cos if z == y) + 0.05 * (0.8 if y else 0.2) for y in (0, 1)}
        assert abs(s - cast[1] / (cast[0] + cast[1])) < 1e-3 and abs(top - cos[0][0]) < 1e-3


def test_axes_are_the_leading_singular_vectors():
    features = Q._Features()
    bags = [Q.bag(t, features) for _, t, _ in corpus(6, 150)]
    m = Q.learn(bags, np.ones(len(bags)), 0.5)
    x = Q.dense(bags, m.idf)
    best = np.linalg.svd(x, compute_uv=False)[: Q.DIMENSIONS]
    assert np.linalg.norm(x @ m.axes) ** 2 >= 0.95 * (best**2).sum()
    assert np.allclose(m.axes.T @ m.axes, np.eye(Q.DIMENSIONS), atol=1e-4)


def test_whole_texts_and_clashing_columns(spark, tmp_path):
    rows = corpus(7, 300)
    docs = documents(spark, [(i, t) for i, t, _ in rows]).selectExpr("*", "'x' as quality", "'y' as score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, rows[0][2], 0), (None, 1, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op13_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) >= 0.95


def test_nothing_labelled_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = Q.fit(documents(spark, [(1, "a b")]), none)
    assert [r.score for r in Q.score_documents(documents(spark, [(1, "a b")]), m).collect()] == [0.5]
    assert Q.score_documents(documents(spark, []), m).collect() == []


def test_long_text_features_equal_in_chunks(monkeypatch):
    text = " ".join(words(random.Random(1), 3000))
    text += " go go go a b a b " * 50
    whole = Q.bag(text, Q._Features())
    w = text.split()
    again = [sum(x == y for x, y in zip(w, w[k:])) for k in (1, 2, 3)]
    weight = np.log1p([*again, len(w) - sum(again)])
    assert np.allclose(dict(zip(*whole))[Q.FEATURES - 4], weight[0] / np.linalg.norm(weight))
    monkeypatch.setattr("trussline.llm.simhash.CHUNK", 100)
    parts = Q.bag(text, Q._Features())
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
