import random
from collections import Counter

from tests.llm.helpers import documents, odd_texts, words
from trussline.llm import decontaminate as D


def plain(text, item):
    """Best multiset Jaccard of any window as long as the item, over five-word shingles."""
    ws, it = (text or "").lower().split(), item.lower().split()
    g = min(5, len(it))
    grams = lambda w: Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1))
    want, best = grams(it), 0.0
    for s in range(len(ws) - len(it) + 1):
        own = grams(ws[s : s + len(it)])
        best = max(best, (own & want).total() / (own | want).total())
    return best


def planted(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 500))) for i, n in enumerate((1, 3, 5, 9, 14, 20, 30, 45, 60, 60))] + [(50, ""), (51, None), (52, "w1 w2 w3 w4 w5 w6 w7 w8"), (52, "w1 w2 w3 w4 w5 w6 w7 w8")]
    rows = []
    for i in range(160):
        w = words(rng, rng.randrange(10, 200), 500)
        for _ in range(rng.randrange(3)):
            p = items[rng.randrange(10)][1].split()
            for _ in range(rng.randrange(4)):
                p[rng.choice([0, len(p) - 1, rng.randrange(len(p))])] = "changed"
            k = rng.randrange(len(w))
            w[k:k] = [x.upper() if rng.random() < 0.5 else x for x in p]
        rows.append((i, (" " if i % 2 else "\n\t").join(w)))
    return rows + [(900 + i, t) for i, t in enumerate(odd_texts()[:-2])] + [(None, "w1 w2 w3 w4 w5 w6 w7 w8"), (5, "again w1 w2 w3 w4 w5 w6 w7 w8")], items


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_equals_brute_force(spark):
    rows, items = planted(1)
    want = {}
    for n, (i, t) in enumerate(rows):
        for k, (item, it) in enumerate(items):
            if it and (s := plain(t, it)) >= 0.8:
                want[n, k] = (i, item, round(s, 9))
    got = D.find_leaks(documents(spark, rows), bench(spark, items)).collect()
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got), key=str) == sorted(want.values(), key=str)
    assert sum(s < 1 for *_, s in want.values()) > 5
    at = {i: (t or "").lower().split() for i, t in rows}
    for r in got:
        if r.similarity == 1 and r.doc_id not in (None, 5):
            assert at[r.doc_id][r.start : r.start + r.n_words] in [it.lower().split() for i, it in items if i == r.item_id and it]


def test_passes_and_chunks_change_nothing(spark, monkeypatch):
    from trussline.llm import simhash

    rows, items = planted(2)
    one = sorted(map(str, D.find_leaks(documents(spark, rows), bench(spark, items)).collect()))
    monkeypatch.setattr(D, "PASS_BYTES", 400)
    assert sorted(map(str, D.find_leaks(documents(spark, rows), bench(spark, items)).collect())) == one
    index = D.Index([(i, 0, t) for i, t in items if t])
    whole = [D.passages(index, t, {}) for _, t in rows]
    monkeypatch.setattr(simhash, "CHUNK", 300)
    assert [D.passages(index, t, {}) for _, t in rows] == whole


def test_one_index_is_alive_however_many_passes(spark, monkeypatch):
    rows, items = planted(3)
    docs, bench_ = documents(spark, rows), bench(spark, items)
    leaks = sorted(map(str, D.find_leaks(docs, bench_).collect()))
    kept = sorted(map(str, D.without_leaks(docs, bench_).collect()))
    monkeypatch.setattr(D, "PASS_BYTES", 120)
    assert sum(1 for _ in D._passes(bench_)) >= 10
    context, alive, most = type(spark.sparkContext), set(), []
    plain_broadcast = context.broadcast

    def broadcast(self, value):
        b = plain_broadcast(self, value)
        if isinstance(value, D.Index):
            alive.add(id(b))
            most.append(len(alive))
            gone = b.destroy
            b.destroy = lambda *a, **k: (alive.discard(id(b)), gone(*a, **k))[1]
        return b

    monkeypatch.setattr(context, "broadcast", broadcast)
    assert sorted(map(str, D.find_leaks(docs, bench_).collect())) == leaks
    assert len(most) >= 10 and max(most) == 1
    alive.clear()
    most.clear()
    assert sorted(map(str, D.without_leaks(docs, bench_).collect())) == kept
    assert len(most) >= 10 and max(most) == 1


def test_filter_and_empty_tables(spark):
    rows = [(1, "clean words only here today"), (2, "x w1 w2 w3 w4 w5 w6 y"), (3, None), (4, "")]
    items = bench(spark, [(1, "w1 w2 w3 w4 w5 w6")])
    docs = documents(spark, rows)
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert D.find_leaks(docs, items.limit(0)).count() == 0 and D.without_leaks(docs, items.limit(0)).count() == 4
    assert D.find_leaks(docs.limit(0), items).count() == 0


def test_a_text_that_very_many_items_repeat(spark):
    items = spark.range(100_000).selectExpr("id AS item_id", "'w1 w2 w3 w4 w5 w6' AS text")
    assert [(len(i.ids), last) for i, last in D._passes(items)] == [(1, True)]
    assert D.find_leaks(documents(spark, [(1, "x w1 w2 w3 w4 w5 w6 y")]), items).count() == 100_000


def test_index_of_many_items_is_small():
    import pickle

    rng = random.Random(3)
    index = D.Index([(i, 0, " ".join(words(rng, 20 + i % 180, 50_000))) for i in range(4000)])
    assert len(pickle.dumps(index)) < 20e6  # 20,000 such items: under 100 MB
    many = D.Index([(i, 0, " ".join(words(rng, 30, 9000))) for i in range(300)])  # more of one size than values to look up
    for index, size in [(index, n) for n in set(index.sizes[:9].tolist())] + [(many, 30)]:
        own = [k for k, n in enumerate(index.sizes) if n == size]
        prints = index.prints[own] ^ D.np.array([sum(1 << b for b in rng.sample(range(64), rng.choice([0, 9, 17, 18]))) for _ in own], D.np.uint64)
        want = [[k for k in own if (int(index.prints[k]) ^ int(fp)).bit_count() <= D.RADIUS] for fp in prints]
        assert index.near(prints, size) == want
