import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trussline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, query long"


def exact(rows, k, asks=lambda i: i % 20 == 0):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    seen, keep = set(), []
    for i, v in ok:
        if (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            keep.append((i, v))
    out = {}
    for q, v in keep:
        if asks(q):
            near = sorted(((-float(v @ w), j) for j, w in keep if j != q))[:k]
            out[q] = [(j, -s) for s, j in near]
    return out


def found(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    x = (centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 24))).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got, want = found(spark, rows), exact(rows, 20)
    assert got.keys() == want.keys()
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    vec = dict(rows)
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - np.dot(np.array(vec[q], float), np.array(vec[j], float))) < 1e-9 for j, s in near)


def test_one_common_vector_fills_its_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "BIN_BYTES", 1)  # bins of 256 rows
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(300)] + [(i, [float(a) for a in rng.normal(size=4)]) for i in range(300, 700)]
    got, want = found(spark, rows, 5), exact(rows, 5)
    same = [q for q in want if q < 300]
    assert all([j for j, _ in got[q]] == [j for j, _ in want[q]] for q in same)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (40, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [3.0]), (9, [2.0, 1.0]), (9, [2.0, 1.0]), (60, [])]
    got = found(spark, rows, 20)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {0: [9, 20], 20: [9, 0]}
    assert found(spark, [(1, [1.0])]) == {} and found(spark, []) == {}


def test_perturbations_come_in_order_of_their_expected_cost():
    m, n = 3, 15
    rng = np.random.default_rng(3)
    inside = rng.random((4000, m))
    borders = np.sort(np.concatenate([inside, 1 - inside], axis=1), axis=1) ** 2
    cost = borders.mean(axis=0) @ ann.perturbations(m, n).T.astype(float)
    assert (np.diff(cost) > -0.01).all() and len(np.unique(ann.perturbations(m, n), axis=0)) == n
    # Both sides of a cell are never crossed at once, and there are 3 ** m sets in all.
    sets = ann.perturbations(m, 1000)
    assert len(sets) == 3**m and not (sets[:, :m] * sets[:, ::-1][:, :m]).any()


def test_visits_are_neighbouring_cells():
    h = ann.Hasher.drawn(5, 1.0, 4, 0.7)
    q = np.random.default_rng(4).normal(size=(6, 5))
    cells = np.floor(h._cells(np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(6)]))
    steps = np.array(np.meshgrid(*[[-1, 0, 1]] * 4)).reshape(4, -1).T
    want = h._codes((cells[:, :, None] + steps).reshape(ann.TABLES, -1, 4)).view(np.int64).reshape(ann.TABLES, 6, -1)
    got = h.visits(q, 81)
    assert (np.sort(got, axis=2) == np.sort(want, axis=2)).all() and (got[..., 0] == h._codes(cells).view(np.int64)).all()


def test_scores_do_not_depend_on_what_meets():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(7, 64)), rng.normal(size=(7, 64))
    assert (ann.exact_scores(q, x)[:1] == ann.exact_scores(q[:1], x[:1])).all()


def clustered(n, rng, dimensions=32):
    centres = rng.normal(size=(n // 50, dimensions))
    x = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, dimensions))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_share_of_rows_scored_falls_as_the_table_grows(spark):
    shares = []
    for n in (2_000, 24_000):
        x = clustered(n, np.random.default_rng(8))
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
        got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
        score = x[::20].astype(float) @ x.T.astype(float)
        score[np.arange(len(score)), np.arange(0, n, 20)] = -np.inf
        want = np.argsort(-score, axis=1)[:, :20]
        near = got.groupby("query_id")["vec_id"].agg(set)
        assert np.mean([len(near[20 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.93
        shares.append(got.groupby("query_id")["scored"].first().mean() / n)
    assert shares[1] < 0.5 * shares[0] and shares[1] < 0.05, shares


def test_vectors_go_only_to_blocks_that_visit_their_bucket(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 3)
    index = spark.createDataFrame([(b, 10 * b + i, [1.0, float(i)]) for b in range(4) for i in range(5)], "bucket long, cid long, vec array<double>")
    queries = spark.createDataFrame([(q, [1.0, 0.5]) for q in range(9)], "query long, vec array<double>")
    # Every query visits bucket 0, one visits bucket 1, none the others.
    visits = spark.createDataFrame([(0, q) for q in range(9)] + [(1, 4)], "bucket long, query long")
    got = {r.query: (sorted(c for q, c in [(x.query, x.cid) for x in rows] if q == r.query), n) for rows in [ann._meet(index, visits, queries, 2, 99).collect()] for r in rows for n in [sum(x.scored for x in rows if x.query == r.query)]}
    assert {q: n for q, (_, n) in got.items()} == {q: 10 if q == 4 else 5 for q in range(9)}
    assert got[4][0] == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_few_candidates_are_all_found_however_far(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=24)
    rows = [(i, [float(a) for a in (x if i % 20 == 0 else -x * (i + 1)) + rng.normal(size=24) / 10]) for i in range(21)]
    got, want = found(spark, rows), exact(rows, 20)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_all_rows_are_compared_where_probes_do_not_suffice(spark, monkeypatch):
    for name, value in {"LEAST_PROBES": 1, "MOST_PROBES": 1, "HASHES": (24,), "WIDTHS": (0.75,), "BIN_BYTES": 1}.items():
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 5)
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in rng.normal(size=32)]) for i in range(400)]
    got, want = found(spark, rows), exact(rows, 20)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_no_join_is_broadcast_by_an_estimate(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ann, "BROADCAST_BUCKETS", 0, raising=False)
    plans, cut = [], ann.cut

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(ann, "cut", told)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/vectors")  # a file has a size, which estimates start from
    df = spark.read.parquet(f"{tmp_path}/vectors")
    told(ann.nearest(df, F.col("vec_id") % 20 == 0, 5))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_rows_far_from_each_other_are_scored_once_at_most(spark):
    n = 1500
    x = np.random.default_rng(10).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    assert got.groupby("query_id")["scored"].first().mean() <= n and len(got) == 20 * n // 20


def test_scores_chosen_in_single_precision_are_those_of_double(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUFFER", 50)
    monkeypatch.setattr(ann, "PRODUCT", (3, 16), raising=False)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 6)) * 10.0 ** rng.integers(-4, 7, 300)[:, None]
    x[100:200] = x[0] * (1 + 1e-12 * rng.integers(0, 50, 100))[:, None]  # equal in single precision
    x[7, 0] = -0.0
    q = np.r_[x[:3], rng.normal(size=(8, 6))]
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query long, vec array<double>")
    got = {}
    for r in ann._exact(classes, queries, 6, 9).collect():
        got.setdefault(r.query, []).append((-r.score, r.cid))
    for i, v in enumerate(q):
        score = ann.exact_scores(np.repeat(v[None], len(x), 0), x)
        assert sorted(got[i])[:9] == sorted(zip((-score).tolist(), range(len(x)), strict=True))[:9]


def test_zeros_of_either_sign_and_doubles(spark):
    rows = [(i, [-0.0 if i % 2 else 0.0, 1.0]) for i in range(5)] + [(20, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 4).orderBy("query_id", "rank").collect()]
    assert got == [(0, j) for j in (1, 2, 3, 4)] + [(20, j) for j in (0, 1, 2, 3)]
