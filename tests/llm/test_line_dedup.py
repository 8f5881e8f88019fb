import hashlib
import random
from collections import defaultdict

from tests.llm.helpers import documents, odd_texts
from trussline.llm.line_dedup import dedup_lines


def plain(rows, least=10):
    def key(line):
        k = line.encode().strip().lower().decode()
        return k if len(k) >= least else None

    ids = [float("inf") if i is None else i for i, _ in rows]
    held = defaultdict(set)
    for i, (_, t) in zip(ids, rows):
        for x in (t or "").split("\n"):
            if key(x):
                held[key(x)].add(i)
    out = []
    for i, (doc, t) in zip(ids, rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or min(held[key(x)]) == i]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    pool = [f"  Shared Line number {i} É\t" for i in range(30)] + ["short", "", "\r", "ten chars!", "été été ét", "ÉTÉ ÉTÉ ÉT"]
    return [(rng.randrange(n * 3), "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randrange(1, 12)))) for _ in range(n)]


def check(spark, rows, **more):
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in dedup_lines(documents(spark, rows), **more).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_equals_brute_force_with_compaction(spark):
    check(spark, rows_of(1, 150), batches=6, fanout=2)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "same text here again"), (None, "only null ids hold it"), (None, "only null ids hold it"), (3, "three rows share an id"), (3, "three rows share an id")]
    check(spark, rows)
    assert dedup_lines(documents(spark, [])).count() == 0
    kept = {r.doc_id: r.text for r in dedup_lines(documents(spark, [(1, None), (2, "")])).collect()}
    assert kept == {1: None, 2: ""}


def test_rows_without_an_id_are_listed_apart(spark):
    rows = [(1, "a line that all hold")] + [(None, f"a line that all hold\nrow {i} has its own line\na line of none but nulls") for i in range(300)]
    check(spark, rows)
