import random

from tests.llm.helpers import documents, odd_texts, words
from trussline.llm.mixing import MAX_REPEATS, mix_sources, mixed


def targets(sizes):
    """Targets by sharing out and capping until no source is above its cap."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(keys)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in keys if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 300))), rng.choice(["a", "a", "a", "a", "b", "Z", "é", None])) for i in range(400)]
    return rows + [(900, "just four small words", "tiny"), (901, None, "null"), (None, "x y", "a"), (None, "x y", "a"), (5, "x y", "a")] + [(1000 + i, t, "odd") for i, t in enumerate(odd_texts())]


def test_targets_and_bounds(spark):
    rows = rows_of(3)
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    got = mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= MAX_REPEATS * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 4 * 64 for s in sizes)
    number = lambda i: -1 if i is None else i
    assert sorted((number(r.doc_id), r.size) for r in got) == sorted((number(i), size(t)) for i, t, _ in rows)
    again = mix_sources(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_take_equal_blocks(spark):
    _, _, _, pieces = mixed(documents(spark, rows_of(4)), block_words=50)
    by_slot = {}
    for r in pieces.collect():
        by_slot[r.slot] = by_slot.get(r.slot, 0) + r.words
    short = [n for n in by_slot.values() if n != 50]
    assert len(short) <= 9 and all(n < 50 for n in short)


def test_empty(spark):
    assert mix_sources(documents(spark, [])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mix_sources(documents(spark, [(1, None), (2, "")])).collect()] == [(0, 0.0, 0)] * 2
