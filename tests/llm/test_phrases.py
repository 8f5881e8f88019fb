import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, odd_texts
from trussline.llm import phrases as P


def brute_counts(rows, depth=4):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, depth + 1):
                    if i + m <= len(w):
                        counts[lang, tuple(w[i : i + m])] += 1
    return counts, sizes


def brute_collocations(rows, depth, least, absorbed, most):
    counts, sizes = brute_counts(rows, depth)
    frequent = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in frequent.items():
        inside = any(lg == lang and len(x) > len(w) and 100 * f >= absorbed * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (lg, x), f in frequent.items())
        if not inside:
            cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], sizes[lang], score))
    ranked = []
    for lang in sizes:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], rank, *x[1:]) for rank, x in enumerate(own[:most], 1)]
    return sorted(ranked)


def corpus():
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        w = []
        while len(w) < rng.randrange(80):
            w += rng.choice([["New", "York", "City", "hall"], ["of", "the"], ["a"] * rng.randrange(1, 6), [rng.choice("bcdefgh")], ["x,"], ["é", "\x01"], ["end."], ["\x00"]])
        rows.append((rng.choice(["en", "de", None]), " ".join(w)))
    return rows + [("en", t) for t in odd_texts()] + [("fr", None), ("en", "new\tyork  city\x0bhall,;new york"), ("en", "a a a a " * 30)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lg, "z") for i, (lg, t) in enumerate(rows)], "doc_id long, text string, lang string, words string")


@pytest.fixture
def small(monkeypatch):
    """Chunks inside pieces, counters that many phrases share, groups that must be divided, batches handed on early."""
    for name, value in {"CHUNK": 64, "HELD": 40, "LEAST_BITS": 8, "SLICE_BITS": 6, "GROUP_ROWS": 8, "DIVIDED": 1 << 20}.items():
        monkeypatch.setattr(P, name, value)


def test_counts_equal_brute_force(spark, small):
    rows = [(lg, t if t is None or len(t) < 5000 else t[:5000]) for lg, t in corpus()]
    counts, sizes = brute_counts(rows)
    found, n = P.count_phrases(frame(spark, rows).repartition(5), 4, 12)
    got = [(r.lang, tuple(r.phrase.split(" ")), r.words, r.f) for r in found.collect()]
    assert sorted(got) == sorted((lg, w, len(w), f) for (lg, w), f in counts.items() if f >= 12)
    assert {r.lang: r.n for r in n.collect()} == {k: v for k, v in sizes.items() if v}


@pytest.mark.parametrize("most", [7, 2000])
def test_collocations_equal_brute_force(spark, most):
    rows = corpus()
    got = P.collocations(frame(spark, rows).repartition(3), 4, 12, 80, most)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == brute_collocations(rows, 4, 12, 80, most)


def test_what_is_exchanged_does_not_follow_the_splits(spark, monkeypatch):
    """Counters and suffixes are handed on once for each core, however many partitions hold the texts."""
    rows, made, cores = corpus() * 2, {}, spark.sparkContext.defaultParallelism
    kept = P.written

    def counted(df, name):
        out = kept(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(P, "written", counted)
    found, n = P.count_phrases(frame(spark, rows).repartition(6 * cores), 4, 12)
    counts, sizes = brute_counts(rows)
    assert sorted((r.lang, tuple(r.phrase.split(" ")), r.f) for r in found.collect()) == sorted((lg, w, f) for (lg, w), f in counts.items() if f >= 12)
    # A suffix ends where it gets rare, or with its piece: at most as many as frequent phrases, and a few that share a counter.
    assert made["suffixes"] <= 1.1 * cores * sum(f >= 12 for f in counts.values())
    assert made["phrase-counters"] <= cores * ((1 << P.LEAST_BITS - P.SLICE_BITS) + len(sizes))


def test_rare_phrases_do_not_fill_few_counters(spark, monkeypatch):
    """Text that outgrows the counters: pairs are frequent, longer phrases rare, and suffixes end before these."""
    monkeypatch.setattr(P, "MOST_BITS", 12)
    rng, made, kept = random.Random(7), {}, P.written
    monkeypatch.setattr(P, "written", lambda df, name: made.setdefault(name, []).append(out := kept(df, name)) or (name == "suffixes" and made.update(rows=out.count())) or out)
    rows = [("en", " ".join(f"wordword{rng.randrange(30)}" for _ in range(1000))) for _ in range(20)]
    found, n = P.count_phrases(frame(spark, rows), 4, 12)
    counts, _ = brute_counts(rows)
    assert sorted((tuple(r.phrase.split(" ")), r.f) for r in found.collect()) == sorted((w, f) for (_, w), f in counts.items() if f >= 12)
    assert n.first().n == 20_000
    # One counting of all lengths lets nearly every suffix of four words through.
    assert made["rows"] <= 15_000


def test_scores_beyond_64_bits(spark):
    one = spark.sql("select 9000000000000000000 as a, 9000000000000000001 as l, 9000000000000000002 as r")
    assert one.selectExpr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as s").first().s == 2000000 * 9000000000000000000 // (9000000000000000001 + 9000000000000000002)


def test_chunks_of_long_and_short_texts(monkeypatch):
    rng = random.Random(1)
    for size in (1, 3, 10, 40):
        monkeypatch.setattr(P, "CHUNK", size)
        for _ in range(100):
            texts = ["".join(rng.choice(["aB", "c", " ", "  ", "\t", ".", "\n", "\r", "é"]) for _ in range(rng.randrange(30))) for _ in range(4)]
            langs = [rng.choice("xy") for _ in texts]
            seen, hashes, batch = Counter(), {}, pa.record_batch([pa.array(langs), pa.array([t.encode() for t in texts])], names=["lang", "text"])
            for lang, w in P.chunks(iter([batch]), 3):
                words = [w.text[a:b] for a, b in zip(w.begin, w.end)]
                for x, h in zip(words, w.hash):
                    assert hashes.setdefault(x, h) == h
                for i in range(w.count):
                    for m in range(1, min(4, w.left[i]) + 1):
                        seen[lang, tuple(words[i : i + m])] += 1
            want, _ = brute_counts(list(zip(langs, texts)))
            assert seen == Counter({(lg, tuple(x.encode() for x in w)): n for (lg, w), n in want.items()})
            assert len(set(hashes.values())) == len(hashes)


def test_sql_equals_brute_force(spark, tmp_path):
    rows = corpus() * 3
    documents(spark, []).sparkSession.createDataFrame([(i, t, lg) for i, (lg, t) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    want = brute_collocations(rows, 4, 30, 80, 2000)
    assert sorted(db.sql(f"select {columns} from ({P.OP11_SQL})").fetchall()) == want
    assert sorted(tuple(r) for r in P.op11_collocations(spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()) == want


def test_empty_table(spark):
    assert P.collocations(documents(spark, [])).collect() == []
