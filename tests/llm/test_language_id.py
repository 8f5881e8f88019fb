import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import documents
from trussline.llm import language_id as L

SYLLABLES = {"aa": ["the", "ing", "th", "er"], "bb": ["ñas", "ció", "lla", "que"], "cc": ["sch", "ein", "üng", "ver"]}


def sample(seed, n, size=(3, 60)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(*size))), lang))
    return rows


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")


def test_held_out_accuracy_and_odd_texts(spark):
    train = labelled(spark, sample(1, 300) + [(None, "no id", "aa"), (999, "no label", None), (998, None, "bb"), (997, "", "bb")])
    test = sample(2, 150, (2, 40))
    odd = [(1000, None), (1001, ""), (1002, "12 34 !?"), (1003, "the thing " * 20_000), (None, "ein schein"), (1, "ein schein")]
    got = L.identify(documents(spark, [(i, t) for i, t, _ in test] + odd), train, keep=("doc_id", "text", "lang")).collect()
    assert len(got) == len(test) + len(odd)
    by_text = {r.text: r for r in got}
    assert np.mean([by_text[t].lang_pred == g for _, t, g in test]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang == "en" for r in got)
    assert [by_text[t].lang_pred for t in (None, "", "12 34 !?")] == ["und"] * 3 and by_text[None].score == 0
    assert by_text["the thing " * 20_000].lang_pred == "aa"


def test_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "words")])
    assert [(r.lang_pred, r.score) for r in L.identify(docs, labelled(spark, []), keep=("doc_id",)).collect()] == [("und", 0.0)]
    assert L.identify(docs.limit(0), labelled(spark, sample(1, 20))).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = L.started(["a", "b", "c"], rng)
    m.x, m.u, m.o, m.b = (p.astype(float) for p in (m.x, m.u, m.o, m.b))
    seg = rng.integers(97, 101, (7, 9))
    seg[5:, :3] = L.PAD
    want = rng.integers(0, 3, 9)
    _, grads = L.gradients(m, seg, want)
    for param, grad, used in zip((m.x, m.u, m.o, m.b), grads, (lambda i: i[1] in range(97, 101), *[lambda i: True] * 3)):
        places = [i for i in np.ndindex(param.shape) if used(i)]
        for i in [places[j] for j in rng.choice(len(places), min(25, len(places)), replace=False)]:
            kept, near = param[i], []
            for step in (1e-5, -1e-5):
                param[i] = kept + step
                near.append(L.gradients(m, seg, want)[0])
            param[i] = kept
            assert abs((near[0] - near[1]) / 2e-5 - grad[i]) < 1e-6


def test_training_lowers_the_loss(monkeypatch):
    monkeypatch.setattr(L, "BATCH", 8)
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(97, 102, (40, 6)).astype(np.int16), rng.integers(0, 2, 40)
    loss = [L.gradients(L.train(windows, labels, ["a", "b"], steps=n), windows.T.astype(np.int64), labels)[0] for n in (1, 150)]
    assert loss[1] < 0.7 * loss[0]


def test_one_id_for_very_many_rows_stays_one_training_text(spark):
    rows = [(7, f"the thing {i}", "aa") for i in range(3000)] + [(i, "ñas ció", "bb") for i in range(100, 120)]
    windows, labels, langs = L.training_windows(labelled(spark, rows))
    assert langs == ["aa", "bb"] and (labels == 0).sum() == 1


def test_every_window_of_a_whole_text_can_be_drawn(spark, monkeypatch):
    raw = bytes(range(97, 123)) * 40 + b"end"
    whole = L.drawn(raw)
    assert sorted(w for _, w in whole) == sorted(raw[k : k + L.WINDOW] for k in range(0, len(raw), L.WINDOW))
    assert L.drawn(b"") == []
    monkeypatch.setattr(L, "RANKED", 4)
    monkeypatch.setattr(L, "WINDOWS_PER_LANG", 7)
    assert sorted(L.drawn(raw)) == sorted(whole)[:7]
    rows = [(i, f"{i} " + "the thing " * 200, "aa") for i in range(3)] + [(9, "ein schein " * 3, "bb")]
    want = sorted(x for _, t, g in rows if g == "aa" for x in L.drawn(t.encode()))[:7]
    windows, labels, _ = L.training_windows(labelled(spark, rows))
    assert sorted(bytes(w[w != L.PAD].astype(np.uint8)) for w in windows[labels == 0]) == sorted(w for _, w in want)
    assert (labels == 1).sum() == 1


def test_pooling_covers_every_byte(monkeypatch):
    m = L.train(np.tile(np.arange(97, 113, dtype=np.int16), (8, 1)), np.arange(8) % 2, ["a", "b"], steps=2)
    text = bytes(range(97, 123)) * 20
    seg = [text[k : k + L.SEGMENT] for k in range(0, len(text), L.SEGMENT)]
    want = sum(L.label_positions(m, np.frombuffer(s, np.uint8).astype(np.int64)[:, None]).sum(axis=0)[:, 0] for s in seg) / len(text)
    assert np.allclose(L.pooled(m, [b"", text])[1], want, atol=1e-5)
    monkeypatch.setattr(L, "LAID", 2 * L.SEGMENT)
    assert np.allclose(L.pooled(m, [text[:5], b"", text])[2], want, atol=1e-5)


def test_a_kept_text_is_sent_once_and_predicted_in_bounded_groups(spark, monkeypatch):
    rows = documents(spark, [(i, t) for i, t, _ in sample(1, 60)] + [(900, None), (901, "12 34"), (902, "")])
    seen = L.identify(rows, labelled(spark, sample(2, 200)), keep=("doc_id", "text", "lang"))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "Project" in line and "known" in line)
    assert sent.split("AS known")[1].count("text") == 1 and sent.split("AS known")[0].count("AS k") == 2
    want = sorted(map(str, seen.collect()))
    monkeypatch.setattr(L, "GROUP", 100)
    groups = list(L._groups(np.ones(5, bool), pa.array(["a" * 60] * 5)))
    assert [len(g) for g in groups] == [2, 2, 1]
    assert sorted(map(str, L.identify(rows, labelled(spark, sample(2, 200)), keep=("doc_id", "text", "lang")).collect())) == want
