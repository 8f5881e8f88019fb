import random

import corpus_pipeline
from tests.llm.helpers import words
from trussline.llm.registry import oracles, queries


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(1)
    base = [(i, " ".join(words(rng, rng.randrange(30, 80))) + f"\nown ending line {i}", rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(120)]
    item = " ".join(words(rng, 30, 5000))
    extra = [(200, base[0][1], "en", "a"), (201, base[1][1].upper(), "en", "a"), (202, "12 34", "en", "a"), (203, None, None, "b"), (204, f"before it\n{item}\nafter it", "de", "b"), (205, "a footer that many share\nbody five", "de", "b"), (206, "a footer that many share\nbody six is another text", "de", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    docs = spark.createDataFrame([(i, t, g, s, 0, "z") for i, t, g, s in base + extra], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, read, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        read = spark.read.parquet(path)
    own = {i for i, *_ in base}
    assert own <= kept["language"].keys() and not {202, 203} & kept["language"].keys()
    lines = kept["lines"]
    assert lines[206].text == "body six is another text" and lines[205].text.startswith("a footer") and lines[206].n_chars == len(lines[206].text)
    assert lines[200].text == "" and lines[0].text == base[0][1]
    assert len({200, 201} & kept["near_copies"].keys()) <= 1 and own <= kept["near_copies"].keys()
    assert 204 not in kept["benchmark_leaks"] and own <= kept["benchmark_leaks"].keys()
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, kept["mixture"].values()))


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries() and oracles().keys() <= queries().keys()


def test_language_without_labels_drops_only_texts_without_a_letter(spark):
    rows = [(1, "plain words of a clean text", None), (2, "12 34 !", None), (3, None, None), (4, "more of them", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]


def test_language_fills_what_is_not_labelled(spark):
    rng = random.Random(8)
    made = [(i, " ".join(rng.choice(["the cat", "went home", "with"] if i % 2 else ["der Hund", "lief heim", "mit"]) for _ in range(30))) for i in range(80)]
    docs = spark.createDataFrame([(i, t, None if i < 10 else ["de", "en"][i % 2]) for i, t in made], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {i: ["de", "en"][i % 2] for i, _ in made}

DOCS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"


def tables(spark, path, docs, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [], [])).count() == 0
    docs = [(1, "some words of a text", "en", "a", 20)]
    assert [r.doc_id for r in corpus_pipeline.run(spark, tables(spark, tmp_path / "some", docs, [])).collect()] == [1]


def test_null_and_repeated_ids_and_long_texts(spark, tmp_path):
    rng = random.Random(9)
    long = " ".join(words(rng, 200_000, 90_000))
    same = " ".join(words(rng, 40))
    docs = [(1, long, "en", "a", 0), (None, " ".join(words(rng, 50)), "en", None, 0), (None, " ".join(words(rng, 60)), None, "b", 0)]
    docs += [(2, same, "en", "a", 0)] * 3 + [(3, " ".join(words(rng, 30)), "en", "b", 0), (3, " ".join(words(rng, 35)), "de", "b", 0), (4, "", "en", "a", 0), (5, None, "de", "a", 0)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, docs, [(1, "an item that nobody holds at all")])).collect()
    # Nothing is dropped but the texts without a letter and two of the three equal rows.
    assert sorted((r.doc_id or 0) for r in out) == [0, 0, 1, 2, 3, 3]
    assert {r.size for r in out if r.doc_id == 1} == {200_000}
