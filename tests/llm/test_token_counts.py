import random

import pytest

from tests.llm.helpers import documents, odd_texts, words
from trussline.llm import token_counts as T

P = pytest.importorskip("public_tokenizers")


def test_equals_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = ["word", " two", "\n\n", "  ", "\t", "\x1c", "!\x1c?", "\x85", "\xa0", "\u3000", "'s", "don't", "123", "é", "漢字", "<|endoftext|>", " <|endoftext|> ", "...", "\r\n", "a\u200bb", "🙂"]
    texts = odd_texts() + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)] + [" ".join(words(rng, 3000))]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "a b"), (1, "a b")]
    want = sorted((i if i is not None else -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in rows)
    got = T.count_tokens(documents(spark, rows), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    rng = random.Random(2)
    texts = [" ".join(words(rng, 200)) for _ in range(20)] + ["y" * 500 + " " + "z" * 300]
    path = P.path("byte_bpe_50k.json")
    many = T.text_lengths(path, texts, 64)
    T._loaded.clear()
    assert [T.text_lengths(path, [t])[0] for t in texts] == many
    assert len(T._encoder(path)[1]) <= 200


def test_empty_table(spark):
    assert T.count_tokens(documents(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_long_stretches_without_white_space(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, _, words, changes = T._encoder(path)
    assert words and changes
    rng = random.Random(4)
    texts = ["".join(rng.choice(["abc", "12", "'s", "-", "é", "x9", "<|endoftext|>", "漢1"]) for _ in range(4000)) for _ in range(3)] + ["z" * 5000, " a1" * 50]
    monkeypatch.setattr(T, "STRETCH", 100)
    assert max(map(len, T.pieces_of(texts[0], True, True))) < 600
    assert T.text_lengths(path, texts) == [len(t.encode(x, add_special_tokens=False)) for x in texts]
    assert T.pieces_of("a b", False, False) == ["a b"]
