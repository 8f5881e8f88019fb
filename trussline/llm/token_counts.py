"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, so no encoder call sees a long text and equal pieces are encoded once: a byte-level
BPE with the usual word pattern never joins a character that is not white space with the white space after it, so the
counts of the pieces add up to the count of the text. Very long stretches without white space are cut between an ASCII
letter and a digit, which that pattern never joins either; a stretch without such a place is one word to the tokenizer and
stays whole. A file with another pattern or a normalizer gets whole texts. Calls are balanced by bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A piece starts with white space and runs to the next white space that follows another character. Python's \s holds
#: the separators 1C to 1F, which are no white space to the tokenizer and can share a token with a neighbour.
PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Pieces of more characters are cut further, into parts of about as many.
STRETCH = 1 << 16
CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pieces remembered by a worker, about 100 MB, and the longest piece worth remembering.
REMEMBERED, LONGEST = 400_000, 64

_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """The library's tokenizer, the lengths this worker already knows, and whether texts may be cut before white space and
    between letters and digits; loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        split = [s for s, _ in t.pre_tokenizer.pre_tokenize_str("ab12cd ef\n\ngh")] if t.pre_tokenizer else []
        marks = [x.content for x in t.get_added_tokens_decoder().values()]
        words = split == ["ab", "12", "cd", "\u0120ef", "\u010a", "\u010a", "gh"] and t.normalizer is None and not any(re.search(r"\s", m) for m in marks)
        _loaded[path] = (t, {}, words, words and not any(CHANGE.search(m) for m in marks))
    return _loaded[path]


def pieces_of(text: str, words: bool, changes: bool) -> list[str]:
    """Parts whose token counts add up to the text's."""
    if not words:
        return [text] if text else []
    pieces = PIECE.findall(text)
    if not changes or len(text) <= STRETCH or max(map(len, pieces), default=0) <= STRETCH:
        return pieces
    out = []
    for p in pieces:
        start = 0
        while len(p) - start > STRETCH and (at := CHANGE.search(p, start + STRETCH)):
            out.append(p[start : at.start()])
            start = at.start()
        out.append(p[start:])
    return out


def _encode(tokenizer, pieces: list[str], batch_bytes: int) -> Iterator[int]:
    """Lengths of `pieces`, in calls of about `batch_bytes` of UTF-8 each."""
    batch, held = [], 0
    for p in pieces:
        batch.append(p)
        held += (len(p) if p.isascii() else len(p.encode("utf-8", "replace"))) + 8
        if held >= batch_bytes:
            yield from map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))
            batch, held = [], 0
    if batch:
        yield from map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False))


def text_lengths(path: str, texts: list[str | None], batch_bytes: int = 1 << 18) -> list[int]:
    """Tokens of each text; null counts as empty."""
    tokenizer, known, words, changes = _encoder(path)
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for text in texts:
        pieces = pieces_of(text or "", words, changes)
        new = list({p for p in pieces if p not in known})
        if new:
            found = dict(zip(new, _encode(tokenizer, new, batch_bytes), strict=True))
            if len(known) + len(new) > 2 * REMEMBERED or any(len(p) > LONGEST for p in new):
                both = {**{p: known[p] for p in set(pieces) if p in known}, **found}
                known.update((p, n) for p, n in found.items() if len(p) <= LONGEST and len(known) < 2 * REMEMBERED)
                out.append(sum(map(both.__getitem__, pieces)))
                continue
            known.update(found)
        out.append(sum(map(known.__getitem__, pieces)))
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row a row of `docs`.

    `path` is a tokenizer file of the tokenizers library (byte-level BPE) at the same place on every machine. Null
    texts count as empty; null ids and repeated rows stay; special strings in a text count as the library does by
    default; no text is cut short; extra columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = text_lengths(path, texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `documents`; nulls, empty and long texts, repeated rows and an
    empty table as in `count_tokens`."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
