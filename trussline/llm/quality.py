"""Quality: nearest-neighbour voting in a latent-semantic space.

A document is a bag of its words (A-Z lower-cased, without punctuation at the ends), of their shapes (letters, digits and
marks as they follow each other) and of their repeats (equal to one of the three words before), hashed into a fixed number
of features. Log counts, inverse document frequencies and
a truncated singular value decomposition of the labelled sample give a space of few dimensions; the labelled vectors are
broadcast. Every document takes exact cosine products with all of them, block by block, and its nearest ones vote with
weights that grow with similarity, each label weighted to its share among all labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, hashed_sample, table
from .simhash import word_chunks

#: Bound of the training sample: labelled documents of either label. The broadcast model has at most twice as many vectors.
DOCS_PER_LABEL = 4_000
#: Hashed features (half of them words, the last ones repeats and the rest shapes), dimensions of the space, rounds of the
#: decomposition.
FEATURES, DIMENSIONS, ROUNDS = 1 << 12, 64, 4
#: Neighbours that vote, and the power of their similarity.
NEIGHBOURS, POWER = 31, 8
#: A word may repeat the one before, or two or three before, or none of these.
REPEATS = 3
#: Documents scored at once; words whose features a task remembers.
BLOCK, REMEMBERED = 128, 1 << 19
EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")
#: Upper-case letters, lower-case ones (any byte beyond ASCII too) and digits; a row of one class counts once.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
CLASSES = re.compile(rb"([Aa0])\1+")


@dataclass
class Model:
    idf: np.ndarray  # (FEATURES,)
    axes: np.ndarray  # (FEATURES, dimensions)
    vectors: np.ndarray  # (documents, dimensions), of length 1
    votes: np.ndarray  # (documents, 2): the weight of a vote against and for label 1
    base: float  # share of label 1, the score where nothing is near


class _Features(dict):
    """word -> (feature of the word, feature of its shape)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        half = FEATURES // 2
        own = word if word.isalnum() else EDGES.sub(b"", word)
        out = self[word] = (xxhash.xxh64_intdigest(own.lower()) % half, half + xxhash.xxh64_intdigest(CLASSES.sub(rb"\1", word.translate(SHAPE))) % (half - REPEATS - 1))
        return out


def bag(text: str | None, features: _Features) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text and their log counts, 1 in length for words, for shapes and for repeats."""
    counts, before, repeats = Counter(), [], np.zeros(REPEATS + 1)
    for words in word_chunks((text or "").encode("utf-8", "replace"), 0):
        counts.update(words)
        known = before + words
        for k in range(1, REPEATS + 1):
            repeats[k - 1] += sum(map(eq, known[max(0, len(before) - k) :], known[max(k, len(before)) :]))
        before = known[-REPEATS:]
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    at = np.array([features[w] for w in counts], np.int64)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    repeats[REPEATS] = max(0, n.sum() - repeats.sum())
    total = np.bincount(at[:, 0], n, FEATURES) + np.bincount(at[:, 1], n, FEATURES)
    total[-REPEATS - 1 :] = repeats
    found = np.flatnonzero(total)
    weight = np.log1p(total[found])
    part = np.searchsorted([FEATURES // 2, FEATURES - REPEATS - 1], found, side="right")
    return found, (weight / np.sqrt(np.bincount(part, weight**2, 3))[part]).astype(np.float32)


def dense(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((len(bags), FEATURES), np.float32)
    for row, (at, weight) in zip(out, bags, strict=True):
        row[at] = weight
    return out if idf is None else out * idf


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def learn(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Inverse document frequencies, axes by subspace iteration over blocks of rows, and the labelled vectors."""
    n = len(bags)
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *(at for at, _ in bags)]), minlength=FEATURES)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(FEATURES, min(DIMENSIONS, FEATURES))))[0].astype(np.float32)
    blocks = [bags[a : a + 512] for a in range(0, n, 512)]
    for _ in range(ROUNDS):
        again = np.zeros(axes.shape, np.float64)
        for b in blocks:
            x = dense(b, idf)
            again += x.T @ (x @ axes)
        axes = np.linalg.qr(again)[0].astype(np.float32)
    vectors = np.concatenate([np.zeros((0, axes.shape[1]), np.float32), *(unit(dense(b, idf) @ axes) for b in blocks)])
    own = float(labels.mean()) if n else 0.5
    weight = np.where(labels > 0, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    votes = np.stack([weight * (labels == 0), weight * (labels > 0)], axis=1).astype(np.float32)
    return Model(idf, axes, vectors, votes, share)


def vote(m: Model, bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For every bag: the share of label 1 among the weighted votes of its nearest labelled vectors, and the similarity of
    the nearest. One vote of the general share is always cast, so a text near nothing keeps that share."""
    x = unit(dense(bags, m.idf) @ m.axes)
    if not len(m.vectors):
        return np.full(len(bags), m.base), np.zeros(len(bags))
    near = x @ m.vectors.T
    k = min(NEIGHBOURS, near.shape[1])
    at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
    power = np.clip(np.take_along_axis(near, at, axis=1), 0, 1).astype(np.float64) ** POWER
    cast = (power[:, :, None] * m.votes[at]).sum(axis=1) + np.array([1 - m.base, m.base]) * 0.05
    return cast[:, 1] / cast.sum(axis=1), np.clip(near.max(axis=1), 0, 1)


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, quality of at most DOCS_PER_LABEL documents of either label, chosen by hash from `labels` (doc_id, quality)
    alone; of rows that repeat an id one text counts. Labelled ids without a document make the sample smaller."""
    chosen = hashed_sample(labels.where("quality in (0, 1)"), "quality", DOCS_PER_LABEL, seed=1)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(texts.groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min("text").alias("text")).select("doc_id", "text", "quality"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample: bags are made where the texts are, and come to the driver as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for b in batches:
            bags = [bag(t, features) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([x.astype(np.int32).tobytes() for x, _ in bags], pa.binary()), pa.array([w.tobytes() for _, w in bags], pa.binary())], names=["doc_id", "quality", "at", "weight"])

    rows = sampled(docs, labels).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(run, "doc_id long, quality int, at binary, weight binary").orderBy("doc_id", "quality", "at").toPandas()
    share = labels.where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    bags = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(w, np.float32)) for a, w in zip(rows["at"], rows["weight"], strict=True)]
    return learn(bags, rows["quality"].to_numpy(dtype=float), 0.5 if share is None else float(share))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, similarity (to the nearest labelled document): one row a row of `docs`; only text is read.

    Null and empty texts, and all texts where nothing is labelled, get the share of label 1 (0.5 without labels) and
    similarity 0; repeated rows, null ids and extra columns are allowed; texts are read whole, in chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                score, near = vote(shared.value, [bag(t, features) for t in part.column(1).to_pylist()])
                yield pa.record_batch(
                    [part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(near, pa.float64())],
                    names=["doc_id", "score", "predicted", "similarity"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, similarity double")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, similarity of every row of `documents`, learned from the labels of ids that are
    not held out. Null and empty texts, repeated rows, empty tables as in `score_documents`; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("doc_id is not null and quality is not null").where(crc_mod("doc_id", 4) != 2).distinct()
    scored = score_documents(docs, fit(docs, labels))
    return scored.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "score", "predicted", "similarity")
