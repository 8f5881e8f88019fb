"""Toxicity: maximum-scoring segments of token log-odds, calibrated as extreme values.

A token's score is its log-odds between toxic and other documents with a Dirichlet prior from both (informative, so rare
tokens shrink to 0), less a drift that makes clean text score below zero on average. Tokens too rare to tell take the
log-odds of their first bytes, so unseen forms of a word count. A linear-time scan finds every
maximal scoring segment of a text. For scores under the clean background, lambda solves sum p exp(lambda s) = 1, and a
segment of score S in n tokens has the excess lambda S - ln(K n) over its extreme-value expectation; the excesses of the
significant segments add up, and a logistic map fitted on the training documents turns the sum into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, hashed_sample, table
from .simhash import word_chunks

#: Bound of the training sample: labelled documents of either label; it bounds the tokens that differ, too.
DOCS_PER_LABEL = 8_000
#: Bytes of a token that stand for it where the token itself is too rare; STEM marks them in the tables.
STEM_BYTES, STEM = 5, b"\0"
#: Weight of the prior and its least count of a token (without it a token that one label never has is too uncertain to
#: count), drift of a token, bounds of a token's score, least log-odds z that a token needs to count.
PRIOR, LEAST_PRIOR, DRIFT, LEAST, MOST, LEAST_Z = 5000.0, 0.5, 1.2, -3.0, 6.0, 2.3
EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


@dataclass
class Model:
    scores: dict[bytes, float]  # of the tokens and stems that differ; any other has -DRIFT
    rate: float  # lambda
    log_k: float
    slope: float = 1.0
    shift: float = 0.0
    base: float = 0.0  # share of label 1 in the sample, the score where nothing is known


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words, A-Z lower-cased, without punctuation at their ends, in bounded chunks."""
    for words in word_chunks((text or "").encode("utf-8", "replace").lower(), 0):
        yield [w if w.isalnum() else EDGES.sub(b"", w) for w in words]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time: a candidate extends back over earlier ones while
    the sum before it is less than before the one it absorbs."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total, behind = 0.0, []  # behind[i]: the nearest candidate before i with a smaller sum before it
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = behind[j]
            if j < 0 or stack[j][3] >= total:
                behind[len(stack) :] = [j]
                stack.append((start, i + 1, before, total))
                break
            start, _, before, _ = stack[j]
            del stack[j:], behind[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def passages(m: Model, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
    """Tokens of a text and its significant segments: (first token, end, excess over the extreme-value expectation)."""
    # Between listed tokens every score is the same, so the scan runs over runs: linear, and short on clean text.
    n, at, run = 0, [], []
    get = m.scores.get
    for words in tokens(text):
        for i, w in enumerate(words):
            s = get(w)
            if s is None:
                s = get(STEM + w[:STEM_BYTES])
            if s is not None:
                at.append(n + i)
                run.append(s)
        n += len(words)
    if not at:
        return n, []
    gaps = -DRIFT * (np.diff(np.array([-1, *at])) - 1)
    scan = np.empty(2 * len(at))
    scan[0::2], scan[1::2] = gaps, run
    floor = m.log_k + np.log(max(n, 2))
    found = [(at[a // 2], at[(b - 1) // 2] + 1, m.rate * s - floor) for a, b, s in segments(scan.tolist())]
    return n, [x for x in found if x[2] > 0]


def evidence(m: Model, text: str | None) -> float:
    """Sum of the excesses, on a scale that grows with its logarithm."""
    return float(np.log1p(sum(e for _, _, e in passages(m, text)[1])))


def _probability(m: Model, x: float) -> float:
    return float(1 / (1 + np.exp(-(m.slope * x + m.shift))))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most DOCS_PER_LABEL documents of either label. The ids are chosen by hash from `labels` (doc_id,
    toxic) alone and broadcast, so the documents are read once and only the sample is written; of rows that repeat an id
    one text counts. Labelled ids without a document make the sample smaller."""
    chosen = hashed_sample(labels.where("toxic in (0, 1)"), "toxic", DOCS_PER_LABEL)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(texts.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text")).select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample: tokens are counted where they are, and only those that differ come to the driver. A token
    counts from 4 documents of the sample on, and its first bytes stand for rarer ones."""
    rows = sampled(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in tokens(text):
                    # Documents, not occurrences: a word repeated in one document is one piece of evidence.
                    own = set(words)
                    seen[toxic].update(own)
                    seen[toxic].update({STEM + w[:STEM_BYTES] for w in own if len(w) > STEM_BYTES})
            for toxic, c in enumerate(seen):
                yield pa.record_batch([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64()), pa.array([toxic] * len(c), pa.int32())], names=["token", "n", "toxic"])

    by_token = rows.mapInArrow(count, "token binary, n long, toxic int").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0")).where("y0 + y1 >= 4")
    by_token = by_token.persist()
    n1, n0 = (float(x or 0) for x in by_token.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        by_token.unpersist()
        known = rows.agg(F.avg("toxic")).first()[0]
        base = float(np.clip(0.0 if known is None else known, 1e-3, 1 - 1e-3))
        return Model({}, 1.0, 0.0, 0.0, float(np.log(base / (1 - base))), base)
    prior = LEAST_PRIOR + PRIOR * (F.col("y0") + F.col("y1")) / (n0 + n1)
    odds = lambda y, n: F.log((y + prior) / (n + PRIOR - y - prior))
    delta = odds(F.col("y1"), n1) - odds(F.col("y0"), n0)
    z = delta / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    found = by_token.select("token", "y0", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy("token").toPandas()
    by_token.unpersist()
    score = (found["delta"].clip(LEAST, MOST) - DRIFT).to_numpy()
    share = np.append(found["y0"].to_numpy() / n0, 0)
    share[-1] = max(1e-9, 1 - share.sum())
    m = Model({bytes(t): float(s) for t, s in zip(found["token"], score, strict=True)}, *_extremes(np.append(score, -DRIFT), share))
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([evidence(shared.value, t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "toxic"])

    seen = rows.mapInArrow(measure, "x double, toxic int").orderBy("x", "toxic").toPandas()
    share1 = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    _logistic(m, seen["x"].to_numpy(), seen["toxic"].to_numpy(float), float(share1))
    return m


def _extremes(score: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """lambda and ln K of the background: scores with their shares. K by the usual bound from a segment's first step."""
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float((share * np.exp(np.minimum(mid * score, 700))).sum()) < 1 else (lo, mid)
    rate = lo
    drift, gain = -float((share * score).sum()), float((share * score * np.exp(np.minimum(rate * score, 700))).sum())
    return rate, float(np.log(max(1e-6, max(drift, 1e-6) ** 2 / max(gain, 1e-6))))


def _logistic(m: Model, x: np.ndarray, y: np.ndarray, share: float) -> None:
    """Fit probability = logistic(slope x + shift), the labels weighted to their share among all training documents."""
    own = float(y.mean())
    w = np.where(y > 0, share / own, (1 - share) / (1 - own)) if 0 < own < 1 else np.ones_like(y)
    a = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-f @ a))
        h = (f * (w * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        a += np.linalg.solve(h, f.T @ (w * (y - p)) - 1e-3 * a)
    m.slope, m.shift, m.base = float(a[0]), float(a[1]), share


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, n_passages, worst_start, worst_end: one row a row of `docs`; only text is read.

    n_passages counts significant segments, worst_* are the tokens of the one with the largest excess (null if none).
    Null and empty texts get the score of a text without evidence; repeated rows, null ids and extra columns are allowed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [passages(m, t)[1] for t in b.column(1).to_pylist()]
            score = [_probability(m, float(np.log1p(sum(e for _, _, e in f)))) for f in found]
            worst = [max(f, key=lambda x: x[2]) if f else (None, None, 0) for f in found]
            yield pa.record_batch(
                [b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(map(len, found), pa.int64()), pa.array([w[0] for w in worst], pa.int64()), pa.array([w[1] for w in worst], pa.int64())],
                names=["doc_id", "score", "predicted", "n_passages", "worst_start", "worst_end"],
            )

    schema = "doc_id long, score double, predicted int, n_passages long, worst_start long, worst_end long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, worst_start, worst_end of every row of `documents`, learned from the
    labels of ids that are not held out. Null and empty texts, repeated rows and empty tables as in `score_documents`; a
    null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 4) != 2).distinct()
    scored = score_documents(docs, fit(docs, labels))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted", "n_passages", "worst_start", "worst_end")
