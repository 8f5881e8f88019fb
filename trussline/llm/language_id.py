"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Training runs backpropagation through time on windows of bytes, every position labelled with its document's language.
Prediction cuts whole texts into segments, labels every byte from what precedes and follows it in its segment, and
pools the positions' probabilities over the document. Arrays are laid out [direction, feature, segment].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import crc_mod, hashed_sample, table

HIDDEN, PAD = 8, 256
#: Bounds of the training sample: labelled documents of a language, labelled windows of a language, bytes of a window.
DOCS_PER_LANG, WINDOWS_PER_LANG, WINDOW = 600, 3600, 48
#: Windows of a text that are ranked at once.
RANKED = 1 << 20
STEPS, BATCH, RATE, SEED = 160, 384, 0.02, 7
#: Segment length of a prediction, segments run at once, and bytes (whole segments) laid out at once.
SEGMENT, SEGMENTS, LAID = 128, 2048, 8 << 20
#: Bytes of short texts that are predicted together.
GROUP = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    """langs; x: byte -> gate inputs [2, 257, 3H]; u: state -> gates [2, 3H, H]; o: states -> logits [2, C, H]; b [C, 1]."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    b: np.ndarray


def _step(gates: np.ndarray, h: np.ndarray, u: np.ndarray):
    """One step of both directions; gates hold the byte's inputs and are used up. Returns z, r, candidate, U_n h, h'."""
    k = h.shape[1]
    a = u @ h
    zr = gates[:, : 2 * k]
    zr += a[:, : 2 * k]
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    z, r, un = zr[:, :k], zr[:, k:], a[:, 2 * k :]
    n = gates[:, 2 * k :]
    n += r * un
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return z, r, n, un, new


def _inputs(m: Model, seg: np.ndarray, t: int) -> np.ndarray:
    """Gate inputs of both directions at step t, [2, 3H, B]; the second direction reads from the end."""
    out = np.empty((2, m.x.shape[2], seg.shape[1]), m.x.dtype)
    out[0] = m.x[0].take(seg[t], axis=0).T
    out[1] = m.x[1].take(seg[-1 - t], axis=0).T
    return out


def _softmax(v: np.ndarray) -> np.ndarray:
    v -= v.max(axis=-2, keepdims=True)
    np.exp(v, out=v)
    v /= v.sum(axis=-2, keepdims=True)
    return v


def gradients(m: Model, seg: np.ndarray, want: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the positions of segments [T, B] that are not padding, and its gradients by x, u, o and b:
    backpropagation through time in both directions."""
    k = m.u.shape[2]
    n_steps, n_rows = seg.shape
    h, kept, hs = np.zeros((2, k, n_rows), m.x.dtype), [], np.empty((n_steps, 2, k, n_rows), m.x.dtype)
    for t in range(n_steps):
        z, r, n, un, new = _step(_inputs(m, seg, t), h, m.u)
        kept.append((h, z, r, n, un))
        h = hs[t] = new
    back = hs[::-1, 1]
    p = _softmax(m.o[0] @ hs[:, 0] + m.o[1] @ back + m.b)
    real = seg != PAD
    loss = -float(np.log(p[:, want, np.arange(n_rows)][real] + 1e-30).sum()) / max(1, real.sum())
    p[:, want, np.arange(n_rows)] -= 1
    p *= real[:, None, :] / max(1, real.sum())
    grads = [np.zeros_like(m.x), np.zeros_like(m.u), np.stack([np.einsum("tcb,tkb->ck", p, hs[:, 0], optimize=True), np.einsum("tcb,tkb->ck", p, back, optimize=True)]), p.sum(axis=(0, 2))[:, None]]
    out = np.stack([m.o[0].T @ p, (m.o[1].T @ p)[::-1]], axis=1)
    carry, inputs = np.zeros_like(h), np.empty((n_steps, 2, 3 * k, n_rows), m.x.dtype)
    for t in range(n_steps - 1, -1, -1):
        h, z, r, n, un = kept[t]
        dh = out[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        grads[1] += da @ h.transpose(0, 2, 1)
        carry = dh * z + m.u.transpose(0, 2, 1) @ da
        inputs[t] = np.concatenate([dz, dr, dn], axis=1)
    for d, bytes_ in enumerate((seg, seg[::-1])):
        flat = inputs[:, d].transpose(1, 0, 2).reshape(3 * k, -1)
        for f in range(3 * k):
            grads[0][d, :, f] = np.bincount(bytes_.reshape(-1), flat[f], 257)
    grads[0][:, PAD] = 0
    return loss, grads


def started(langs: list[str], rng: np.random.Generator) -> Model:
    """Random parameters."""
    k, c = HIDDEN, len(langs)
    m = Model(langs, *(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (2, 257, 3 * k)), (0.3, (2, 3 * k, k)), (0.3, (2, c, k)))), np.zeros((c, 1), np.float32))
    m.x[:, PAD] = 0
    m.x[:, PAD, :k] = 30  # an open update gate: padding leaves the state as it is
    return m


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS) -> Model:
    """Fit on windows [N, T] of bytes (PAD where a text ended) and their language numbers; languages weigh alike."""
    rng = np.random.default_rng(SEED)
    m = started(langs, rng)
    params = [m.x, m.u, m.o, m.b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = [np.flatnonzero(labels == i) for i in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(r, BATCH // len(langs) + 1) for r in rows])
        _, grads = gradients(m, windows[pick].T.astype(np.int64), labels[pick])
        scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads))))
        rate = RATE * (1 - 0.9 * step / steps)
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g * scale - a)
            b += 0.01 * ((g * scale) ** 2 - b)
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def label_positions(m: Model, seg: np.ndarray) -> np.ndarray:
    """Probabilities of every position of segments [T, B]: [T, C, B]."""
    n_steps, n_rows = seg.shape
    h = np.zeros((2, HIDDEN, n_rows), np.float32)
    logits = np.zeros((n_steps, len(m.langs), n_rows), np.float32)
    for t in range(n_steps):
        h = _step(_inputs(m, seg, t), h, m.u)[4]
        both = m.o @ h
        logits[t] += both[0]
        logits[n_steps - 1 - t] += both[1]
    logits += m.b
    return _softmax(logits)


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities [documents, C] over all positions of each text; zeros for an empty one. Long texts are laid out in
    pieces of whole segments, which changes nothing but what is held at a time."""
    total = np.zeros((len(texts), len(m.langs)))
    for group in _laid(texts):
        n_segs = np.array([-(-len(part) // SEGMENT) for _, part in group])
        # The pieces in one row of bytes, each padded to whole segments.
        flat = np.full(int(n_segs.sum()) * SEGMENT, PAD, np.int16)
        for s, (_, part) in zip(np.cumsum(n_segs) - n_segs, group, strict=True):
            flat[s * SEGMENT : s * SEGMENT + len(part)] = np.frombuffer(part, np.uint8)
        seg, owner = flat.reshape(-1, SEGMENT), np.repeat([i for i, _ in group], n_segs)
        for k in range(0, len(seg), SEGMENTS):
            rows = np.ascontiguousarray(seg[k : k + SEGMENTS].T)
            p = label_positions(m, rows)
            p *= (rows != PAD)[:, None, :]
            np.add.at(total, owner[k : k + SEGMENTS], p.sum(axis=0).T)
    return total / np.maximum([len(t) for t in texts], 1)[:, None]


def _laid(texts: list[bytes]) -> Iterator[list[tuple[int, memoryview]]]:
    """(number of the text, piece of it) in order, in groups of under two times LAID bytes; empty texts have no piece."""
    group, held = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), LAID):
            group.append((i, memoryview(t)[a : a + LAID]))
            held += len(group[-1][1])
            if held >= LAID:
                yield group
                group, held = [], 0
    if group:
        yield group


def drawn(raw: bytes) -> list[tuple[int, bytes]]:
    """(rank, bytes) of the windows of a text that rank lowest, WINDOWS_PER_LANG at most. The windows follow each other from
    the first byte to the last, and a rank is a hash of the whole text and the window's number."""
    n = -(-len(raw) // WINDOW)
    best, ranks = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for a in range(0, n, RANKED):
        at = np.arange(a, min(n, a + RANKED))
        x = (at.astype(np.uint64) + np.uint64(xxhash.xxh64_intdigest(raw, SEED))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        best, ranks = np.r_[best, at], np.r_[ranks, x ^ (x >> np.uint64(29))]
        if len(best) > WINDOWS_PER_LANG:
            lowest = np.argpartition(ranks, WINDOWS_PER_LANG)[:WINDOWS_PER_LANG]
            best, ranks = best[lowest], ranks[lowest]
    return [(r, raw[i * WINDOW : (i + 1) * WINDOW]) for i, r in zip(best.tolist(), (ranks >> np.uint64(1)).tolist(), strict=True)]


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels to learn from. `docs` has doc_id, text, lang.

    A labelled row is a window: DOCS_PER_LANG labelled documents a language are cut, as whole texts, into windows, and the
    WINDOWS_PER_LANG windows of a language that hash lowest are taken. Every byte of a chosen text can be drawn, and the
    sample fits the driver whatever the size of the table."""
    chosen = hashed_sample(docs.where("lang is not null and doc_id is not null"), "lang", DOCS_PER_LANG, SEED)

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                windows = drawn((text.as_py() or "").encode("utf-8", "replace"))
                yield pa.record_batch([pa.array([lang.as_py()] * len(windows), pa.string()), pa.array([r for r, _ in windows], pa.int64()), pa.array([w for _, w in windows], pa.binary())], names=["lang", "rank", "bytes"])

    # At most DOCS_PER_LANG ids a language are broadcast; of rows that repeat an id one text counts.
    sample = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])
    windows = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang").mapInArrow(cut_windows, "lang string, rank long, bytes binary")
    order = Window.partitionBy("lang").orderBy("rank", "bytes")
    rows = windows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= WINDOWS_PER_LANG).select("lang", "bytes").toPandas()
    rows = rows.sort_values(["lang", "bytes"])
    langs = sorted(rows["lang"].unique())
    windows = np.full((len(rows), WINDOW), PAD, np.int16)
    for i, w in enumerate(rows["bytes"]):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    return windows, rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), langs


def identify(docs: DataFrame, labelled: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred, score and the `keep` columns of `docs`, one row a row.

    Learns from `labelled` (doc_id, text, lang); only `text` of `docs` is read by the prediction. Null texts and texts
    without a letter are `und` with score 0, as is everything if nothing is labelled; the score is the mean probability
    of the predicted language over all bytes. Repeated rows, null ids and extra columns are allowed."""
    windows, labels, langs = training_windows(labelled)
    # A kept text is sent once.
    text, kept = F.col("text").cast("string"), [c for c in keep if c != "text" or docs.schema[c].dataType != StringType()]
    named = {f"k{i}": c for i, c in enumerate(kept)} | ({"text": "text"} if len(kept) < len(keep) else {})
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"), text.alias("text"))
    if not langs:
        return rows.withColumnsRenamed(named).select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(train(windows, labels, langs))
    out = [*(f"k{i}" for i in range(len(kept))), *(["text"] if "text" in named else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            known, start = b.column("known").to_numpy(zero_copy_only=False), 0
            for group in _groups(known, b.column("text")):
                p = pooled(m, group)
                part, ok = b.slice(start, len(group)), known[start : start + len(group)]
                start += len(group)
                pred = [m.langs[i] if k else UNKNOWN for i, k in zip(p.argmax(axis=1), ok, strict=True)]
                score = np.where(ok, p.max(axis=1), 0.0).clip(0, 1).astype(float)
                yield pa.record_batch([*(part.column(c) for c in out), pa.array(pred, pa.string()), pa.array(score)], names=[*out, "lang_pred", "score"])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in out), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema).withColumnsRenamed(named).select(*keep, "lang_pred", "score")


def _groups(known: np.ndarray, texts: pa.Array) -> Iterator[list[bytes]]:
    """The bytes of the texts in order (none of those that are not known), in groups of about GROUP, so that segments fill
    whole batches and memory is bounded however many rows arrive at once."""
    group, held = [], 0
    for k, t in zip(known, texts, strict=True):
        group.append((t.as_py() or "").encode("utf-8", "replace") if k else b"")
        held += len(group[-1])
        if held > GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `documents`, learned from the rows that are not held out. Null and
    empty texts, repeated rows and empty tables as in `identify`; a null id is not held out, and nothing is learned from it."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(crc_mod("doc_id", 5) != 0), keep=("doc_id",))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
