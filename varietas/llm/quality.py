"""Quality classifier: supervised subword embeddings.

A document is the bag of its words (``WORDS``; a word equal to the one before it becomes one shared
"again" token, so repetition is a feature of its own), its word pairs and its character n-grams of
``GRAMS`` code points, white space included.  Every feature is hashed into one of ``BUCKETS`` learned
vectors of ``DIM`` numbers; the document's vector is their average over all occurrences, and a softmax
layer gives the class.  Vectors and layer are trained together by numpy mini-batch stochastic
gradient descent (Adagrad steps, fixed seed) on a bounded labelled sample: at most ``PER_LABEL``
documents of each label and ``MAX_CHARS`` characters each.

Scoring a linear layer on an average needs only each bucket's projection on the layer, so tasks
receive one number per bucket (a fixed 1 MB) and read every byte of every text.  Labels, language,
source and id are not inputs.  A null or empty text has no feature and gets the bias alone; without
labelled rows every score is 0.5 and, with one label only, that label's.  Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import Bytes, blocks, fold, map_batches, mix
from varietas.llm.sample import labelled_sample

GRAMS = (3, 4)
BUCKETS, DIM = 1 << 18, 8
PER_LABEL, MAX_CHARS = 2_000, 60_000
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.3, 7


def features(b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature occurrence."""
    mask = np.uint64(BUCKETS - 1)
    start, end, doc = b.words()
    h = b.span_hash(start, end)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    h = np.where(again, np.uint64(0xA6A1), h)
    docs, out = [doc], [mix(h, 40) & mask]
    pair = doc[1:] == doc[:-1]
    docs.append(doc[1:][pair])
    out.append(mix(mix(h[:-1], 41) + h[1:], 42)[pair] & mask)
    point = np.flatnonzero((b.data & 0xC0) != 0x80)
    point_doc = np.searchsorted(b.doc_start, point, "right") - 1
    point = np.append(point, len(b.data))
    for n in GRAMS:
        if len(point_doc) < n:
            continue
        inside = point_doc[:len(point_doc) - n + 1] == point_doc[n - 1:]
        docs.append(point_doc[:len(point_doc) - n + 1][inside])
        out.append(mix(b.span_hash(point[:-n][inside], point[n:][inside]), 50 + n) & mask)
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def _rows(texts: pa.Array):
    """Per text: (distinct buckets, share of the text's occurrences)."""
    for lo, hi, b in blocks(texts):
        doc, bucket = features(b)
        key = np.sort(doc * BUCKETS + bucket)
        edge = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
        count = np.diff(edge, prepend=-1)
        d, f = key[edge] // BUCKETS, key[edge] % BUCKETS
        at = np.searchsorted(d, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            c = count[at[i]:at[i + 1]].astype(np.float32)
            yield f[at[i]:at[i + 1]], c / max(c.sum(), 1.0)


def train(texts: list[str], label: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(projection per bucket, bias): log-odds of label 1 = bias + mean projection of a text's features."""
    if len(texts) == 0:
        return np.zeros(BUCKETS, np.float32), 0.0
    rows = list(_rows(pa.array(texts, pa.large_string())))
    y = np.asarray(label, np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.log(np.bincount(y, minlength=2) + 1.0).astype(np.float32)
    g_emb, g_layer, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            batch = order[lo:lo + BATCH]
            f = np.concatenate([rows[i][0] for i in batch])
            w = np.concatenate([rows[i][1] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            part = emb[f] * w[:, None]
            hidden = np.stack([np.bincount(of, weights=part[:, k], minlength=len(batch)) for k in range(DIM)], axis=1).astype(np.float32)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            d_hidden = p @ layer.T
            d_layer, d_bias = hidden.T @ p / len(batch), p.mean(axis=0)
            g_layer += d_layer ** 2
            g_bias += d_bias ** 2
            layer -= RATE * d_layer / np.sqrt(g_layer)
            bias -= RATE * d_bias / np.sqrt(g_bias)
            # a bucket's gradient, summed over the batch
            used, place = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(place, weights=w * d_hidden[of, k], minlength=len(used)) for k in range(DIM)], axis=1).astype(np.float32)
            g_emb[used] += (grad ** 2).mean(axis=1)
            emb[used] -= RATE * grad / np.sqrt(g_emb[used])[:, None]
    return emb @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def score_texts(column: pa.Array, projection: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for lo, hi, b in blocks(column):
        doc, bucket = features(b)
        n = np.bincount(doc, minlength=hi - lo)
        # the newline behind each document is not part of it but gives an empty text no feature of its own
        total = np.bincount(doc, weights=projection[bucket], minlength=hi - lo)
        out.append(_sigmoid(bias + total / np.maximum(n, 1)))
    return np.concatenate(out)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learn from labelled rows outside the held-out fold, score every text."""
    texts, marks = labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1, PER_LABEL, MAX_CHARS)
    projection, bias = train(texts, marks)
    shared = docs.sparkSession.sparkContext.broadcast((projection.astype(np.float32), bias))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": score_texts(batch.column("text"), *shared.value)}
    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
