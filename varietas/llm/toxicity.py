"""Toxicity: a counterfactual-regularised sentence classifier.

A text is cut into sentences (at ``. ! ?`` and line ends, and every ``SENTENCE_WORDS`` words); a
sentence's log-odds are a bias plus the weights of its words' features, and a document is as toxic as
its most toxic sentence.  A word's features are the word itself and its beginnings of ``PREFIXES``
characters, so inflected and compounded forms share weight.

*Training* (numpy, on the driver, from a bounded labelled sample of at most ``PER_LABEL`` documents of
each label and ``MAX_CHARS`` characters).  Features are first selected step by step: the feature whose
document frequency differs most significantly between the toxic documents not yet explained and the
others, until none is significant; this keeps words that merely occur in copies of a toxic document
out.  Their weights and the bias are then fitted by logistic gradient descent in which a document's
gradient goes to its currently highest sentence.

*Counterfactuals.*  In labelled sentences identity terms are swapped for others of the list; sentences
without one get a mention inserted.  ``LAMBDA`` times the squared change of the log-odds is added to
the loss, so identity terms are pushed to weigh the same and next to nothing, however often the term
occurs in toxic training text.  An identity term has no beginnings among its features, in training and
in scoring, so its weight is its whole score and the penalty acts on all of it.

Words are runs of letters and digits, lower-cased (A-Z); features are 64-bit hashes and the model is a
table of at most ``MAX_FEATURES``, which tasks look up for every word of every text.  Labels, language,
source and id are not inputs.  A null or empty text has no sentence and gets the bias; without
labelled rows every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import Bytes, blocks, fold, map_batches
from varietas.llm.sample import labelled_sample

PER_LABEL, MAX_CHARS, MAX_FEATURES = 3_000, 60_000, 2_000
PREFIXES = (4, 5, 6, 7, 8)
SENTENCE_WORDS = 32
STEPS, RATE, DECAY, LAMBDA, SEED = 80, 0.5, 0.1, 1.0, 3
#: A feature needs this many unexplained toxic documents and this significance to be selected.
MIN_DOCS, MIN_Z = 4, 6.0

# Neutral identity terms that counterfactual sentences swap.
IDENTITY_TERMS = """
women men woman man girls boys female male
gay lesbian straight bisexual transgender queer
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
black white asian latino african european american arab
french german spanish english turkish chinese indian
immigrants refugees foreigners natives
disabled blind deaf old young elderly teenagers
frauen männer schwule lesben muslime christen juden ausländer
femmes hommes musulmans chrétiens juifs étrangers
mujeres hombres musulmanes cristianos judíos extranjeros
""".split()

_WORD = np.ones(256, bool)                  # separators of words: every ASCII byte but letters and digits
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentences(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes (words, 1 + prefixes; 0 for none), index of each word's sentence, document of each sentence)."""
    low = b.lower_ascii()
    start, end, doc = low.words(_WORD)
    h = np.zeros((len(start), 1 + len(PREFIXES)), np.uint64)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    h[:, 0] = low.span_hash(start, end)
    is_point = (low.data & 0xC0) != 0x80
    point = np.append(np.flatnonzero(is_point), np.full(max(PREFIXES), len(low.data)))
    first_point = np.cumsum(is_point)[start] - 1
    for k, n in enumerate(PREFIXES, 1):
        cut = point[first_point + n]
        has = cut < end
        h[has, k] = low.span_hash(start[has], cut[has])
    stops = np.cumsum(_STOP[b.data])[start]
    new = np.ones(len(h), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    within = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    new |= within % SENTENCE_WORDS == 0
    return h, np.cumsum(new) - 1, doc[new]


def term_hashes(terms: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([sentences(b)[0][:, 0] for _, _, b in blocks(pa.array(terms, pa.large_string()))]))


def select_features(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int) -> dict[int, float]:
    """Feature -> log-odds, chosen one at a time; (doc, feature) are distinct occurrences.

    After each choice the toxic documents that hold the feature count as explained.
    """
    negative = np.bincount(feature[~y[doc]], minlength=n_features)
    n_neg, n_all = max(int((~y).sum()), 1), max(int(y.sum()), 1)
    total = np.bincount(feature[y[doc]], minlength=n_features)
    left = y.copy()
    pair = y[doc]
    doc, feature = doc[pair], feature[pair]
    chosen: dict[int, float] = {}
    while len(chosen) < MAX_FEATURES and left.any():
        n_pos = int(left.sum())
        positive = np.bincount(feature, minlength=n_features)
        share = (positive + negative) / (n_pos + n_neg)
        z = (positive / n_pos - negative / n_neg) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_neg))
        z[positive < MIN_DOCS] = 0
        best = int(np.argmax(z))
        if z[best] < MIN_Z:
            break
        chosen[best] = float(np.log((total[best] + 0.5) / (n_all + 1)) - np.log((negative[best] + 0.5) / (n_neg + 1)))
        left[doc[feature == best]] = False
        keep = left[doc]
        doc, feature = doc[keep], feature[keep]
    return chosen


def train(texts: list[str], label: np.ndarray, terms: list[str] = IDENTITY_TERMS, penalty: float = LAMBDA,
          seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, weights, bias)."""
    distinct = list({t: i for i, t in enumerate(texts)}.values())          # copies of a text teach once
    texts, label = [texts[i] for i in distinct], np.asarray(label)[distinct]
    if len(texts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0), -30.0
    hashes, word_rows, sentence_of, doc_of, n_sentences = [], [], [], [], 0
    for lo, _, b in blocks(pa.array(texts, pa.large_string())):
        h, s, d = sentences(b)
        # a word's features are kept once, its occurrences by the word's hash only
        hashes.append(h[:, 0].copy())
        word_rows.append(h[np.unique(h[:, 0], return_index=True)[1]])
        sentence_of.append((s + n_sentences).astype(np.int32))
        doc_of.append(d + lo)
        n_sentences += len(d)
    sent, doc, word_rows = np.concatenate(sentence_of), np.concatenate(doc_of), np.concatenate(word_rows)
    y = label.astype(bool)
    # distinct words, each with its features
    distinct, first = np.unique(word_rows[:, 0], return_index=True)
    h = word_rows[first]
    if terms:
        h[np.isin(distinct, term_hashes(terms)), 1:] = 0
    word = np.concatenate([np.searchsorted(distinct, x).astype(np.int32) for x in hashes])
    del hashes, word_rows
    vocab, of_word = np.unique(np.concatenate((h.reshape(-1), term_hashes(terms) if terms else np.zeros(0, np.uint64))), return_inverse=True)
    n_words, width, n_features = len(first), h.shape[1], len(vocab)
    identity = of_word[n_words * width:]
    of_word = of_word[:n_words * width].reshape(n_words, width)
    none = int(np.searchsorted(vocab, 0)) if 0 in vocab else -1
    key = np.unique(doc[sent] * max(n_words, 1) + word)
    pairs = np.repeat(key // max(n_words, 1), width) * n_features + of_word[key % max(n_words, 1)].reshape(-1)
    skip = np.zeros(n_features, bool)
    skip[[*identity, *([none] if none >= 0 else [])]] = True
    pairs = np.unique(pairs[~skip[pairs % n_features]])
    chosen = select_features((pairs // n_features).astype(np.int32), (pairs % n_features).astype(np.int32), y, n_features)
    del key, pairs
    known = np.zeros(n_features, bool)
    known[[*chosen, *identity]] = True
    weight = np.zeros(n_features)
    weight[list(chosen)] = list(chosen.values())
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) - 1.0
    # counterfactual pairs: an identity word of a labelled sentence and its swap, or an inserted mention and none
    rng = np.random.default_rng(seed)
    has = of_word[word, 0][np.isin(of_word[word, 0], identity)]
    swaps = rng.choice(identity, len(has)) if len(identity) else has
    mentions = rng.choice(identity, min(2_000, max(n_sentences, 1))) if len(identity) else np.zeros(0, np.int64)
    first_sentence = np.searchsorted(doc, np.arange(len(y) + 1))
    full = np.flatnonzero(np.diff(first_sentence) > 0)
    first_word = np.searchsorted(sent, np.arange(n_sentences + 1))
    g_weight, g_bias = np.full(n_features, 1e-3), 1e-3
    for _ in range(STEPS):
        z = np.add.reduceat(weight[of_word].sum(axis=1)[word], first_word[:-1]) if n_sentences else np.zeros(0)
        top = np.maximum.reduceat(z, first_sentence[:-1][full]) if len(full) else np.zeros(0)
        best = np.zeros(len(y))
        best[full] = top
        err = 1 / (1 + np.exp(-np.clip(bias + best, -30, 30))) - y
        # the first of a document's highest sentences carries its gradient
        is_top = np.flatnonzero(z == np.repeat(top, np.diff(first_sentence)[full]))
        highest = is_top[np.unique(doc[is_top], return_index=True)[1]]
        token = np.concatenate([np.arange(first_word[s], first_word[s + 1]) for s in highest]) if len(highest) else np.zeros(0, np.int64)
        grad = np.bincount(of_word[word[token]].reshape(-1), weights=np.repeat(err[doc[sent[token]]], width), minlength=n_features) / len(y)
        if penalty and len(identity):
            change = weight[swaps] - weight[has]
            scale = 2 * penalty / max(len(swaps) + len(mentions), 1)
            grad += scale * (np.bincount(swaps, weights=change, minlength=n_features) - np.bincount(has, weights=change, minlength=n_features))
            grad += scale * np.bincount(mentions, weights=weight[mentions], minlength=n_features)
        grad = np.where(known, grad + DECAY * weight / len(y), 0.0)
        g_weight += grad ** 2
        g_bias += err.mean() ** 2
        weight -= RATE * grad / np.sqrt(g_weight)
        bias -= RATE * err.mean() / np.sqrt(g_bias)
    used = np.flatnonzero(known & (np.abs(weight) > 1e-3))
    return vocab[used], weight[used], bias


class Table:
    """Weights by 64-bit hash; a bit table turns most hashes away before the sorted lookup."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, whole: np.ndarray, bits: int = 20):
        self.keys, self.weights, self.whole, self.mask = keys, weights, whole, np.uint64((1 << bits) - 1)
        self.may = np.zeros(1 << bits, bool)
        self.may[(keys & self.mask).astype(np.int64)] = True

    def sums(self, h: np.ndarray) -> np.ndarray:
        """Sum of the weights of every row of feature hashes; words of ``whole`` count without their beginnings."""
        out = np.zeros(len(h))
        row, column = np.nonzero(self.may[(h & self.mask).astype(np.int64)])
        if len(row) and len(self.keys):
            own = (column == 0) | ~np.isin(h[row, 0], self.whole)
            row, column = row[own], column[own]
            x = h[row, column]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            out += np.bincount(row, weights=np.where(self.keys[at] == x, self.weights[at], 0.0), minlength=len(h))
        return out


def score_texts(column: pa.Array, keys: np.ndarray, weights: np.ndarray, bias: float, terms: list[str] = IDENTITY_TERMS) -> np.ndarray:
    table, out = Table(keys, weights, term_hashes(terms) if terms else np.zeros(0, np.uint64)), []
    for lo, hi, b in blocks(column):
        h, sent, doc = sentences(b)
        z = np.full(hi - lo, -np.inf)
        if len(h):
            np.maximum.at(z, doc, np.bincount(sent, weights=table.sums(h), minlength=len(doc)))
        z[np.isinf(z)] = 0.0
        out.append(1 / (1 + np.exp(-np.clip(bias + z, -30, 30))))
    return np.concatenate(out)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learn from labelled rows outside the held-out fold, score every text."""
    texts, marks = labelled_sample(docs, labels, "toxic", fold("doc_id", 4) != 2, PER_LABEL, MAX_CHARS)
    model = train(texts, marks)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": score_texts(batch.column("text"), *shared.value)}
    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
