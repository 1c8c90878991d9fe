"""Language identification by rank-order profiles.

A profile is the ``TOP`` most frequent character n-grams (one to three letters, words padded with a
blank) in order of frequency, ties by the n-gram.  A document's language is the one whose profile is
nearest by out-of-place distance: the sum over the document's profile of how far each n-gram's rank
is from its rank in the language (``TOP`` where it is missing); ties go to the smaller name.

Language profiles are counted over all learning documents: tasks count their documents' n-grams per
language and one aggregation adds the partial counts; the driver gets ``TOP`` rows per language.
Text is lower-cased by code point; everything but letters is a blank.  The score is how much nearer
the best language is than the next: second / (first + second), from 0.5 to 1 (1 with one language);
a text that is null or has no letter is ``und`` with score 0.  With no learning documents all texts
are ``und``.  Learning rows with a null language, and null texts, teach nothing.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import fold, map_batches

TOP = 400
BLOCK_CHARS = 1 << 20
_BITS = 21

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        for c in range(0x110000):
            table[c] = unicodedata.category(chr(c))[0] == "L"
        _letters.append(table)
    return _letters[0]


def _runs(texts: list[str], size: int = BLOCK_CHARS):
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if texts:
        yield lo, len(texts)


def gram_counts(texts: list[str]):
    """Yield (first, end, group, gram, count) for runs of texts: distinct n-grams per text, sorted by (text, gram).

    An n-gram is its code points packed in 21 bits each, first letter highest, a blank being 0.
    """
    letter = _is_letter()
    for lo, hi in _runs(texts):
        joined = " " + " ".join(t.lower() + " " for t in texts[lo:hi])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # str.lower may change a text's length, so starts are taken from the lowered texts
        sizes = np.array([len(t.lower()) + 2 for t in texts[lo:hi]])
        group = np.repeat(np.arange(hi - lo), sizes)[:len(code)]
        group = np.concatenate((group, np.full(len(code) - len(group), hi - lo - 1)))
        code = np.where(letter[code], code, 0)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code, group = code[keep], group[keep]
        alphabet, small_code = np.unique(code, return_inverse=True)
        a = len(alphabet)
        if a < 2:
            yield lo, hi, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        x = small_code.astype(np.int64)
        blank = int(np.searchsorted(alphabet, 0)) if alphabet[0] == 0 else -1
        is_blank = x == blank
        keys = []
        width = (a + 1) ** 3
        g = group.astype(np.int64) * width
        one = ~is_blank
        # symbols are 1..a inside a key, 0 pads shorter n-grams in front
        keys.append((g + (x + 1))[one])
        two = ~(is_blank[:-1] & is_blank[1:])
        keys.append((g[1:] + (x[:-1] + 1) * (a + 1) + (x[1:] + 1))[two])
        three = ~is_blank[1:-1]
        keys.append((g[2:] + (x[:-2] + 1) * (a + 1) ** 2 + (x[1:-1] + 1) * (a + 1) + (x[2:] + 1))[three])
        ordered = np.sort(np.concatenate(keys))
        edge = np.flatnonzero(np.concatenate((ordered[1:] != ordered[:-1], [True])))
        count = np.diff(edge, prepend=-1)
        key = ordered[edge]
        doc, key = key // width, key % width
        symbol = np.concatenate(([0], alphabet + 1))
        gram = (symbol[key // (a + 1) ** 2] << (2 * _BITS)) | (symbol[key // (a + 1) % (a + 1)] << _BITS) | symbol[key % (a + 1)]
        yield lo, hi, doc, gram, count


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """Profile n-grams in rank order by language, counted over every row with a language and a text."""
    d = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")

    def count(batch: pa.RecordBatch) -> dict:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        of = {x: i for i, x in enumerate(names)}
        index = np.array([of[x] for x in langs])
        texts = batch.column("text").to_pylist()
        total: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for lo, _, doc, gram, n in gram_counts(texts):
            parts = (index[lo + doc], gram, n)
            total = parts if total is None else tuple(np.concatenate(p) for p in zip(total, parts, strict=True))
            total = _added(*total)
        lang, gram, n = total
        return {"lang": [names[i] for i in lang], "gram": gram, "n": n}

    sums = map_batches(d, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = sums.withColumn("rank", rank).where(F.col("rank") <= top).orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _added(lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])))) if len(lang) else np.zeros(0, int)
    return (lang[new], gram[new], np.add.reduceat(n, new)) if len(new) else (lang, gram, n)


def classify(texts: list[str], known: dict[str, np.ndarray], top: int = TOP) -> tuple[list[str], np.ndarray]:
    """(language, score) of every text."""
    names = sorted(known)
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if not names:
        return pred, score
    tables = []
    for name in names:
        order = np.argsort(known[name])
        tables.append((known[name][order], order))
    for lo, hi, doc, gram, n in gram_counts(texts):
        if not len(doc):
            continue
        order = np.lexsort((gram, -n, doc))
        doc, gram = doc[order], gram[order]
        first = np.searchsorted(doc, np.arange(hi - lo))
        rank = np.arange(len(doc)) - first[doc]
        best = rank < top
        doc, gram, rank = doc[best], gram[best], rank[best]
        distance = np.zeros((len(names), hi - lo))
        for k, (grams, ranks) in enumerate(tables):
            at = np.searchsorted(grams, gram)
            at[at == len(grams)] = 0
            away = np.where(grams[at] == gram, np.abs(ranks[at] - rank), top)
            distance[k] = np.bincount(doc, weights=away, minlength=hi - lo)
        pick = distance.argmin(axis=0)
        ordered = np.sort(distance, axis=0)
        both = ordered[0] + ordered[1] if len(names) > 1 else np.ones(hi - lo)
        s = np.where(both > 0, ordered[1] / np.where(both > 0, both, 1), 0.5) if len(names) > 1 else np.ones(hi - lo)
        for d in np.unique(doc):
            pred[lo + d], score[lo + d] = names[pick[d]], s[d]
    return pred, score


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)       # TOP n-grams per language

    def run(batch: pa.RecordBatch) -> dict:
        pred, score = classify([t or "" for t in batch.column("text").to_pylist()], shared.value)
        return {"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": score}
    return map_batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run,
                       "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 5 is not 0 and predict all: doc_id, held_out, lang_pred, score."""
    known = profiles(docs.where(fold("doc_id", 5) != 0))
    out = identify(docs, known)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
