"""Phrase collocations of two to five words per language, by Toivonen's sampling with a negative border.

*Words.*  A-Z are lower-cased; texts are split at ``[.,;:!?\\n-\\r]`` into pieces, pieces into words at spaces
and tabs.  A phrase lies within a piece.  A phrase is frequent when it occurs ``min_count`` times.

*Method.*  A sample of the documents (one of ``SAMPLE``) proposes phrases: those that reach ``SLACK`` of their
share of ``min_count`` in it.  One pass over all documents then counts exactly every word and every phrase whose
two parts without the last and without the first word are proposed: the proposed phrases and their
negative border together.  A frequent phrase that was not proposed is a failure of the border.  The expansion pass takes all
phrases found frequent as proposed and counts the phrases that become due by that, and only those; a phrase
that has become due counts as proposed for the longer ones at once, so longer failures need no
pass of their own and this pass closes the search: every part of a frequent phrase is frequent, so it was
either found before or is due now.  The same pass brings the words of the phrases found.

*Proposed phrases* travel as a filter of bits (:class:`Filter`) of at most ``FILTER_BITS`` bits, whatever
their number.  A phrase that passes by chance is only counted in vain.

*Counting* is numpy over blocks of text bytes: a block gives one (hash, count) row per distinct phrase in it,
Spark sums the rows with partial aggregation, and only frequent ones are stored.  Words and phrases are told
apart by 64-bit hashes.  In the expansion pass a phrase's key is its words' hashes, 8 bytes each, so that parts of
a phrase are parts of its key.  A long text is cut into windows that share the four words a phrase can reach
over the cut.

Defined results: a null text is empty, a null language is ``und``; a document without words adds nothing;
repeated rows count each; an empty table gives no rows; columns other than the language and the text are not
read, but for the id, which deals the sample (null: as the empty text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import Bytes, _string_buffers, blocks, mix, store

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
SAMPLE, SLACK = 8, 0.8
FILTER_BITS = 1 << 27
BLOCK = 1 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SEPARATOR = _PIECE.copy()
_SEPARATOR[[32, 9]] = True
_SCHEMA = pa.schema([("hash", pa.int64()), ("lang", pa.string()), ("key", pa.binary()), ("word", pa.string()), ("n", pa.int64())])
_DDL = "hash long, lang string, key binary, word string, n long"


class Filter:
    """Set of phrase hashes as bits, two a phrase; may answer yes by chance, never no for a member."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, _U(64 * len(bits) - 1)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in (hashes & self.mask, (hashes >> _U(32)) & self.mask):
            out &= ((self.bits[place >> _U(6)] >> (place & _U(63))) & _U(1)).astype(bool)
        return out


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


def _extend(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases with one more word behind."""
    return mix(hashes * _ODD + word, 3)


def _first(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word ^ lang, 2)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, Bytes, int]]:
    """(rows, bytes, end of the own bytes): runs of documents, long ones in windows with the words behind them."""
    offsets, data = _string_buffers(column)
    long = np.flatnonzero(np.diff(offsets) > 2 * BLOCK)
    at = 0
    for row in [*long.tolist(), len(column)]:
        if row > at:
            for lo, hi, b in blocks(column.slice(at, row - at), BLOCK):
                yield np.arange(at + lo, at + hi), b, len(b.data)
        if row < len(column):
            text = data[offsets[row]:offsets[row + 1]]
            for part, own in _windows(text):
                yield np.array([row]), Bytes(np.append(part, np.uint8(10)), np.zeros(1, np.int64)), own
        at = row + 1


def _windows(text: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Windows of a long text: cut at separators, each followed by the words a phrase can reach behind the cut."""
    lo = 0
    while lo < len(text):
        hi = _next_separators(text, lo + BLOCK, 1)
        yield text[lo:_next_separators(text, hi, MAX_WORDS + 1)], hi - lo
        lo = hi


def _next_separators(text: np.ndarray, at: int, n: int) -> int:
    """Place of the start of the n-th run of separators from ``at`` on (or the end)."""
    width = 1 << 12
    while at < len(text):
        sep = _SEPARATOR[text[at:at + width]]
        starts = np.flatnonzero(sep & ~np.concatenate([[False], sep[:-1]]))
        if len(starts) >= n:
            return at + int(starts[n - 1])
        if at + width >= len(text):
            break
        width *= 4
    return len(text)


class _Block:
    """Words of a block of texts, and the phrases that are due in it."""

    def __init__(self, b: Bytes, own: int, lang: np.ndarray):
        self.text = b.lower_ascii()
        self.start, self.end, self.doc = self.text.words(_SEPARATOR)
        self.word = self.text.span_hash(self.start, self.end)
        self.piece = np.cumsum(_PIECE[self.text.data], dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        self.mine, self.lang = self.start < own, lang

    def phrases(self, longest: int, depth: int = MAX_WORDS, known: Filter | None = None, done: Filter | None = None):
        """(length, first words, hashes, fresh) of the due phrases that begin in the block, length by length.

        Due are words, and phrases whose parts without the last and without the first word are ``known`` (none:
        all are); parts of over ``depth`` words are known when they are due.  ``fresh`` are phrases that are not due under
        ``done`` alone; with ``done``, what is fresh is known.
        """
        size = len(self.start)
        if not size:
            return
        at, hashes = np.arange(size), _first(self.word, self.lang[self.doc])
        is_known = np.ones(size, bool) if known is None else known.test(hashes)
        was_known = np.zeros(size, bool) if done is None else done.test(hashes)
        yield 1, at[self.mine], hashes[self.mine], np.full(int(self.mine.sum()), done is None)
        for n in range(2, longest + 1):
            m = size - n + 1
            if m <= 0:
                return
            full = np.zeros(size, np.uint64)
            full[at] = hashes
            at = np.flatnonzero(is_known[:m] & is_known[1:m + 1] & (self.piece[:m] == self.piece[n - 1:]))
            hashes = _extend(full[at], self.word[at + n - 1])
            fresh = ~(was_known[at] & was_known[at + 1])
            mine = self.mine[at]
            yield n, at[mine], hashes[mine], fresh[mine]
            is_known, before = np.zeros(size, bool), was_known
            is_known[at] = True if known is None or n > depth else known.test(hashes) | (fresh & (done is not None))
            was_known = np.zeros(size, bool)
            if done is not None:
                was_known[at] = before[at] & before[at + 1] & done.test(hashes)


def _distinct(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    return values, at[first], counts


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    take = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(start, size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take])))


def _blocks_of(batches) -> Iterator[tuple[_Block, list[str], np.ndarray]]:
    """Blocks of (lang, text) batches with the batch's languages and each document's index among them."""
    for batch in batches:
        lang, text = batch.columns
        coded = lang.dictionary_encode()
        langs, of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        hashes = np.array([_lang_hash(x) for x in langs], np.uint64)
        for rows, b, own in _texts(text):
            yield _Block(b, own, hashes[of_row[rows]]), langs, of_row[rows]


def count_hashes(texts: DataFrame, lengths: tuple[int, ...], known=None, depth: int = MAX_WORDS) -> DataFrame:
    """(hash, n): exact counts over (lang, text) of the due phrases of ``lengths``; ``known`` is a broadcast :class:`Filter`."""
    def run(batches):
        for block, _, _ in _blocks_of(batches):
            for n, at, hashes, _ in block.phrases(max(lengths), depth, known and known.value):
                if n in lengths and len(at):
                    values, _, counts = _distinct(at, hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _named_rows(block: _Block, langs: list[str], lang_of_doc: np.ndarray, known: Filter, done: Filter) -> pa.RecordBatch:
    """Rows (hash, lang, key, word, n): fresh phrases with their counts, known ones with 0, the words of each language (empty key)."""
    hash_, lang, word, count, size, keys = [], [], [], [], [], []
    for n, at, hashes, fresh in block.phrases(MAX_WORDS, MAX_WORDS, known, done):
        chosen = fresh | known.test(hashes)
        values, first, counts = _distinct(np.flatnonzero(chosen), hashes[chosen])
        at, counts = at[first], np.where(fresh[first], counts, 0)
        keys.append(block.word[at[:, None] + np.arange(n)].astype(">u8").tobytes())
        hash_.append(values)
        lang.append(lang_of_doc[block.doc[at]])
        count.append(counts)
        size.append(np.full(len(at), 8 * n))
        word.append(_strings(block.text.data, block.start[at], block.end[at]) if n == 1 else pa.nulls(len(at), pa.string()))
    if not keys:
        return pa.RecordBatch.from_pylist([], schema=_SCHEMA)
    total = np.bincount(lang_of_doc[block.doc[block.mine]], minlength=len(langs))
    some = np.flatnonzero(total)
    hash_.append(np.zeros(len(some), np.uint64))
    lang.append(some)
    count.append(total[some])
    size.append(np.zeros(len(some), np.int64))
    word.append(pa.nulls(len(some), pa.string()))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int32)
    key = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(keys))])
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate(hash_).view(np.int64)), pa.array(langs, pa.string()).take(pa.array(np.concatenate(lang), pa.int64())), key,
        pa.concat_arrays(word), pa.array(np.concatenate(count), pa.int64())], schema=_SCHEMA)


def expand(texts: DataFrame, known, done) -> DataFrame:
    """(hash, lang, key, word, n): the expansion pass.  n is the count of a phrase that is due by ``known`` but was not by
    ``done``, and 0 for the others in ``known``; the empty key holds the number of words."""
    def run(batches):
        for block, langs, of_doc in _blocks_of(batches):
            yield _named_rows(block, langs, of_doc, known.value, done.value)

    return texts.mapInArrow(run, _DDL).groupBy("hash", "lang", "key", "word").agg(F.sum("n").alias("n"))


def build_filter(*hashes: DataFrame) -> Filter:
    """Filter of the column ``hash`` of stored tables, about 32 bits a phrase up to ``FILTER_BITS``.

    The bits are set by an aggregation; the driver receives the filter's words alone.
    """
    rows = sum(h.count() for h in hashes)
    words = min(FILTER_BITS >> 6, max(1 << 10, 1 << int(np.ceil(np.log2(max(rows, 1) / 2 + 1)))))
    every = hashes[0].select("hash")
    for h in hashes[1:]:
        every = every.unionByName(h.select("hash"))
    mask = 64 * words - 1
    places = every.select(F.explode(F.array(F.col("hash").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    table = places.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)


def _words(key: str | Column = "key") -> Column:
    return F.call_function("div", F.octet_length(key), F.lit(8))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Stored (lang, key, word, n) of every phrase of one to five words with at least ``min_count`` occurrences, and the
    number of words per language under the empty key."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("_id"))
    chosen = texts.where(F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(17)), F.lit(sample)) == 0).select("lang", "text")
    texts = texts.select("lang", "text")
    enough = F.col("n") >= max(2, int(SLACK * min_count / sample))

    short = store(count_hashes(chosen, (1, 2)).where(enough).select("hash"))
    proposed = sc.broadcast(build_filter(short))
    long = store(count_hashes(chosen, (3, 4), proposed, depth=2).where(enough).select("hash"))
    proposed = sc.broadcast(build_filter(short, long))

    found = store(count_hashes(texts, (1, 2, 3, 4, 5), proposed, depth=MAX_WORDS - 1).where(F.col("n") >= min_count))
    known = sc.broadcast(build_filter(found))
    counted = expand(texts, known, proposed).join(found.select(F.col("hash").alias("_h"), F.col("n").alias("_n")), (F.col("hash") == F.col("_h")) & (F.octet_length("key") > 0), "left")
    counted = counted.select("lang", "key", "word", F.coalesce("_n", "n").alias("n"))
    return store(counted.where((F.col("n") >= min_count) | (F.octet_length("key") == 0)))


def score_cuts(phrases: DataFrame) -> DataFrame:
    """(lang, key, a, l, r, n, score) of every phrase of two words or more, by its lowest cut (ties: the first)."""
    sizes = phrases.where(F.octet_length("key") == 0).select("lang", F.col("n").alias("_n"))
    many = phrases.where(_words() >= 2).select("lang", "key", F.col("n").alias("a"))
    parts = phrases.where(F.octet_length("key") > 0).select(F.col("lang").alias("_l"), F.col("key").alias("_k"), "n")
    cut = many.withColumn("cut", F.explode(F.sequence(F.lit(1), _words().cast("int") - 1)))
    cut = cut.select("*", F.substring("key", F.lit(1), F.col("cut") * 8).alias("_first"),
                     F.substring("key", F.col("cut") * 8 + 1, F.octet_length("key")).alias("_rest"))
    cut = cut.join(parts.withColumnRenamed("n", "l"), (F.col("lang") == F.col("_l")) & (F.col("_first") == F.col("_k"))).drop("_l", "_k")
    cut = cut.join(parts.withColumnRenamed("n", "r"), (F.col("lang") == F.col("_l")) & (F.col("_rest") == F.col("_k"))).drop("_l", "_k")
    cut = cut.join(sizes, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    # exact: products are decimals of 38 digits; the quotient is at most 1000 * n
    score = F.call_function("div", wide(F.col("a") * 1000) * wide(F.col("_n")), wide(F.col("l")) * wide(F.col("r")))
    best = cut.groupBy("lang", "key", "a", F.col("_n").alias("n")).agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_b"))
    return best.select("lang", "key", "a", "_b.l", "_b.r", "n", "_b.score")


def drop_contained(scored: DataFrame) -> DataFrame:
    """Without phrases that lie in a longer one with as many occurrences (one word more is enough to look at: every
    phrase between the two occurs as often)."""
    shorter = F.octet_length("key") - 8
    part = scored.where(_words() >= 3).select(
        F.col("lang").alias("_l"), F.col("a").alias("_a"),
        F.explode(F.array(F.substring("key", F.lit(1), shorter), F.substring("key", F.lit(9), shorter))).alias("_k"))
    return scored.join(part, (F.col("lang") == F.col("_l")) & (F.col("key") == F.col("_k")) & (F.col("a") == F.col("_a")), "left_anti")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score and count
    descending, phrase ascending."""
    phrases = frequent_phrases(docs, min_count, key, sample)
    scored = drop_contained(store(score_cuts(phrases)))
    order = [F.desc("score"), F.desc("a")]
    # ties at the end are settled by the phrase, whose words are looked up for the leading ones alone
    lead = scored.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= top).drop("_r")
    spread = lead.withColumn("_i", F.explode(F.sequence(F.lit(0), _words().cast("int") - 1)))
    spread = spread.withColumn("_k", F.substring("key", F.col("_i") * 8 + 1, F.lit(8)))
    words = phrases.where(_words() == 1).select("lang", F.col("key").alias("_k"), "word")
    named = spread.join(words, ["lang", "_k"]).groupBy(*scored.columns).agg(F.array_sort(F.collect_list(F.struct("_i", "word"))).alias("_w"))
    named = named.withColumn("phrase", F.array_join(F.transform("_w", lambda w: w["word"]), " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
