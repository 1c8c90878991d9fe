"""Token files: public BPE ids, Re-Pair grammar compression per shard, random access by document.

*Encoding.*  Whole texts are encoded with the given ``tokenizers`` file.  Its normaliser drops white
space, lower-cases, and parts letters from marks, so a text's ids are those of its chunks between white
space (marks behind a letter apart); a worker encodes a distinct chunk once and copies ids for repeats.  Id 2 ends
every document.

*Order.*  Documents are range-partitioned and sorted by id, so shards follow ascending ids; a shard is
a run of at most ``SHARD_TOKENS`` ids (or one longer document).

*Re-Pair.*  The shard's ids are rewritten by a grammar: the most frequent adjacent pairs become nonterminals
and their occurrences, left to right, are replaced, until no pair occurs ``MIN_PAIR`` times, which is
where a rule (two symbols and a length) saves more than it costs.  Pairs are replaced many at a time: in a round every
symbol is a left or a right partner, by its most frequent pair, so no two replaced pairs can overlap and
the most frequent one is always among them.  All pairs are counted once; a replacement only makes pairs that hold its new symbol, so
later rounds count just the places beside replacements and those of frequent pairs that had to wait.
Document ends are never inside a rule, so every document is a slice of the rewritten sequence.

*File.*  A shard is one record: rules (left, right), expansion length of every rule, the rewritten
sequence, and per document its id, its slice and its token count.  Records are Parquet rows, written
and committed by Spark on any store.  :func:`read_documents` decodes slices; :func:`decode_slice`
uses the expansion lengths to decode tokens [a, b) of a document without the rest.

A null text is empty (one id, the end id); a null doc_id sorts first and is carried as it is; repeated
rows are written each; an empty table writes no shard.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import BLOCK_BYTES, Bytes, blocks, small

END_ID = 2
SHARD_TOKENS = 1 << 20
MIN_PAIR = 4
SCHEMA = ("part int, shard int, n_docs long, n_ids long, base int, rules binary, lengths binary, sequence binary, "
          "doc_ids array<bigint>, slice_end array<int>, n_tokens array<int>")

_encoders: dict = {}


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _chunks(b: Bytes) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document) of the chunks that are encoded on their own.

    Chunks lie between white space.  The tokenizer lower-cases, and parts letters from marks behind
    them, so A-Z are lowered and up to four marks behind an ASCII letter are a chunk of their own; a
    block that could hold a special token's text is left as it is.
    """
    if b"<|" in b.data.tobytes():
        return (b, *b.words())
    b = b.lower_ascii()
    start, end, doc = b.words()
    cut = end.copy()
    for _ in range(4):
        back = (cut - 1 > start) & _MARK[b.data[cut - 1]]
        cut[back] -= 1
    parted = (cut < end) & _LETTER[b.data[cut - 1]]
    times = 1 + parted
    first = np.cumsum(times) - times
    s, e, d = np.repeat(start, times), np.repeat(end, times), np.repeat(doc, times)
    e[first[parted]] = cut[parted]
    s[first[parted] + 1] = cut[parted]
    return b, s, e, d


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, where each comes first, index of every value among them), by a hash table."""
    code, values = pd.factorize(h)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values[order], first[order], rank[code]


class ChunkEncoder:
    """Ids of whole texts through a per-worker memory of encoded chunks.

    A chunk is known by the 64-bit hash of its bytes; the memory is three arrays (sorted hashes, places
    and lengths in one pool of ids) and starts anew beyond ``keep`` chunks.
    """

    def __init__(self, path: str, keep: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hash, self.place, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids per chunk.  Lower-case ASCII words go to the library's model at once; other words that the
        normaliser would leave alone are encoded many at a time and cut where a word ends."""
        model, out = self.tokenizer.model, [None] * len(chunks)
        words, other = [], []
        for n, c in enumerate(chunks):
            if not c.isalpha() or c.lower() != c:
                other.append(n)
            elif c.isascii():
                out[n] = [t.id for t in model.tokenize(c)]
            elif unicodedata.is_normalized("NFC", c):
                words.append(n)
            else:
                other.append(n)
        for lo in range(0, len(words), 500):
            part = words[lo:lo + 500]
            ids = np.array(self.tokenizer.encode(" ".join(chunks[n] for n in part), add_special_tokens=False).ids)
            end = np.flatnonzero(self.word_end[ids]) + 1
            if len(end) != len(part):
                other += part
                continue
            for n, x in zip(part, np.split(ids, end[:-1]), strict=True):
                out[n] = x.tolist()
        for n, e in zip(other, self.tokenizer.encode_batch_fast([chunks[n] for n in other], add_special_tokens=False), strict=True):
            out[n] = e.ids
        return out

    def _learn(self, b: Bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        data = b.data.tobytes()
        chunks = [data[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        ids = self._encode_chunks(chunks)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(length.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used:self.used + len(flat)] = flat
        place = self.used + np.concatenate((np.zeros(1, np.int64), np.cumsum(length)[:-1]))
        self.used += len(flat)
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.place, self.length = np.insert(self.hash, at, hashes), np.insert(self.place, at, place), np.insert(self.length, at, length)

    def encode(self, b: Bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, end id included; number of ids per document)."""
        b, start, end, doc = _chunks(b)
        h = b.span_hash(start, end)
        distinct, first, which = _distinct(h)
        if len(self.hash) + len(distinct) > self.keep:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        new = self.hash[at] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(b, start[first[new]], end[first[new]], distinct[new])
        at = np.searchsorted(self.hash, distinct)
        place, length = self.place[at][which], self.length[at][which]
        per_doc = np.bincount(doc, weights=length, minlength=b.n_docs).astype(np.int64) + 1
        out = np.full(int(per_doc.sum()), END_ID, np.uint32)
        # a chunk's ids go behind those of the chunks before it and the end ids of the documents before
        total = int(length.sum())
        to = np.cumsum(length) - length + doc
        step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + step] = self.pool[np.repeat(place, length) + step]
        return out, per_doc


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _grouped(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group starts in that order, group sizes) of equal pairs."""
    bits, places = symbols.bit_length(), len(left).bit_length()
    if 2 * bits + places < 64:                               # pair and place in one number: a plain sort
        packed = left.astype(np.int64)
        packed <<= bits
        packed |= right
        packed <<= places
        packed |= np.arange(len(left))
        packed.sort()
        order, ordered = packed & ((1 << places) - 1), packed >> places
    else:
        key = (left.astype(np.int64) << 32) | right
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order, start, np.diff(start, append=len(left))


def _partners(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """Which pairs, most frequent first, can be replaced together: a symbol is only ever the left, the right, or both of
    one pair of equal symbols, as in its most frequent pair."""
    rank = np.arange(len(left))
    best_left, best_right = np.full(symbols, len(left)), np.full(symbols, len(left))
    np.minimum.at(best_left, left, rank)
    np.minimum.at(best_right, right, rank)
    return np.where(left == right, (best_left[left] == rank) & (best_right[left] == rank),
                    (best_left[left] < best_right[left]) & (best_right[right] < best_left[right]))


def re_pair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = MIN_PAIR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules (r, 2), rewritten sequence, new slice ends).  ``base`` is the first nonterminal.

    ``ends`` are exclusive slice ends in ``ids``; no rule spans one.  Symbols keep their places; ``after`` and
    ``before`` link those that are left, slice by slice.
    """
    n, next_id, rules = len(ids), base, []
    seq = ids.astype(np.int32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    stop = ends.astype(np.int64) - 1
    stop = stop[stop >= 0]
    after[stop] = -1
    before[stop[stop < n - 1] + 1] = -1
    at, marked = np.flatnonzero(after >= 0), np.zeros(n, bool)
    while len(at):
        a, b = seq[at], seq[after[at]]
        order, start, size = _grouped(a, b, next_id)
        often = np.flatnonzero(size >= least)
        if not len(often):
            break
        first = order[start[often]]
        ranked = np.argsort(-size[often], kind="stable")     # ties by the pair
        often, left, right = often[ranked], a[first[ranked]], b[first[ranked]]
        chosen = _partners(left, right, next_id)
        left, right = left[chosen], right[chosen]
        number = np.full(len(size), -2)                      # -2: rare, -1: frequent but has to wait, else the rule
        number[often] = np.where(chosen, np.cumsum(chosen) - 1, -1)
        of_place = np.repeat(number, size)
        wait = order[of_place == -1]
        waiting, wait_a, wait_b = at[wait], a[wait], b[wait]
        hit, which = at[order[of_place >= 0]], of_place[of_place >= 0]
        # only a pair of equal symbols can overlap itself: of a run take every other occurrence
        if (left == right).any():
            twin = left[which] == right[which]
            same, rule = hit[twin], which[twin]
            by_place = np.argsort(same)
            same, rule = same[by_place], rule[by_place]
            index = np.arange(len(same))
            run = np.concatenate(([True], after[same[:-1]] != same[1:])) if len(same) else np.zeros(0, bool)
            take = (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
            hit, which = np.concatenate((hit[~twin], same[take])), np.concatenate((which[~twin], rule[take]))
        gone = after[hit]
        seq[hit], seq[gone] = next_id + which, -1
        behind = after[gone]
        after[hit] = behind
        before[behind[behind >= 0]] = hit[behind >= 0]
        rules.append(np.stack((left, right), axis=1))
        next_id += len(left)
        # places to count next: untouched ones of waiting pairs, and those beside replacements
        marked[waiting[(seq[waiting] == wait_a) & (after[waiting] >= 0) & (seq[after[waiting]] == wait_b)]] = True
        marked[hit] = True
        behind = before[hit]
        marked[behind[behind >= 0]] = True
        at = np.flatnonzero(marked)
        marked[at] = False
        at = at[(seq[at] >= 0) & (after[at] >= 0)]
    kept = seq >= 0
    new_ends = np.concatenate(([0], np.cumsum(kept)))[ends]
    return (np.concatenate(rules).astype(np.int64) if rules else np.zeros((0, 2), np.int64)), seq[kept], new_ends


def _rounds(rules: np.ndarray, base: int):
    """(from, to) of runs of rules that refer to earlier runs only."""
    most, lo = rules.max(axis=1, initial=0) if len(rules) else np.zeros(0, np.int64), 0
    while lo < len(rules):
        later = np.flatnonzero(most[lo:] >= base + lo)
        hi = lo + int(later[0]) if len(later) else len(rules)
        yield lo, hi
        lo = hi


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each nonterminal stands for (rules refer to earlier ones only)."""
    out = np.ones(base + len(rules), np.int64)
    for lo, hi in _rounds(rules, base):
        out[base + lo:base + hi] = out[rules[lo:hi]].sum(axis=1)
    return out[base:]


def _spread(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, pool: np.ndarray) -> np.ndarray:
    size = length[symbols]
    to = np.cumsum(size)
    return pool[np.repeat(start[symbols] - to + size, size) + np.arange(to[-1] if len(to) else 0)]


def expand_all(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that a whole rewritten sequence stands for: every rule is expanded once, then each symbol is looked up."""
    length = np.concatenate((np.ones(base, np.int64), expansion_lengths(rules, base)))
    start = np.cumsum(length) - length
    pool = np.empty(int(length.sum()), np.uint32)
    pool[:base] = np.arange(base)
    for lo, hi in _rounds(rules, base):
        part = _spread(rules[lo:hi].ravel(), start, length, pool)
        pool[start[base + lo]:start[base + lo] + len(part)] = part
    return _spread(seq.astype(np.int64), start, length, pool)


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that a rewritten sequence stands for."""
    seq, rules = seq.astype(np.int32), rules.astype(np.int32)
    while len(rules):
        big = seq >= base
        if not big.any():
            break
        out = np.empty(len(seq) + int(big.sum()), np.int32)
        at = np.arange(len(seq)) + np.concatenate(([0], np.cumsum(big)[:-1]))
        out[at] = np.where(big, rules[np.where(big, seq - base, 0), 0], seq)
        out[at[big] + 1] = rules[seq[big] - base, 1]
        seq = out
    return seq


def decode_slice(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, a: int, b: int) -> np.ndarray:
    """Ids [a, b) of the sequence's expansion; symbols outside the range are skipped by their lengths."""
    seq = seq.astype(np.int64)
    size = np.where(seq >= base, lengths[np.maximum(seq - base, 0)] if len(lengths) else 1, 1)
    end = np.cumsum(size)
    lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(end, b, "left")) + 1
    before = int(end[lo - 1]) if lo else 0
    return expand(seq[lo:hi], rules, base)[a - before:b - before]


def _record(part: int, shard: int, ids: list, docs: list[np.ndarray], base: int) -> dict:
    n = np.array([len(d) for d in docs])
    rules, seq, ends = re_pair(np.concatenate(docs), np.cumsum(n), base)
    return {"part": part, "shard": shard, "n_docs": len(ids), "n_ids": int(n.sum()), "base": base, "rules": rules.astype("<u4").tobytes(),
            "lengths": expansion_lengths(rules, base).astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes(),
            "doc_ids": ids, "slice_end": ends.tolist(), "n_tokens": n.tolist()}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, partitions: int | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Write (doc_id, text) as token shards below ``path``; each Parquet row is a shard."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    base = 1 << 16

    def shards(batches):
        enc, part, shard = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, b in blocks(batch.column(1), 3 * BLOCK_BYTES):
                flat, per_doc = enc.encode(b)
                for i, d in zip(doc_ids[lo:hi], np.split(flat, np.cumsum(per_doc)[:-1]), strict=True):
                    if size and size + len(d) > shard_tokens:
                        yield pa.RecordBatch.from_pylist([_record(part, shard, ids, held, base)], schema=arrow)
                        ids, held, size, shard = [], [], 0, shard + 1
                    ids.append(i)
                    held.append(d)
                    size += len(d)
        if ids:
            yield pa.RecordBatch.from_pylist([_record(part, shard, ids, held, base)], schema=arrow)

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    d.mapInArrow(shards, SCHEMA).write.option("compression", "zstd").parquet(path)


def _decoded(record: dict):
    """(doc_id, ids) of every document of a shard record."""
    rules = np.frombuffer(record["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    seq = np.frombuffer(record["sequence"], "<u4")
    ids = expand_all(seq, rules, record["base"]).astype("<u4")
    edge = np.concatenate(([0], np.cumsum(record["n_tokens"])))
    for i, a, b in zip(record["doc_ids"], edge[:-1], edge[1:], strict=True):
        yield i, ids[a:b]


def read_documents(files: DataFrame) -> DataFrame:
    """(part, shard, offset in the shard, doc_id, n_tokens, ids_crc32) decoded from shard rows."""
    schema = "part int, shard int, offset long, doc_id long, n_tokens long, ids_crc32 long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                record = batch.slice(k, 1).to_pylist()[0]
                rows, offset = [], 0
                for i, d in _decoded(record):
                    rows.append((record["part"], record["shard"], offset, i, len(d), zlib.crc32(d.tobytes())))
                    offset += len(d)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
    return files.mapInArrow(read, schema)


def token_index(files: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the ids of the range partitions before (one row per partition), of the shards before
    in the partition, and of the documents before in the shard.
    """
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(small(parts), "part")
    starts = starts.select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))
    return read_documents(files).join(small(starts), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
