"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m normalised characters (lower case, every run of other than letters and digits
one space) may occur in a document with up to k = floor(m x ``ERROR``) edits.  Cut into k + 1 pieces,
at least one piece must then occur exactly.  So:

1. one Aho-Corasick automaton of all pieces scans each whole normalised text once;
2. pieces are the leaves of a halving of the item in which the same argument holds at every node (two
   halves' budgets add up to one less than the whole's), so a hit is verified from the piece up: first
   the short segment around it, and only if that is within its budget the next larger one;
3. a segment is verified with Myers' bit-parallel algorithm: the least edit distance to any substring
   of the window that the piece's place and the budget allow.  The whole item within k is a match.

Items are normalised and equal ones merged by a Spark job (the smallest id stays).  They go to the tasks in groups
of at most ``GROUP_CHARS`` characters, one scan of the documents per group, so a broadcast has a fixed bound
however large the benchmark grows.  The budget is the same share at every length; an item shorter than
``MIN_CHARS`` normalised characters is matched with the blanks around it, so that it is not found inside
longer words for free.  Items without letters or digits match nothing.

Null texts, null items and empty tables match nothing; repeated documents match each; a null id is
carried as it is.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import map_batches

ERROR = 0.1
MIN_CHARS = 40
GROUP_CHARS = 4_000_000

_RUN = re.compile(r"[\W_]+")
#: ASCII other than letters and digits as blanks, for the texts that are ASCII throughout.
_BLANKED = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    """`` word word ... `` with one space around every word."""
    low = (text or "").lower()
    if low.isascii():
        return f" {' '.join(low.encode().translate(_BLANKED).decode().split())} "
    return " " + _RUN.sub(" ", low).strip() + " "


def budget(item: str) -> int:
    return int(len(item.strip()) * ERROR)


def split_tree(m: int, k: int) -> list[tuple[int, int, int, int]]:
    """Nodes (start, end, budget, parent) of the halving of an item of m characters with k edits.

    A node of budget e > 0 has children whose budgets add up to e - 1: if it occurs within e edits, a
    child occurs within its own.  The k + 1 leaves have budget 0.
    """
    nodes = [(0, m, k, -1)]
    for n, (a, b, e, _) in enumerate(nodes):            # the list grows while it is walked
        if e > 0:
            left = (e - 1) // 2
            cut = a + (b - a) * (left + 1) // (e + 1)
            nodes += [(a, cut, left, n), (cut, b, e - 1 - left, n)]
    return nodes


def myers(item: str, masks: dict[str, int], window: str) -> tuple[int, int]:
    """(least edit distance of ``item`` to a substring of ``window``, end of the first such substring)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Matches of a group of normalised items (item text -> ids) in normalised texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick
        self.items = [(i, s, budget(s)) for i, s in items]
        self.trees = [split_tree(len(s), k) for _, s, k in self.items]
        self.masks: dict[tuple[int, int], dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, tree in enumerate(self.trees):
            for leaf, (a, b, e, _) in enumerate(tree):
                if e == 0 and b > a:
                    found.setdefault(self.items[n][1][a:b], []).append((n, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def _distance(self, n: int, node: int, text: str, lo: int, hi: int) -> tuple[int, int]:
        a, b, _, _ = self.trees[n][node]
        if (n, node) not in self.masks:
            m: dict[str, int] = {}
            for bit, c in enumerate(self.items[n][1][a:b]):
                m[c] = m.get(c, 0) | 1 << bit
            self.masks[n, node] = m
        d, end = myers(self.items[n][1][a:b], self.masks[n, node], text[lo:hi])
        return d, lo + end

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, end in the normalised text) of every item that occurs."""
        if self.empty:
            return []
        best: dict[int, tuple[int, int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            start = last - length + 1
            for n, leaf in places:
                if n in best and best[n][0] == 0:
                    continue
                tree = self.trees[n]
                offset, end, node = tree[leaf][0], last + 1, leaf
                d = 0
                # from the piece up: every segment around it must occur within its own budget
                while d <= tree[node][2] and tree[node][3] >= 0:
                    node = tree[node][3]
                    a, b, e, _ = tree[node]
                    d, end = self._distance(n, node, text, max(0, start - (offset - a) - e), start - offset + b + e)
                if d <= tree[node][2] and node == 0 and (n not in best or d < best[n][0]):
                    best[n] = (d, end)
        return [(n, d, end) for n, (d, end) in sorted(best.items())]


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int, str]]) -> Matcher:
    """The group's matcher, built once in a Python worker."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items)
    return _matchers[key]


def item_groups(benchmark: DataFrame, group_chars: int = GROUP_CHARS) -> list[list[tuple[int, str]]]:
    """Distinct normalised items as (smallest item_id, text), in groups of bounded size."""
    def normal(batch: pa.RecordBatch) -> dict:
        return {"item_id": batch.column(0), "item": pa.array([normalise(t).strip() for t in batch.column(1).to_pylist()], pa.string())}

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    items = map_batches(rows, normal, "item_id long, item string").where("item <> ''").groupBy("item").agg(F.min("item_id").alias("item_id"))
    groups, size = [[]], 0
    for row in items.orderBy("item_id", "item").toLocalIterator():
        s = f" {row['item']} " if len(row["item"]) < MIN_CHARS else row["item"]
        if size + len(s) > group_chars and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append((row["item_id"], s))
        size += len(s)
    return groups


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, distance, item_chars, end_char.

    ``end_char`` is where the best occurrence ends in the normalised text.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, item_id long, distance long, item_chars long, end_char long"
    out = None
    for items in item_groups(benchmark):
        key = f"{len(items)}:{hash(tuple(items))}"
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batch: pa.RecordBatch, key=key, shared=shared) -> dict:
            m = _matcher(key, shared.value)
            rows = [(i, m.items[n][0], dist, len(m.items[n][1]), end)
                    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for n, dist, end in m.find(normalise(t.as_py()))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            return dict(zip(("doc_id", "item_id", "distance", "item_chars", "end_char"), cols, strict=True))

        found = map_batches(d, scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no benchmark item occurs, judged in place (no join by id)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    schema = docs.select(row.alias("row")).schema
    out = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    for items in item_groups(benchmark):
        key = f"{len(items)}:{hash(tuple(items))}"
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, key=key, shared=shared):
            for batch in batches:
                m = _matcher(key, shared.value)
                keep = pa.array([not m.find(normalise(t.as_py())) for t in batch.column("text")], pa.bool_())
                yield batch.select(["row"]).filter(keep).cast(arrow) if batch.num_rows else batch.select(["row"])
        out = out.mapInArrow(clean, schema).select("row", F.col(f"row.`{text_col}`").alias("text"))
    return out.select("row.*")
