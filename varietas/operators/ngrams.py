"""N-gram counting (A7–A10, L5c, L5d, L8).

A sentence of whitespace tokens t1..tm is read as ``<s> t1 .. tm </s>``; position j (1..m+1)
predicts its word from at most ``order-1`` preceding words (``<s>`` included).  Every (position,
order) pair is one *event* ``(ord, h, w)`` with ``h`` the space-joined history.  Events are
generated inside the row by array lambdas (no Python), and counted with ``groupBy``, which
pre-aggregates map-side: a hot n-gram costs one partial row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions import split_whitespace

# Reserved symbols.
BOS, EOS, UNK = "<s>", "</s>", "<unk>"
RESERVED = (BOS, EOS, UNK)


def sentence_tokens(text: Column, skip_symbols: bool = False) -> Column:
    """Whitespace tokens of a line; with ``skip_symbols`` the reserved symbols are dropped."""
    toks = split_whitespace(text)
    if skip_symbols:
        toks = F.filter(toks, lambda t: ~t.isin(*RESERVED))
    return toks


def padded(toks: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), toks, F.array(F.lit(EOS)))


def history_of(seq: Column, j: Column, n: Column) -> Column:
    """Space-joined words j-n+1 .. j-1 of the 0-based padded sequence (empty for n = 1)."""
    return F.array_join(F.slice(seq, j - n + 2, n - 1), " ")


def event_structs(seq: Column, order: int) -> Column:
    """array<struct<pos,ord,h,w>> of all events of one padded sentence.

    ``seq`` must be a plain column reference: expressions inside lambdas are evaluated once per
    array element, so the padded token array is materialised before this is called.
    """
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(seq) - 1),
        lambda j: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(order), j + 1)),
            lambda n: F.struct(j.alias("pos"), n.alias("ord"), history_of(seq, j, n).alias("h"),
                               F.element_at(seq, j + 1).alias("w")))))


def ngram_events(lines: DataFrame, order: int = 3, text_col: str = "text", keep: list[str] | None = None,
                 skip_symbols: bool = False, toks_col: str | None = None) -> DataFrame:
    """(keep..., pos, ord, h, w): one row per event."""
    toks = F.col(toks_col) if toks_col else sentence_tokens(F.col(text_col), skip_symbols)
    keep = keep or []
    seqd = lines.select(*keep, padded(toks).alias("_seq"))
    return seqd.select(*keep, F.inline(event_structs(F.col("_seq"), order)))


def ngram_counts(lines: DataFrame, order: int = 3, text_col: str = "text", skip_symbols: bool = False,
                 toks_col: str | None = None, round_to_int: bool = False) -> DataFrame:
    """(ord, h, w, c): n-gram counts of orders 1..order."""
    ev = ngram_events(lines, order, text_col, skip_symbols=skip_symbols, toks_col=toks_col)
    counts = ev.groupBy("ord", "h", "w").agg(F.count(F.lit(1)).alias("c"))
    return round_counts(counts) if round_to_int else counts


def weighted_counts(lines: DataFrame, weight_col: str, order: int = 3, text_col: str = "text", skip_symbols: bool = False) -> DataFrame:
    """(ord, h, w, c): fractional n-gram counts, each line counting ``weight_col`` times (input of ``presmoothed``, L5b)."""
    ev = ngram_events(lines, order, text_col, keep=[weight_col], skip_symbols=skip_symbols)
    return ev.groupBy("ord", "h", "w").agg(F.sum(weight_col).alias("c")).where(F.col("c") > 0)


def round_counts(counts: DataFrame) -> DataFrame:
    """Integer rounding of (possibly fractional) counts, zero counts dropped (L5d)."""
    return counts.withColumn("c", F.round("c").cast("long")).where(F.col("c") > 0)


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum shard counts."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("ord", "h", "w").agg(F.sum("c").alias("c"))


def count_of_counts(counts: DataFrame, count_col: str = "c", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, c, n): how many n-grams of each order occur exactly c times."""
    return counts.groupBy(*by, "ord", F.col(count_col).alias("c")).agg(F.count(F.lit(1)).alias("n"))


def context_stats(counts: DataFrame, count_col: str = "c", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, h, c_h, t_h, n1, n2, n3p): history total, continuation types and their 1/2/3+ split (A10)."""
    c = F.col(count_col)
    return counts.groupBy(*by, "ord", "h").agg(
        F.sum(c).alias("c_h"), F.count(F.lit(1)).alias("t_h"),
        F.count(F.when(c == 1, 1)).alias("n1"), F.count(F.when(c == 2, 1)).alias("n2"),
        F.count(F.when(c >= 3, 1)).alias("n3p"))


def lower_history(h: Column) -> Column:
    """h without its oldest word."""
    return F.regexp_replace(h, "^[^ ]* ?", "")


def shard_by_context(counts: DataFrame, boundaries: list[str]) -> DataFrame:
    """Tag each n-gram with the shard of its first context word.

    Shard s holds first words in [boundaries[s-1], boundaries[s]) (shard 0 below the first
    boundary); the order-1 n-grams (empty history) go by their word.  The boundary list is a
    parameter of fixed, small size, so the lookup is a CASE expression — no join at all.
    Merging shards back is :func:`merge_counts`.
    """
    first = F.when(F.col("h") == "", F.col("w")).otherwise(F.split(F.col("h"), " ")[0])
    shard = F.lit(0)
    for i, b in enumerate(sorted(boundaries)):
        shard = F.when(first >= F.lit(b), F.lit(i + 1)).otherwise(shard)
    return counts.withColumn("shard", shard)
