"""Best strings of lattices under the models of every prefix, without a (lattice x prefix) table.

A lattice differs from prefix to prefix only in which of a slot's words are known, and a model only where an n-gram's
running count moves.  So a position is one row with every word its slot ever holds and the numbers of the n-grams
and histories that its windows ask for; what is shuffled beside the positions are the moves of these
(:func:`asked_moves`), once per bucket of lines that ask.  ``BLOCK`` prefixes and a bucket of about ``POSITIONS`` positions meet in one
cogroup: counts are running sums in numpy, and the search runs for all prefixes of the block at once.

The search goes from the end of a line to its start and keeps, per state (the last N-1 words), the word with which
the cheapest rest begins, the least of equals: the cheapest path whose words come first, as in
:mod:`varietas.operators.decode`, whose windows, cost units and cuts of long lines are used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.operators.decode import PIECE, UNIT, _blocks, cut_points
from varietas.operators.ngrams import UNK
from varietas.operators.rows import div
from varietas.operators.signed import PrefixModels, type_events
from varietas.session import store

# Prefixes per block, positions per bucket (about).
BLOCK, POSITIONS = 512, 512
NO_PATH = 1 << 60


def _positions(known: DataFrame, n: int, key: str) -> tuple[DataFrame, list[str]]:
    """Rows per position (``</s>`` included) with the words their slots ever hold, the slots before, and the draw."""
    own = F.when(F.size("word_flips") > 0, F.array("word")).otherwise(F.array().cast("array<string>"))
    unk = F.when(F.col("word_flips") == F.array(F.lit(0).cast("long")), F.array().cast("array<string>")).otherwise(F.array(F.lit(UNK)))
    alt = F.when((F.size("alt_flips") > 0) & (F.col("alt") != F.col("word")), F.array("alt")).otherwise(F.array().cast("array<string>"))
    slots = known.select(key, "pos", F.explode(F.array_distinct(F.concat(own, unk, alt))).alias("word"), F.lit(0.0).alias("cost"))
    rows = _blocks([key], slots, n)
    prev = [f"prev{i}" for i in range(n - 1, 0, -1)]
    draw = known.select(key, "pos", F.col("word").alias("orig"), "alt", "word_flips", "alt_flips")
    return rows.select(key, "pos", "end", "words", *prev).join(draw, [key, "pos"], "left"), prev


def _asked(rows: DataFrame, prev: list[str], n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``ids``, asked items): per (history, word) pair of a window the numbers of its n-grams and of their histories.

    ``ids`` holds 2N numbers a pair, n-grams of orders 1..N, then histories (-1 where the history is shorter); the items are
    (ord, h, w, own, id), histories (``own`` false) with the empty word.
    """
    hs = F.array(F.lit(""))
    for p in prev:
        hs = F.flatten(F.transform(hs, lambda h: F.transform(p, lambda w: F.when(h == "", w).otherwise(F.concat_ws(" ", h, w)))))
    pairs = rows.select(key, "pos", "words", hs.alias("_h")).select(key, "pos", F.posexplode(F.flatten(F.transform("_h", lambda h: F.transform(
        "words", lambda w: F.struct(h.alias("h"), w.alias("w")))))).alias("_i", "_p")).select(key, "pos", "_i", "_p.h", "_p.w")
    pairs = store(pairs)
    words = F.when(F.col("h") == "", F.array().cast("array<string>")).otherwise(F.split("h", " "))
    parts = pairs.select("h", "w").distinct().withColumn("_ws", words).withColumn("ord", F.explode(F.sequence(F.lit(1), F.size("_ws") + 1)))
    parts = parts.select("h", "w", "ord", F.array_join(F.slice("_ws", F.size("_ws") - F.col("ord") + 2, F.col("ord") - 1), " ").alias("hm"))
    parts = parts.select("h", "w", "ord", "hm", F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    parts = store(parts.withColumn("wm", F.when(F.col("own"), F.col("w")).otherwise(F.lit(""))))
    items = store(parts.select("ord", F.col("hm"), "wm", "own").distinct().withColumn("id", F.monotonically_increasing_id()))
    minus = F.lit(-1).cast("long")
    at = lambda own, m: F.coalesce(F.max(F.when((F.col("own") == own) & (F.col("ord") == m), F.col("id"))), minus)
    numbers = parts.join(items, ["ord", "hm", "wm", "own"]).groupBy("h", "w").agg(
        F.array(*[at(True, m) for m in range(1, n + 1)], *[at(False, m) for m in range(1, n + 1)]).alias("ids"))
    numbered = pairs.join(numbers, ["h", "w"]).groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("_i", "ids"))).alias("_s"))
    out = rows.join(numbered.select(key, "pos", F.flatten("_s.ids").alias("ids")), [key, "pos"])
    return out, items.select("ord", F.col("hm").alias("h"), F.col("wm").alias("w"), "own", "id")


def asked_moves(models: PrefixModels, items: DataFrame) -> DataFrame:
    """(id, t, d, d2): changes of the asked n-grams' counts (d), of the asked histories' totals (d) and types (d2) at prefix
    t, and of the number of words in the vocabulary (id -1)."""
    zero = F.lit(0).cast("long")
    grams, hists = items.where("own"), items.where("not own")
    of_hist = store(models.events.join(hists.select("ord", "h"), ["ord", "h"], "left_semi"))
    counts = of_hist.join(grams.select("ord", "h", "w", "id"), ["ord", "h", "w"]).select("id", "t", F.col("d").cast("long").alias("d"), zero.alias("d2"))
    totals = of_hist.groupBy("ord", "h", "t").agg(F.sum("d").alias("d")).withColumn("d2", zero)
    types = type_events(of_hist, ["ord", "h"]).select("ord", "h", "t", zero.alias("d"), F.col("d").cast("long").alias("d2"))
    both = totals.unionByName(types).groupBy("ord", "h", "t").agg(F.sum("d").alias("d"), F.sum("d2").alias("d2"))
    both = both.join(hists.select("ord", "h", "id"), ["ord", "h"]).select("id", "t", "d", "d2")
    sizes = models.vocabulary_events().select(F.lit(-1).cast("long").alias("id"), "t", F.col("d").cast("long").alias("d"), zero.alias("d2"))
    return store(counts.unionByName(both).unionByName(sizes))


def _search(n: int, k: float, last: int):
    """Errors of the best strings of a bucket's pieces under the prefixes of a block: (i, sum of the lines' error shares)."""
    def tables(right: pd.DataFrame, start: int, width: int):
        ids, row = np.unique(right["id"].to_numpy(np.int64), return_inverse=True)
        place = row.ravel() * width + right["t"].to_numpy(np.int64) - start
        # one row more, of zeros, for what never moves
        return ids, [np.cumsum(np.bincount(place, right[c].to_numpy(np.float64), (len(ids) + 1) * width).reshape(-1, width), axis=1) for c in ("d", "d2")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0:
            return pd.DataFrame({"i": pd.Series([], dtype="int64"), "rate": pd.Series([], dtype="float64")})
        start = int(left["b"].iloc[0]) * BLOCK
        ts = np.arange(start, min(start + BLOCK, last + 1))
        width, every = len(ts), np.arange(len(ts))
        ids, (first, second) = tables(right, start, width)
        none = len(ids)

        def rows(asked: np.ndarray) -> np.ndarray:
            if none == 0:
                return np.zeros(asked.shape, np.int64)
            at = np.minimum(np.searchsorted(ids, asked), none - 1)
            return np.where((ids[at] == asked) & (asked >= 0), at, none)
        size = first[0] if none and ids[0] == -1 else first[none]
        p0 = 1.0 / (size + 2)                                         # </s> and <unk> are always in

        def inside(flips) -> np.ndarray:
            return np.searchsorted(np.asarray(flips, np.int64), ts, "right") % 2 == 1
        rate = np.zeros(width)
        for _, piece in left.groupby(["key", "first"], sort=False):
            piece = piece.sort_values("pos", kind="stable")
            rest, steps = None, []                                       # cost of the cheapest rest per state and prefix
            for words, sizes, asked, orig, alt, word_flips, alt_flips in zip(*[piece[c].to_numpy()[::-1] for c in (
                    "words", "sizes", "ids", "orig", "alt", "word_flips", "alt_flips")]):
                wide = len(words)
                asked = rows(np.asarray(asked, np.int64).reshape(-1, 2 * n))
                p = np.broadcast_to(p0, (len(asked), width))
                for m in range(n):
                    total, types = first[asked[:, n + m]], second[asked[:, n + m]]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        p = np.where(total > 0, (first[asked[:, m]] + k * types * p) / (total + k * types), p)
                with np.errstate(divide="ignore"):
                    cost = np.where(p > 0, np.floor(-np.log(p) * UNIT + 0.5), float(NO_PATH)).astype(np.int64).reshape(-1, wide, width)
                if orig is not None:
                    known, drawn = inside(word_flips), inside(alt_flips)
                    for j, w in enumerate(words):
                        has = (known if w == orig else False) | (~known if w == UNK else False) | (drawn if alt != orig and w == alt else False)
                        cost[:, j][:, ~has] = NO_PATH
                states = len(cost)
                kept = states // int(sizes[0]) if len(sizes) else 1        # states without the oldest slot
                after = (np.arange(states)[:, None] % kept) * wide + np.arange(wide) if len(sizes) else np.zeros((states, wide), np.int64)
                if rest is not None:
                    cost = np.minimum(cost + rest[after], NO_PATH)
                pick = np.argmin(cost, axis=1)                           # the first of equals
                rest = np.take_along_axis(cost, pick[:, None], 1)[:, 0]
                wrong = np.array([orig is not None and w != orig for w in words])
                steps.append((pick, after, wrong))
            dead = rest[0] >= NO_PATH
            state, errors = np.zeros(width, np.int64), np.zeros(width)
            for pick, after, wrong in reversed(steps):
                word = pick[state, every]
                errors += wrong[word]
                state = after[state, word]
            errors = np.where(dead, float(piece["orig"].notna().sum()), errors)
            rate += errors * (float(piece["mult"].iloc[0]) / float(piece["n_words"].iloc[0]))
        return pd.DataFrame({"i": ts, "rate": rate})
    return run


def error_sums(known: DataFrame, lines: DataFrame, models: PrefixModels, key: str = "sent_id", piece: int = PIECE) -> DataFrame:
    """(i, rate): per prefix 0..last the sum over lines of the share of positions that the best string gets wrong.

    ``known`` (key, pos, word, alt, word_flips, alt_flips): every position's word and its draw with the prefixes where they
    enter and leave the vocabulary; ``lines`` (key, mult): how often each line counts.
    """
    n, last = models.order, models.last
    rows, prev = _positions(known, n, key)
    rows, items = _asked(store(rows), prev, n, key)
    sizes = F.array(*[F.size(p) for p in prev]) if prev else F.array().cast("array<int>")
    one = F.lit(True)
    for c in [*prev[1:], "words"] if n > 1 else []:
        one = one & (F.size(c) == 1)
    rows = rows.withColumn("sizes", sizes).withColumn("one", one).drop(*prev)
    lengths = known.groupBy(key).agg(F.count(F.lit(1)).alias("n_words"))
    rows = store(rows.join(lengths, key).join(lines, key))
    # long lines are cut where every path passes the same words
    cuts = cut_points(rows, [key], piece)
    area = F.floor(F.col("pos") / piece)
    lasts = rows.where("end").select(key, F.col("pos").alias("_last"))
    reach = F.sequence(F.floor(F.col("first") / piece), F.coalesce(F.floor((F.col("next") - 1) / piece), F.floor(F.col("_last") / piece)))
    spread = cuts.join(lasts, key).select(F.col(key).alias("_k"), "first", "next", F.explode(reach).alias("_a"))
    dealt = rows.withColumn("_a0", area).join(
        spread, (F.col(key) == F.col("_k")) & (F.col("_a0") == F.col("_a")) & (F.col("pos") >= F.col("first"))
        & (F.col("next").isNull() | (F.col("pos") < F.col("next"))), "left").withColumn("first", F.coalesce("first", F.lit(0)))
    buckets = max(1, -(-rows.count() // POSITIONS))
    left = store(dealt.select(F.pmod(F.xxhash64(key, "first"), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), "first", "pos", "words",
                              "sizes", "ids", "orig", "alt", "word_flips", "alt_flips", "n_words", "mult"))
    moves = asked_moves(models, items)
    b = div(F.col("t"), F.lit(BLOCK))
    end, zero = F.lit(last // BLOCK).cast("long"), F.lit(0).cast("long")
    per = moves.groupBy("id", b.alias("b")).agg(F.sum("d").alias("d"), F.sum("d2").alias("d2"))
    line = Window.partitionBy("id").orderBy("b")                          # at most one row per block
    sums = per.select("id", "b", F.coalesce(F.lead("b").over(line), end).alias("next"), F.sum("d").over(line).alias("d"), F.sum("d2").over(line).alias("d2"))
    carried = sums.where(F.col("b") < end).select("id", F.explode(F.sequence(F.col("b") + 1, "next")).alias("b"), "d", "d2")
    carried = carried.where("d <> 0 or d2 <> 0").select("id", (F.col("b") * BLOCK).alias("t"), "d", "d2")
    places = left.select("bucket", F.explode(F.array_distinct("ids")).alias("id")).where("id >= 0").distinct() \
        .unionByName(left.select("bucket", F.lit(-1).cast("long").alias("id")).distinct())
    right = moves.unionByName(carried).join(places, "id").select(F.col("bucket").alias("_bucket"), b.alias("_b"), "id", "t", "d", "d2")
    left = left.withColumn("b", F.explode(F.sequence(zero, end)))
    sums = left.groupBy("bucket", "b").cogroup(right.groupBy("_bucket", "_b")).applyInPandas(_search(n, models.k, last), "i long, rate double")
    return sums.groupBy("i").agg(F.sum("rate").alias("rate"))
