"""Dev perplexity of very many models that differ little, without a (dev key x model) table.

A run of models t = first..last shares most of its statistics: adding one sentence changes the totals of the
empty history and of ``<s>`` for every dev key, and anything else only for the keys that use the sentence's
n-grams.  So a model is a row of *globals* (totals, discounts), and a dev key is a *state*: its counts and its longer
histories' totals.  What is shuffled are changes (n-gram or history, t), joined to the distinct ones that dev keys ask for
(:func:`asked_moves`), and the keys once per block of ``BLOCK`` models.  Inside a block numpy finds the keys a change touches:

* :func:`cumulative_totals`: sentences come in one after another, states are running sums;
* :func:`candidate_totals`: each sentence is added alone to one base; what is added to the base states' sum is the difference
  its changes make to the keys they touch.

:func:`witten_bell` and :func:`kneser_ney` give the columns and the formula of a method.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators.ngrams import BOS, EOS, ngram_events
from varietas.operators.rows import running_totals
from varietas.session import checkpoint, store

# Models per block, dev keys per bucket (about), (candidate, key) pairs and key states per numpy step.
BLOCK, KEYS, PAIRS, STEP = 1024, 8192, 1 << 18, 256
FLAGS = ["bos", "eos"]


@dataclass
class Method:
    """Columns of a smoothing method: per n-gram, per history, further globals; and log10 p from arrays of them."""

    word: list[str]
    history: list[str]
    discounts: list[str]
    log10: Callable[[dict, dict], np.ndarray]


def witten_bell(order: int, k: float = 1.0) -> Method:
    def log10(state: dict, glob: dict) -> np.ndarray:
        p = glob["p0"]
        for m in range(1, order + 1):
            c = _word(state, glob, m, "cw")
            total, types = _history(state, glob, m, ("ch", "th"))
            p = np.where(total > 0, (c + k * types * p) / np.maximum(total + k * types, 1), p)
        return np.log10(p)
    return Method(["cw"], ["ch", "th"], [], log10)


def kneser_ney(order: int) -> Method:
    def log10(state: dict, glob: dict) -> np.ndarray:
        p = glob["p0"]
        for m in range(1, order + 1):
            a = _word(state, glob, m, "aw")
            total, *n = _history(state, glob, m, ("sh", "k1", "k2", "k3"))
            d = [glob[f"d{m}{j}"] for j in (1, 2, 3)]
            own = np.where(a == 1, d[0], np.where(a == 2, d[1], d[2]))
            gamma = d[0] * n[0] + d[1] * n[1] + d[2] * n[2]
            p = np.where(total > 0, (np.maximum(a - own, 0.0) + gamma * p) / np.maximum(total, 1), p)
        return np.log10(p)
    return Method(["aw"], ["sh", "k1", "k2", "k3"], [f"d{m}{j}" for m in range(1, order + 1) for j in (1, 2, 3)], log10)


def _word(state: dict, glob: dict, m: int, name: str) -> np.ndarray:
    """Count of a key's n-gram of order m; that of ``</s>`` alone, which every sentence raises, is global."""
    return np.where(state["eos"] == 1, glob[f"{name}E"], state[f"{name}1"]) if m == 1 else state[f"{name}{m}"]


def _history(state: dict, glob: dict, m: int, names: tuple) -> list:
    """Totals of a key's history of order m: order 1 and ``<s>`` are global."""
    if m == 1:
        return [glob[f"{x}1"] for x in names]
    if m == 2:
        return [np.where(state["bos"] == 1, glob[f"{x}B"], state[f"{x}2"]) for x in names]
    return [state[f"{x}{m}"] for x in names]


def is_global(order: Column, h: Column) -> Column:
    return (order == 1) | ((order == 2) & (h == BOS))


def dev_keys(dev: DataFrame, order: int, vocab: DataFrame, dev_key: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(kid, mult, bos, eos) of the distinct dev keys, and their n-grams (kid, ord, h, w); both stored."""
    shell = L.LM(order, "", None, None, vocab)
    keys = L.scoring_events(dev, shell, dev_key, text_col).groupBy("hs", "w").agg(F.count(F.lit(1)).alias("mult"))
    keys = keys.withColumn("kid", F.concat_ws("\u0001", F.array_join("hs", "\u0002"), "w"))     # exact key, no hash
    keys = checkpoint(keys.withColumn("bos", F.coalesce((F.try_element_at("hs", F.lit(2)) == BOS).cast("int"), F.lit(0)))
                      .withColumn("eos", (F.col("w") == EOS).cast("int")))
    grams = keys.select("kid", "w", F.posexplode("hs").alias("_o", "h")).select("kid", (F.col("_o") + 1).alias("ord"), "h", "w")
    return keys.select("kid", "mult", *FLAGS), checkpoint(grams)


def state_columns(method: Method, order: int) -> list[str]:
    return [*FLAGS, *[f"{x}{m}" for m in range(1, order + 1) for x in method.word],
            *[f"{x}{m}" for m in range(2, order + 1) for x in method.history]]


def key_moves(grams: DataFrame, word_moves: DataFrame, history_moves: DataFrame, method: Method, order: int, at: list[str]) -> DataFrame:
    """(kid, at..., state columns): changes of the keys' states.

    ``word_moves`` (ord, h, w, at..., word columns) and ``history_moves`` (ord, h, at..., history columns) are
    joined to the keys' n-grams; the globals' histories are left out.
    """
    zero = F.lit(0).cast("long")
    own = grams.where((F.col("ord") > 1) | (F.col("w") != EOS)).join(word_moves, ["ord", "h", "w"]).select("kid", "ord", *at, *method.word, *[zero.alias(x) for x in method.history])
    hist = grams.where(~is_global(F.col("ord"), F.col("h"))).join(history_moves, ["ord", "h"]).select(
        "kid", "ord", *at, *[zero.alias(x) for x in method.word], *method.history)
    cols = [(x, m) for m in range(1, order + 1) for x in method.word] + [(x, m) for m in range(2, order + 1) for x in method.history]
    return own.unionByName(hist).groupBy("kid", *at).agg(
        *[F.sum(F.when(F.col("ord") == m, F.col(x)).otherwise(0)).alias(f"{x}{m}") for x, m in cols])


def asked_moves(keys: DataFrame, grams: DataFrame, word_moves: DataFrame, history_moves: DataFrame, method: Method, order: int,
                buckets: int) -> tuple[DataFrame, DataFrame]:
    """What candidates change of what the dev keys ask for, joined to the n-grams' numbers and not to the keys.

    Returns (kid, bucket, g1..gN, x2..xN), the numbers of a key's n-grams and histories, and (t, bucket, id, changes): a row per
    changed n-gram or history and bucket of keys that asks for it, however many keys do.
    """
    own = grams.where((F.col("ord") > 1) | (F.col("w") != EOS)).select("kid", "ord", "h", "w", F.lit(True).alias("own"))
    hist = grams.where(~is_global(F.col("ord"), F.col("h"))).select("kid", "ord", "h", F.lit("").alias("w"), F.lit(False).alias("own"))
    asked = own.unionByName(hist)
    ids = checkpoint(asked.select("ord", "h", "w", "own").distinct().withColumn("id", F.monotonically_increasing_id()))
    bucket = F.pmod(F.xxhash64("kid"), F.lit(buckets)).alias("bucket")
    asked = checkpoint(asked.join(ids, ["ord", "h", "w", "own"]).select("kid", bucket, "ord", "own", "id"))
    pick = lambda own, m: F.max(F.when((F.col("own") == own) & (F.col("ord") == m), F.col("id")))
    numbers = keys.select("kid", bucket).join(asked.groupBy("kid").agg(
        *[pick(True, m).alias(f"g{m}") for m in range(1, order + 1)], *[pick(False, m).alias(f"x{m}") for m in range(2, order + 1)]), "kid", "left")
    places = ids.join(asked.select("id", "bucket").distinct(), "id")
    zero = F.lit(0).cast("long")
    of_words = word_moves.join(places.where("own").drop("own"), ["ord", "h", "w"]) \
        .select("t", "bucket", "id", *method.word, *[zero.alias(x) for x in method.history])
    of_histories = history_moves.join(places.where(~F.col("own")).drop("own", "w"), ["ord", "h"]) \
        .select("t", "bucket", "id", *[zero.alias(x) for x in method.word], *method.history)
    return numbers, of_words.unionByName(of_histories)


def _slots(method: Method, order: int) -> list[tuple[str, int, list[str]]]:
    """A key's numbers (:func:`asked_moves`) with the order and the columns that their changes go to."""
    return [(f"g{m}", m, method.word) for m in range(1, order + 1)] + [(f"x{m}", m, method.history) for m in range(2, order + 1)]


def _global_rows(globals_: DataFrame, moves: DataFrame, method: Method, buckets: int) -> DataFrame:
    """Rows of the globals (id -1) for every bucket, and the moves, in one table with the block ``b`` of their t."""
    names, changes = [c for c in globals_.columns if c != "t"], method.word + method.history
    zero, minus = F.lit(0).cast("long"), F.lit(-1).cast("long")
    rows = checkpoint(globals_).select("t", F.explode(F.sequence(zero, F.lit(buckets - 1).cast("long"))).alias("bucket"), minus.alias("id"),
                                       *[F.col(c).cast("double").alias(f"_{c}") for c in names], *[zero.alias(c) for c in changes])
    moves = moves.select("t", "bucket", "id", *[F.lit(None).cast("double").alias(f"_{c}") for c in names], *changes)
    return rows.unionByName(moves).withColumn("b", F.floor(F.col("t") / BLOCK))


def cumulative_totals(keys: DataFrame, grams: DataFrame, word_moves: DataFrame, history_moves: DataFrame, globals_: DataFrame,
                      method: Method, order: int, last: int) -> DataFrame:
    """(t, total): sum over dev keys of mult x log10 p, when the moves up to t add up to model t.

    ``BLOCK`` models and a bucket of about ``KEYS`` dev keys meet in one cogroup, with the moves of these models and, per asked
    n-gram, the sum of all moves before.  A key's states are running sums in numpy, ``STEP`` keys at a time.
    """
    cols = state_columns(method, order)
    buckets = max(1, -(-keys.count() // KEYS))
    numbers, moves = asked_moves(keys, grams, word_moves, history_moves, method, order, buckets)
    zero, minus, end = F.lit(0).cast("long"), F.lit(-1).cast("long"), F.lit(last // BLOCK).cast("long")
    slots, names, changes = _slots(method, order), [c for c in globals_.columns if c != "t"], method.word + method.history
    left = keys.join(numbers, "kid").select("bucket", "mult", *FLAGS, *[F.coalesce(g, minus).alias(g) for g, _, _ in slots])
    left = left.withColumn("b", F.explode(F.sequence(zero, end)))
    per = moves.groupBy("bucket", "id", F.floor(F.col("t") / BLOCK).alias("b")).agg(*[F.sum(c).alias(c) for c in changes])
    line = Window.partitionBy("bucket", "id").orderBy("b")               # at most one row per block
    sums = per.select("bucket", "id", "b", F.coalesce(F.lead("b").over(line), end).alias("next"), *[F.sum(c).over(line).alias(c) for c in changes])
    carried = sums.where(F.col("b") < end).select("bucket", "id", F.explode(F.sequence(F.col("b") + 1, "next")).alias("b"), *changes)
    carried = carried.select((F.col("b") * BLOCK).alias("t"), "bucket", "id", *changes)
    right = _global_rows(globals_, moves.unionByName(carried), method, buckets)
    log10 = method.log10

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        glob = right[right["id"] < 0].sort_values("t")
        ts = glob["t"].to_numpy(np.int64)
        if len(left) == 0 or len(ts) == 0:
            return pd.DataFrame({"t": pd.Series([], dtype="int64"), "total": pd.Series([], dtype="float64")})
        g = {c: glob[f"_{c}"].to_numpy(np.float64)[None, :] for c in names}
        moves = right[right["id"] >= 0].sort_values("id", kind="stable")
        ids, at = moves["id"].to_numpy(np.int64), np.searchsorted(ts, moves["t"].to_numpy(np.int64))
        change = {c: moves[c].to_numpy(np.float64) for c in changes}
        # keys that ask for the same of what has moved so far are one
        asked = left[[s for s, _, _ in slots]].to_numpy(np.int64)
        asked = np.where(np.isin(asked, ids), asked, -1)
        kinds, kind = np.unique(np.column_stack([left[FLAGS].to_numpy(np.int64), asked]), axis=0, return_inverse=True)
        mult = np.bincount(kind.ravel(), left["mult"].to_numpy(np.float64))
        total = np.zeros(len(ts))
        for lo in range(0, len(kinds), STEP):
            part = kinds[lo:lo + STEP]
            state = {c: part[:, i, None].astype(np.float64) for i, c in enumerate(FLAGS)}
            for i, (_, m, into) in enumerate(slots, start=len(FLAGS)):
                start = np.searchsorted(ids, part[:, i], "left")
                count = np.searchsorted(ids, part[:, i], "right") - start
                row = np.repeat(np.arange(len(part)), count)
                move = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                place = row * len(ts) + at[move]
                for c in into:
                    step = np.bincount(place, change[c][move], len(part) * len(ts)).reshape(len(part), len(ts))
                    state[f"{c}{m}"] = np.cumsum(step, axis=1)
            total += mult[lo:lo + STEP] @ log10(state, g)
        return pd.DataFrame({"t": ts, "total": total})

    parts = left.groupBy("b", "bucket").cogroup(right.groupBy("b", "bucket")).applyInPandas(run, "t long, total double")
    return parts.groupBy("t").agg(F.sum("total").alias("total"))


def candidate_totals(keys: DataFrame, grams: DataFrame, word_moves: DataFrame, history_moves: DataFrame, globals_: DataFrame,
                     method: Method, order: int, last: int) -> DataFrame:
    """(t, total): sum over dev keys of mult x log10 p, when model t is the base (the moves of t = 0) with those of candidate t alone.

    ``BLOCK`` candidates and a bucket of about ``KEYS`` dev keys meet in one cogroup: the base states' sum under each candidate's
    globals, and for the keys it touches the difference its changes make.  A (key, candidate) pair exists in numpy only,
    ``PAIRS`` at a time.
    """
    cols = state_columns(method, order)
    own, of_candidates = F.col("t") == 0, F.col("t") > 0
    base = key_moves(grams, word_moves.where(own).drop("t"), history_moves.where(own).drop("t"), method, order, [])
    buckets = max(1, -(-keys.count() // KEYS))
    numbers, moves = asked_moves(keys, grams, word_moves.where(of_candidates), history_moves.where(of_candidates), method, order, buckets)
    zero, minus = F.lit(0).cast("long"), F.lit(-1).cast("long")
    slots = _slots(method, order)
    left = keys.join(base, "kid", "left").join(numbers, "kid").select(
        "bucket", "mult", *FLAGS, *[F.coalesce(c, zero).alias(c) for c in cols if c not in FLAGS], *[F.coalesce(g, minus).alias(g) for g, _, _ in slots])
    left = left.withColumn("b", F.explode(F.sequence(zero, F.lit(last // BLOCK).cast("long"))))
    names = [c for c in globals_.columns if c != "t"]
    right = _global_rows(globals_, moves, method, buckets)
    log10 = method.log10

    def finite(state: dict, glob: dict) -> tuple[np.ndarray, np.ndarray]:
        """log10 p, 0 where p is 0, and whether it is: sums of differences stay defined."""
        with np.errstate(divide="ignore"):
            lp = log10(state, glob)
        dead = np.isneginf(lp)
        return np.where(dead, 0.0, lp), dead

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        glob = right[right["id"] < 0].sort_values("t")
        ts = glob["t"].to_numpy(np.int64)
        if len(left) == 0 or len(ts) == 0:
            return pd.DataFrame({"t": pd.Series([], dtype="int64"), "total": pd.Series([], dtype="float64"), "dead": pd.Series([], dtype="int64")})
        state, mult = left[cols].to_numpy(np.float64), left["mult"].to_numpy(np.float64)
        g = glob[[f"_{c}" for c in names]].to_numpy(np.float64)
        # all keys in their base states: distinct states x distinct globals
        classes, of = np.unique(state, axis=0, return_inverse=True)
        weight = np.bincount(of.ravel(), mult)
        kinds, kind = np.unique(g, axis=0, return_inverse=True)
        total, zeros = np.zeros(len(kinds)), np.zeros(len(kinds))
        for lo in range(0, len(classes), STEP):
            part = classes[lo:lo + STEP]
            lp, dead = finite({c: part[:, i, None] for i, c in enumerate(cols)}, {c: kinds[None, :, i] for i, c in enumerate(names)})
            total += weight[lo:lo + STEP] @ lp
            zeros += weight[lo:lo + STEP] @ dead
        total, zeros = total[kind.ravel()], zeros[kind.ravel()]
        # the keys a candidate touches: the difference between their changed and their base states
        moves = right[right["id"] >= 0].sort_values("t", kind="stable")
        who, ids = np.searchsorted(ts, moves["t"].to_numpy(np.int64)), moves["id"].to_numpy(np.int64)
        found = []
        for slot, m, changed in slots:
            asked = left[slot].to_numpy(np.int64)
            order_ = np.argsort(asked, kind="stable")
            start = np.searchsorted(asked[order_], ids, "left")
            found.append((order_, start, np.searchsorted(asked[order_], ids, "right") - start, [cols.index(f"{x}{m}") for x in changed],
                          moves[changed].to_numpy(np.float64)))
        before = np.r_[0, np.cumsum(sum(f[2] for f in found))]              # pairs before each move
        first_of = np.searchsorted(who, np.arange(len(ts) + 1))              # a candidate's moves stay together
        at = 0
        while at < len(ts):
            end = int(np.searchsorted(before[first_of], before[first_of[at]] + PAIRS, "right")) - 1
            end = min(max(end, at + 1), len(ts))
            lo, hi = first_of[at], first_of[end]
            codes, values = [], []
            for order_, start, count, _, change in found:
                n = count[lo:hi]
                row = np.repeat(np.arange(lo, hi), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                codes.append(who[row] * len(left) + order_[start[row] + place])
                values.append(change[row])
            at = end
            pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
            t, key = pairs // len(left), pairs % len(left)
            new, splits = state[key], np.split(place.ravel(), np.cumsum([len(c) for c in codes])[:-1])
            for (_, _, _, into, _), value, rows in zip(found, values, splits):
                for j, c in enumerate(into):
                    new[rows, c] += value[:, j]                              # one change per candidate, key and slot
            here = {c: g[t, i] for i, c in enumerate(names)}
            lp, dead = finite({c: new[:, i] for i, c in enumerate(cols)}, here)
            lp0, dead0 = finite({c: state[key, i] for i, c in enumerate(cols)}, here)
            total += np.bincount(t, mult[key] * (lp - lp0), len(ts))
            zeros += np.bincount(t, mult[key] * (dead.astype(float) - dead0), len(ts))
        return pd.DataFrame({"t": ts, "total": total, "dead": zeros.astype(np.int64)})

    parts = left.groupBy("b", "bucket").cogroup(right.groupBy("b", "bucket")).applyInPandas(run, "t long, total double, dead long")
    return parts.groupBy("t").agg(F.when(F.sum("dead") > 0, F.lit(float("-inf"))).otherwise(F.sum("total")).alias("total"))


def dense_globals(first: int, last: int, word_moves: DataFrame, history_moves: DataFrame, method: Method, vocab: DataFrame,
                  cc_moves: DataFrame | None = None, order: int = 3, cumulative: bool = True) -> DataFrame:
    """(t, p0, totals of the empty history and of ``<s>``, count of ``</s>``, discounts) for t = first..last.

    The changes at each t are added up over t, or (not ``cumulative``) to those at t = ``first``.  ``cc_moves``
    (ord, t, n1..n4) are changes of the count-of-counts, from which Kneser–Ney's discounts follow.
    """
    h, names = history_moves, []
    sums = []
    for tag, cond in (("1", F.col("ord") == 1), ("B", (F.col("ord") == 2) & (F.col("h") == BOS))):
        names += [f"{x}{tag}" for x in method.history]
        sums += [F.sum(F.when(cond, F.col(x)).otherwise(0)).alias(f"{x}{tag}") for x in method.history]
    parts = [h.where(is_global(F.col("ord"), F.col("h"))).groupBy("t").agg(*sums)]
    ends = word_moves.where((F.col("ord") == 1) & (F.col("w") == EOS))
    parts.append(ends.groupBy("t").agg(*[F.sum(x).alias(f"{x}E") for x in method.word]))
    names += [f"{x}E" for x in method.word]
    if cc_moves is not None:
        own = [(m, j) for m in range(1, order + 1) for j in range(1, 5)]
        parts.append(cc_moves.groupBy("t").agg(*[F.sum(F.when(F.col("ord") == m, F.col(f"n{j}")).otherwise(0)).alias(f"n{m}{j}") for m, j in own]))
        names += [f"n{m}{j}" for m, j in own]
    zero = F.lit(0).cast("long")
    spark = vocab.sparkSession
    rows = spark.range(first, last + 1).select(F.col("id").alias("t"), *[zero.alias(c) for c in names])
    for part in parts:
        have = set(part.columns)
        rows = rows.unionByName(part.select(F.greatest(F.col("t"), F.lit(first)).cast("long").alias("t"),
                                            *[(F.col(c).cast("long") if c in have else zero).alias(c) for c in names]))
    rows = rows.groupBy("t").agg(*[F.sum(c).alias(c) for c in names])
    if cumulative:
        rows = running_totals(rows, "t", names)
    else:
        base = rows.where(F.col("t") == first).select(F.struct(*names)).scalar()
        rows = rows.withColumn("_base", base)
        rows = rows.select("t", *[F.when(F.col("t") == first, F.col(c)).otherwise(F.col(c) + F.col(f"_base.{c}")).alias(c) for c in names])
    p0 = F.lit(1.0) / vocab.select(F.count(F.lit(1))).scalar()
    rows = rows.withColumn("p0", p0)
    if cc_moves is not None:
        for m in range(1, order + 1):
            for j, d in enumerate(L.kn_discount_columns([F.col(f"n{m}{j}") for j in range(1, 5)]), start=1):
                rows = rows.withColumn(f"d{m}{j}", d)
    keep = [c for c in names if not (cc_moves is not None and c[0] == "n" and c[1:].isdigit())]
    return rows.select("t", "p0", *keep, *method.discounts)


def curve_moves(tagged: DataFrame, method: Method, order: int, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Changes along t of lines (t, text) that come in one after another: (vocabulary, per n-gram, per history, count-of-counts)."""
    ev = ngram_events(tagged, order, text_col, keep=["t"])
    raw = store(ev.groupBy("ord", "h", "w", "t").agg(F.count(F.lit(1)).alias("d")))
    vocab = L.vocabulary(raw)
    first = raw.groupBy("ord", "h", "w").agg(F.min("t").alias("t"))
    zero = F.lit(0).cast("long")
    if method.word == ["cw"]:
        types = first.select("ord", "h", "t", zero.alias("ch"), F.lit(1).cast("long").alias("th"))
        history = raw.select("ord", "h", "t", F.col("d").alias("ch"), zero.alias("th")).unionByName(types)
        return vocab, raw.withColumnRenamed("d", "cw"), history.groupBy("ord", "h", "t").agg(F.sum("ch").alias("ch"), F.sum("th").alias("th")), None
    # Kneser–Ney: raw counts at the top order and behind <s>, else first appearances of left neighbours
    cont = first.where(F.col("ord") >= 2).select((F.col("ord") - 1).alias("ord"), L.lower_history(F.col("h")).alias("h"), "w", "t") \
        .groupBy("ord", "h", "w", "t").agg(F.count(F.lit(1)).alias("d"))
    top = (F.col("ord") == order) | L.opens_sentence(F.col("h"))
    a = store(raw.where(top).unionByName(cont.where(~top)))
    line = Window.partitionBy("ord", "h", "w").orderBy("t")
    run = a.withColumn("now", F.sum("d").over(line))
    run = run.withColumn("was", F.col("now") - F.col("d"))
    counted = store(run.select("ord", "h", "w", "t", "d", *_bins("was", "now")))
    history = counted.groupBy("ord", "h", "t").agg(F.sum("d").alias("sh"), *[F.sum(f"k{j}").alias(f"k{j}") for j in (1, 2, 3)])
    cc = counted.groupBy("ord", "t").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in (1, 2, 3, 4)])
    return vocab, a.withColumnRenamed("d", "aw"), history, cc


def _bins(was: str, now: str) -> list[Column]:
    """Changes of the numbers of types seen once, twice, 3+ times (k1..k3) and 1..4 times (n1..n4) when a count goes from ``was`` to ``now``."""
    hit = lambda c, j, up: ((F.col(c) >= j) if up else (F.col(c) == j)).cast("long")
    return [*[(hit(now, j, j == 3) - hit(was, j, j == 3)).alias(f"k{j}") for j in (1, 2, 3)],
            *[(hit(now, j, False) - hit(was, j, False)).alias(f"n{j}") for j in (1, 2, 3, 4)]]


def candidate_moves(base: DataFrame, candidates: DataFrame, method: Method, order: int, text_col: str) -> tuple:
    """Base statistics at t = 0 and each candidate's own changes at its t >= 1 (t, text): (vocabulary, per n-gram, per history,
    count-of-counts or None), tables with t."""
    zero = F.lit(0).cast("long")
    nil = F.lit(0).cast("long").alias("t")
    bev = ngram_events(base.select(text_col), order, text_col)
    b = store(bev.groupBy("ord", "h", "w").agg(F.count(F.lit(1)).alias("c")))
    # dealt by line first: a line's n-grams are then counted where they are cut, and not shuffled
    e = store(ngram_events(candidates.repartition("t"), order, text_col, keep=["t"]).groupBy("t", "ord", "h", "w").agg(F.count(F.lit(1)).alias("e")))
    vocab = L.vocabulary(b.select("ord", "w").unionByName(e.select("ord", "w")).distinct())
    new = e.join(b.select("ord", "h", "w"), ["ord", "h", "w"], "left_anti")
    if method.word == ["cw"]:
        word = b.select("ord", "h", "w", nil, F.col("c").alias("cw")).unionByName(e.select("ord", "h", "w", "t", F.col("e").alias("cw")))
        history = b.select("ord", "h", nil, F.col("c").alias("ch"), F.lit(1).cast("long").alias("th")) \
            .unionByName(e.select("ord", "h", "t", F.col("e").alias("ch"), zero.alias("th"))) \
            .unionByName(new.select("ord", "h", "t", zero.alias("ch"), F.lit(1).cast("long").alias("th")))
        return vocab, word, history.groupBy("ord", "h", "t").agg(F.sum("ch").alias("ch"), F.sum("th").alias("th")), None
    top = (F.col("ord") == order) | L.opens_sentence(F.col("h"))
    ab = store(L.kn_counts(b, order).select("ord", "h", "w", "a"))
    cont = new.where(F.col("ord") >= 2).select("t", (F.col("ord") - 1).alias("ord"), L.lower_history(F.col("h")).alias("h"), "w") \
        .groupBy("t", "ord", "h", "w").agg(F.count(F.lit(1)).alias("d"))
    d = e.where(top).select("t", "ord", "h", "w", F.col("e").alias("d")).unionByName(cont.where(~top))
    moved = d.join(ab, ["ord", "h", "w"], "left").withColumn("was", F.coalesce("a", zero)).drop("a")
    moved = moved.unionByName(ab.select("ord", "h", "w", nil, F.col("a").alias("d"), zero.alias("was")))
    counted = store(moved.withColumn("now", F.col("was") + F.col("d")).select("ord", "h", "w", "t", "d", *_bins("was", "now")))
    history = counted.groupBy("ord", "h", "t").agg(F.sum("d").alias("sh"), *[F.sum(f"k{j}").alias(f"k{j}") for j in (1, 2, 3)])
    cc = counted.groupBy("ord", "t").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in (1, 2, 3, 4)])
    return vocab, counted.select("ord", "h", "w", "t", F.col("d").alias("aw")), history, cc
