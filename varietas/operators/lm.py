"""N-gram language models as DataFrames.

A model is two tables plus a vocabulary:

* ``probs(ord, h, w, p)``  — p(w | h) for every *seen* n-gram, fully smoothed;
* ``gammas(ord, h, g)``    — for every seen history, the weight that carries an unseen word down
  to the next shorter history;
* ``vocab(w)``             — the fixed vocabulary V (training words, ``</s>`` and ``<unk>``; not ``<s>``).

Every method (Witten–Bell, absolute discounting, modified Kneser–Ney, Katz, unsmoothed,
presmoothed) is written in this one form, so scoring is the same join cascade for all:
p(w | h) = p_seen at the longest order n* where (h_n*, w) was seen, times g(h_m) for each longer
history h_m that was seen (unseen histories pass the probability down unchanged); nothing seen at
all starts from the uniform floor 1/|V|.  For the interpolated methods p_seen itself is computed
order by order from the next lower order, one equi-join per order (recursion unrolled).

Formulas: Witten & Bell 1991, Katz 1987, Ney et al. 1994, Kneser & Ney 1995, Chen & Goodman 1998,
Seymore & Rosenfeld 1996 (see SURVEY §2.8.1 for the exact choices).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.operators.ngrams import (BOS, EOS, UNK, context_stats, count_of_counts, lower_history,
                                       ngram_counts, sentence_tokens)
from varietas.session import checkpoint, store

METHODS = ("witten_bell", "unsmoothed", "absolute", "kneser_ney", "katz", "presmoothed")
# Kneser–Ney discounts used when the count-of-counts leave them undefined.
KN_FALLBACK = (0.5, 1.0, 1.5)
# Models and scored keys (about) that meet in one task when many models are scored.
MODELS, KEYS = 256, 16_384


@dataclass
class LM:
    order: int
    method: str
    probs: DataFrame
    gammas: DataFrame
    vocab: DataFrame
    seen: DataFrame | None = None

    def vocab_size(self) -> Column:
        return self.vocab.select(F.count(F.lit(1))).scalar()

    def lookup(self, keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """(by..., h, w, p) of distinct keys; what a decoder asks of a model."""
        return lookup_prob(keys, self, by)

    def weighted(self) -> DataFrame:
        """(ord, h, w, p, g): every seen n-gram with its history's weight; no join where the model was just built."""
        return self.seen if self.seen is not None else self.probs.join(self.gammas, ["ord", "h"]).select("ord", "h", "w", "p", "g")

    def materialize(self) -> "LM":
        """Store the model tables once (Parquet in the checkpoint folder) so every later lookup reads them instead
        of re-running the training plan; also what survives a lost executor."""
        return LM(self.order, self.method, store(self.probs), store(self.gammas), store(self.vocab))


def vocabulary(counts: DataFrame, extra: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """V = words predicted at order 1, plus ``</s>`` and ``<unk>`` (``extra`` words are added too), per model key ``by``."""
    v = counts.where(F.col("ord") == 1).select(*by, "w")
    if by:
        return v.unionByName(v.select(*by).distinct().select(*by, F.explode(F.array(F.lit(EOS), F.lit(UNK))).alias("w"))).distinct()
    spark = counts.sparkSession
    v = v.unionByName(spark.createDataFrame([(EOS,), (UNK,)], "w string"))
    if extra is not None:
        v = v.unionByName(extra.select("w"))
    return v.distinct()


def _div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 (count-of-counts can be empty on small corpora)."""
    return F.when(b != 0, a / b)


def _cc_wide(counts: DataFrame, count_col: str, upto: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, cc1..ccN): count-of-counts per order as columns (one row per order)."""
    cc = count_of_counts(counts, count_col, by)
    return cc.groupBy(*by, "ord").agg(*[F.sum(F.when(F.col("c") == j, F.col("n")).otherwise(0)).alias(f"cc{j}")
                                   for j in range(1, upto + 1)])


def _lower(prev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return prev.select(*by, F.col("h").alias("_lh"), F.col("w").alias("_lw"), F.col("p").alias("p_lower"))


def _attach_lower(cur: DataFrame, prev: DataFrame | None, p0: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Add p_lower = p(w | h without oldest word) from the previous order (or the uniform floor)."""
    if prev is None:
        return cur.withColumn("p_lower", p0)
    lo = _lower(prev, by)
    if by:
        return cur.withColumn("_lh", lower_history(F.col("h"))).withColumn("_lw", F.col("w")).join(lo, [*by, "_lh", "_lw"], "left").drop("_lh", "_lw")
    j = cur.join(lo, (lower_history(cur["h"]) == lo["_lh"]) & (cur["w"] == lo["_lw"]), "left")
    return j.drop("_lh", "_lw")


def kn_counts(counts: DataFrame, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, h, w, c, a): modified counts — raw at the top order and for n-grams opening with ``<s>``,
    else the number of distinct words seen to the left (continuation count)."""
    parts = []
    for n in range(1, order + 1):
        cur = counts.where(F.col("ord") == n)
        if n == order:
            parts.append(cur.withColumn("a", F.col("c")))
            continue
        up = counts.where(F.col("ord") == n + 1)
        cont = (up.select(*by, lower_history(F.col("h")).alias("h"), "w")
                .groupBy(*by, "h", "w").agg(F.count(F.lit(1)).alias("_cont")))
        j = cur.join(cont, [*by, "h", "w"], "left")
        starts_bos = (F.col("h") == BOS) | F.col("h").startswith(BOS + " ")
        a = F.when(starts_bos, F.col("c")).otherwise(F.coalesce(F.col("_cont"), F.col("c")))
        parts.append(j.withColumn("a", a).drop("_cont"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def opens_sentence(h: Column) -> Column:
    """Whether a history begins with ``<s>``."""
    return (h == BOS) | h.startswith(BOS + " ")


def kn_discount_columns(n: list[Column], discount_fallback: bool = True) -> list[Column]:
    """D1, D2, D3+ of modified Kneser–Ney from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    y = _div(n[0], n[0] + 2 * n[1])
    d1 = 1 - 2 * y * _div(n[1], n[0])
    d2 = 2 - 3 * y * _div(n[2], n[1])
    d3 = 3 - 4 * y * _div(n[3], n[2])

    def ok(d, j):
        return d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d <= j)
    good = ok(d1, 1) & ok(d2, 2) & ok(d3, 3)
    if discount_fallback:
        return [F.when(good, d).otherwise(F.lit(fb)) for d, fb in zip((d1, d2, d3), KN_FALLBACK)]
    err = F.raise_error(F.lit("Kneser-Ney discounts undefined; use discount_fallback=True"))
    return [F.when(good, d).otherwise(err.cast("double")) for d in (d1, d2, d3)]


def _kn_discounts(kn: DataFrame, discount_fallback: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, d1, d2, d3) from count-of-counts of the modified counts."""
    cc = _cc_wide(kn, "a", 4, by)
    pick = kn_discount_columns([F.col(f"cc{j}") for j in range(1, 5)], discount_fallback)
    return cc.select(*by, "ord", pick[0].alias("d1"), pick[1].alias("d2"), pick[2].alias("d3"))


def _katz_discounts(counts: DataFrame, bins: int, by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(by..., ord, kd1..kdK): Good–Turing/Katz discount ratio for counts 1..K."""
    k = 5 if bins is None or bins < 0 else bins
    cc = _cc_wide(counts, "c", k + 1, by)
    a = _div((k + 1) * F.col(f"cc{k + 1}"), F.col("cc1"))
    cols = []
    for r in range(1, k + 1):
        rstar = _div((r + 1) * F.col(f"cc{r + 1}"), F.col(f"cc{r}"))
        d = _div(rstar / F.lit(r) - a, 1 - a)
        good = d.isNotNull() & ~F.isnan(d) & (d > 0) & (d <= 1)
        cols.append(F.when(good, d).otherwise(F.lit(1.0)).alias(f"kd{r}"))
    return cc.select(*by, "ord", *cols), k


def _abs_discounts(counts: DataFrame, discount: float | None, bins: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, dabs1..dabsB): the discount of counts 1, 2, .. and from B (``bins``) on.

    One bin is D = n1 / (n1 + 2 n2).  With more, bin j takes D_j = j - (j + 1) D n_(j+1) / n_j, and D where that is
    undefined or outside [0, j].  An order with neither singletons nor doubletons falls back to 0.5.
    """
    cc = _cc_wide(counts, "c", max(2, bins + 1), by)
    d = F.lit(float(discount)) if discount is not None and discount >= 0 else \
        F.coalesce(_div(F.col("cc1"), F.col("cc1") + 2 * F.col("cc2")), F.lit(0.5))
    cols = [d]
    if bins > 1:
        per = [F.lit(float(j)) - (j + 1) * d * _div(F.col(f"cc{j + 1}"), F.col(f"cc{j}")) for j in range(1, bins + 1)]
        cols = [F.when(c.isNotNull() & (c >= 0) & (c <= j), c).otherwise(d) for j, c in enumerate(per, start=1)]
    return cc.select(*by, "ord", *[c.alias(f"dabs{j}") for j, c in enumerate(cols, start=1)])


def build_lm(counts: DataFrame, order: int = 3, method: str = "witten_bell", k: float = 1.0,
             discount: float | None = None, bins: int = -1, discount_fallback: bool = False,
             vocab: DataFrame | None = None, materialize: bool = False, store_counts: bool = False,
             by: tuple[str, ...] = ()) -> LM:
    """Smooth counts ``(ord, h, w, c)`` into a model.

    ``by`` names model-key columns of the counts (and of ``vocab``, if given): all models are built in one job, and
    their tables carry the key.  ``bins`` is Katz' highest discounted count (-1: 5), or the number of discounts of
    absolute discounting (-1: 1).

    ``store_counts`` first stores the counts (Parquet in the checkpoint folder — this runs a job) so every order,
    context table and discount table reads them instead of re-deriving them; Spark's exchange reuse
    already shares most of that work, and on an idle local run the extra write did not pay off, so it
    is off by default (measured: Kneser–Ney at sf0.1 16 s lazy, 20 s stored).  With ``materialize``
    the counts and the model tables are stored (see :meth:`LM.materialize`).
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    if materialize or store_counts:
        counts = store(counts)     # the model tables below then start from stored counts
    v = vocab if vocab is not None else vocabulary(counts, by=by)
    keyed_vocab = bool(by) and set(by) <= set(v.columns)        # else one vocabulary for all models
    if keyed_vocab:
        sizes = v.groupBy(*by).agg((F.lit(1.0) / F.count(F.lit(1))).alias("_p0"))
        p0 = F.col("_p0")
    else:
        p0 = F.lit(1.0) / v.select(F.count(F.lit(1))).scalar()
    if method == "kneser_ney":
        counts = kn_counts(counts, order, by)
        cnt = "a"
        disc = _kn_discounts(counts, discount_fallback, by)
    else:
        cnt = "c"
    if method == "katz":
        disc, kk = _katz_discounts(counts, bins, by)
    if method == "absolute":
        ab = max(1, bins)
        disc = _abs_discounts(counts, discount, ab, by)
    probs_by_order, gammas_by_order, seen_by_order = [], [], []
    prev = None
    # else the weight is a sum over the n-grams of a history
    by_history = method in ("witten_bell", "unsmoothed", "presmoothed", "kneser_ney") or (method == "absolute" and ab == 1)

    def discounted(cur):
        return cur.join(disc, [*by, "ord"]) if by else cur.join(F.broadcast(disc), "ord")      # a row per order (and model)

    for n in range(1, order + 1):
        cur = counts.where(F.col("ord") == n)
        ctx = context_stats(cur, cnt, by)
        cur = cur.join(ctx, [*by, "ord", "h"])
        if keyed_vocab and n == 1:
            cur = cur.join(sizes, list(by))
        cur = _attach_lower(cur, prev, p0, by)
        c, ch, th = F.col(cnt).cast("double"), F.col("c_h").cast("double"), F.col("t_h").cast("double")
        pl = F.col("p_lower")
        if method == "witten_bell":
            g = F.lit(k) * th / (ch + F.lit(k) * th)
            p = (c + F.lit(k) * th * pl) / (ch + F.lit(k) * th)
        elif method in ("unsmoothed", "presmoothed"):
            g = F.lit(0.0)
            p = c / ch
        elif method == "absolute":
            cur = discounted(cur)
            d = F.col(f"dabs{ab}")
            for j in range(ab - 1, 0, -1):
                d = F.when(c == j, F.col(f"dabs{j}")).otherwise(d)
            if ab == 1:
                g = d * th / ch
            else:
                # the mass taken from a history is the sum of its discounts
                taken = cur.groupBy(*by, "ord", "h").agg(F.sum(F.least(d, c)).alias("_taken"))
                cur = cur.join(taken, [*by, "ord", "h"])
                g = F.col("_taken") / ch
            p = F.greatest(c - d, F.lit(0.0)) / ch + g * pl
        elif method == "kneser_ney":
            cur = discounted(cur)
            dj = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
            g = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3p")) / ch
            p = F.greatest(c - dj, F.lit(0.0)) / ch + g * pl
        else:  # katz
            cur = discounted(cur)
            dr = F.lit(1.0)
            for r in range(kk, 0, -1):
                dr = F.when(c == r, F.col(f"kd{r}")).otherwise(dr)
            p_katz = dr * c / ch
            # alpha(h) = (1 - sum seen p) / (1 - sum seen p_lower); no mass left -> Witten-Bell mix
            # the left-over mass 1 - sum(d c / c_h) is summed as sum((1 - d) c / c_h): no cancellation
            cur = cur.withColumn("_pk", p_katz).withColumn("_left", (1 - dr) * c / ch)
            sums = cur.groupBy(*by, "ord", "h").agg(F.sum("_left").alias("_num"), F.sum("p_lower").alias("_sl"))
            cur = cur.join(sums, [*by, "ord", "h"])
            num = F.col("_num")
            # at order 1 every seen word has p_lower = 1/|V|: 1 - T/|V| is exact, a sum of T terms is not
            den = (1 - th * p0) if n == 1 else (1 - F.col("_sl"))
            usable = (num > F.lit(1e-12)) & (den > F.lit(1e-12))
            g_wb = th / (ch + th)
            g = F.when(usable, _div(num, den)).otherwise(g_wb)
            p = F.when(usable, F.col("_pk")).otherwise((c + th * pl) / (ch + th))
        cur = cur.withColumn("p", p).withColumn("g", g)
        probs_by_order.append(cur.select(*by, "ord", "h", "w", "p"))
        if by_history:
            own = discounted(ctx) if method in ("absolute", "kneser_ney") else ctx
            gammas_by_order.append(own.select(*by, "ord", "h", g.alias("g")))
        else:
            gammas_by_order.append(cur.select(*by, "ord", "h", "g").dropDuplicates([*by, "ord", "h"]))
        seen_by_order.append(cur.select(*by, "ord", "h", "w", "p", "g"))
        prev = probs_by_order[-1]
    probs, gammas, seen = probs_by_order[0], gammas_by_order[0], seen_by_order[0]
    for p_, g_, s_ in zip(probs_by_order[1:], gammas_by_order[1:], seen_by_order[1:]):
        probs, gammas, seen = probs.unionByName(p_), gammas.unionByName(g_), seen.unionByName(s_)
    model = LM(order, method, probs, gammas, v, seen)
    return model.materialize() if materialize else model


def train_lm(lines: DataFrame, order: int = 3, method: str = "witten_bell", text_col: str = "text",
             skip_symbols: bool = False, round_to_int: bool = False, **kw) -> LM:
    """Count and smooth in one call (``--itype text --otype lm``)."""
    counts = ngram_counts(lines, order, text_col, skip_symbols=skip_symbols, round_to_int=round_to_int)
    return build_lm(counts, order, method, **kw)


def witten_bell_recursion(order: int, p0: Column, k: float = 1.0) -> Column:
    """p(w | h) from columns ``o1..oN`` (structs c, c_h, t_h per order; null where the history is shorter)."""
    p = p0
    for m in range(1, order + 1):
        o = F.col(f"o{m}")
        mixed = (o["c"] + F.lit(k) * o["t_h"] * p) / (o["c_h"] + F.lit(k) * o["t_h"])
        p = F.when(o.isNull() | o["c_h"].isNull() | (o["c_h"] == 0), p).otherwise(mixed)
    return p


# ------------------------------------------------------------------------------------------------
# Scoring (L6, A11, A12)
# ------------------------------------------------------------------------------------------------

def scoring_events(lines: DataFrame, lm: LM, key: str = "sent_id", text_col: str = "text",
                   skip_symbols: bool = False, unk: str = UNK) -> DataFrame:
    """(key, pos, w, oov, hs): one row per scored word (every token plus ``</s>``).

    Words outside V become ``unk`` (L10); ``hs`` holds the histories of orders 1..N, shortest first.
    """
    toks = lines.select(key, F.posexplode(sentence_tokens(F.col(text_col), skip_symbols)).alias("pos", "tok"))
    v = lm.vocab.select(F.col("w").alias("_v"))
    mapped = toks.join(v, toks.tok == v._v, "left").select(
        key, "pos", F.when(F.col("_v").isNull(), F.lit(unk)).otherwise(F.col("tok")).alias("t"),
        F.col("_v").isNull().alias("oov"))
    grouped = (mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "t", "oov"))).alias("_s")))
    sent = lines.select(key).join(grouped, key, "left")
    seq_t = F.coalesce(F.col("_s.t"), F.array().cast("array<string>"))
    seq_o = F.coalesce(F.col("_s.oov"), F.array().cast("array<boolean>"))
    sent = sent.select(key, F.concat(F.array(F.lit(BOS)), seq_t, F.array(F.lit(EOS))).alias("_seq"),
                       F.concat(F.array(F.lit(False)), seq_o, F.array(F.lit(False))).alias("_oov"))
    seq, oov = F.col("_seq"), F.col("_oov")      # plain columns: lambdas below re-evaluate expressions
    n = lm.order
    ev = F.transform(F.sequence(F.lit(1), F.size(seq) - 1), lambda j: F.struct(
        j.alias("pos"), F.element_at(seq, j + 1).alias("w"), F.element_at(oov, j + 1).alias("oov"),
        F.transform(F.sequence(F.lit(1), F.least(F.lit(n), j + 1)),
                    lambda m: F.array_join(F.slice(seq, j - m + 2, m - 1), " ")).alias("hs")))
    return sent.select(key, F.inline(ev))


def score(lines: DataFrame, lm: LM, key: str = "sent_id", text_col: str = "text",
          skip_symbols: bool = False) -> DataFrame:
    """(key, pos, w, log10p, ngram_len, oov) for every word and ``</s>``.

    Only distinct (histories, word) keys are looked up (C4), then joined back to the words.
    ``log10p`` is NULL where the probability is 0 (unsmoothed models).
    """
    ev = scoring_events(lines, lm, key, text_col, skip_symbols)
    keys = ev.select("hs", "w").distinct()
    for m in range(1, lm.order + 1):
        keys = keys.withColumn(f"_h{m}", F.when(F.size("hs") >= m, F.element_at("hs", m)))
    looked = backoff_prob(keys, lm, [f"_h{m}" for m in range(1, lm.order + 1)])
    looked = looked.select("hs", "w", F.when(F.col("p") > 0, F.log10("p")).alias("log10p"), "ngram_len")
    return ev.join(looked, ["hs", "w"]).select(key, "pos", "w", "log10p", "ngram_len", "oov")


def score_models(lm: LM, dev: DataFrame, by: str = "model_id", key: str = "sent_id", text_col: str = "text", groups: int = 16) -> DataFrame:
    """(by, ppl, n_words) of every model of a keyed LM on the dev lines.

    Words outside the vocabulary (the model's own, or the one all models share) count as ``<unk>``.  With a shared vocabulary no
    (model, key) table is built (:func:`_score_sparse`).  Models with vocabularies of their own and keys meet in ``groups`` blocks by
    an equi-join, and each order is one look-up join for all models.
    """
    if by not in lm.vocab.columns:
        return _score_sparse(lm, scoring_events(dev, lm, key, text_col), by)
    ids = lm.gammas.select(by).distinct().withColumn("_g", F.pmod(F.hash(by), F.lit(groups)))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g")
    lines = dev.select(key, text_col, every).join(ids, "_g").drop("_g")
    known = lm.vocab.select(F.col(by).alias("_b"), F.col("w").alias("_v"))
    toks = lines.select(by, key, F.posexplode(sentence_tokens(F.col(text_col), False)).alias("pos", "tok"))
    toks = toks.join(known, (F.col("tok") == F.col("_v")) & (F.col(by) == F.col("_b")), "left") \
        .select(by, key, "pos", F.when(F.col("_v").isNull(), F.lit(UNK)).otherwise(F.col("tok")).alias("t"))
    seqs = lines.select(by, key).join(toks.groupBy(by, key).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("_s")), [by, key], "left")
    seqs = seqs.select(by, F.concat(F.array(F.lit(BOS)), F.coalesce(F.col("_s.t"), F.array().cast("array<string>")), F.array(F.lit(EOS))).alias("_seq"))
    keys = seqs.select(by, F.inline(_history_structs(F.col("_seq"), lm.order))).groupBy(by, "hs", "w").agg(F.count(F.lit(1)).alias("mult"))
    for m in range(1, lm.order + 1):
        keys = keys.withColumn(f"_h{m}", F.when(F.size("hs") >= m, F.element_at("hs", m)))
    looked = backoff_prob(keys, lm, [f"_h{m}" for m in range(1, lm.order + 1)], by=(by,))
    return looked.groupBy(by).agg(F.pow(F.lit(10.0), -F.sum(F.log10("p") * F.col("mult")) / F.sum("mult")).alias("ppl"), F.sum("mult").alias("n_words"))


def _score_sparse(lm: LM, events: DataFrame, by: str) -> DataFrame:
    """(by, ppl, n_words) of every model on the scoring events, where a small model has seen few of what they ask for.

    What is shuffled are the models' n-grams and weights that the distinct keys ask for, as numbers.  ``MODELS`` models
    (about) and ``KEYS`` keys meet in one cogroup; the backoff of :func:`backoff_prob` is one numpy step a model.
    """
    n = lm.order
    keys = events.groupBy("hs", "w").agg(F.count(F.lit(1)).alias("mult"))
    keys = store(keys.withColumn("kid", F.concat_ws("\u0001", F.array_join("hs", "\u0002"), "w")))          # exact key, no hash
    buckets = max(1, -(-keys.count() // KEYS))
    parts = keys.select("kid", "w", F.posexplode("hs").alias("_o", "h")).withColumn("ord", F.col("_o") + 1)
    parts = parts.select("kid", "ord", "h", F.inline(F.array(F.struct("w", F.lit(True).alias("own")), F.struct(F.lit("").alias("w"), F.lit(False).alias("own")))))
    items = store(parts.select("ord", "h", "w", "own").distinct().withColumn("id", F.monotonically_increasing_id()))
    bucket = F.pmod(F.xxhash64("kid"), F.lit(buckets)).alias("bucket")
    asked = store(parts.join(items, ["ord", "h", "w", "own"]).select("kid", bucket, "ord", "own", "id"))
    pick = lambda own, m: F.coalesce(F.max(F.when((F.col("own") == own) & (F.col("ord") == m), F.col("id"))), F.lit(-1).cast("long"))
    numbers = asked.groupBy("kid").agg(*[pick(True, m).alias(f"g{m}") for m in range(1, n + 1)], *[pick(False, m).alias(f"x{m}") for m in range(1, n + 1)])
    places = items.join(asked.select("id", "bucket").distinct(), "id")
    values = lm.probs.join(places.where("own"), ["ord", "h", "w"]).select(by, "bucket", "id", F.col("p").alias("v")) \
        .unionByName(lm.gammas.join(places.where("not own").drop("w"), ["ord", "h"]).select(by, "bucket", "id", F.col("g").alias("v")))
    groups = max(1, -(-lm.gammas.select(by).distinct().count() // MODELS))
    right = values.where(F.col(by).isNotNull()).select(F.col("bucket").alias("_bucket"), F.pmod(F.hash(by), F.lit(groups)).alias("_g"), by, "id", "v")
    left = keys.join(numbers, "kid").withColumn("p0", F.lit(1.0) / lm.vocab_size()).select(
        bucket, "mult", "p0", *[f"{x}{m}" for x in "gx" for m in range(1, n + 1)], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        mult = left["mult"].to_numpy(np.float64)
        asked = left[[f"{x}{m}" for x in "gx" for m in range(1, n + 1)]].to_numpy(np.int64)
        ids, place = np.unique(asked, return_inverse=True)
        place = place.reshape(asked.shape)
        absent = asked < 0
        for model, own in (right.groupby(by, sort=False) if len(left) else ()):
            value = np.full(len(ids), np.nan)
            value[np.searchsorted(ids, own["id"].to_numpy(np.int64))] = own["v"].to_numpy(np.float64)
            p = left["p0"].to_numpy(np.float64)
            for m in range(n):
                seen, weight = value[place[:, m]], value[place[:, n + m]]
                lower = np.where(np.isnan(weight), 1.0, weight) * p
                p = np.where(absent[:, n + m], p, np.where(np.isnan(seen), lower, seen))
            lp = np.log10(p, out=np.zeros(len(p)), where=p > 0)
            out.append((model, float(mult @ lp), int(mult.sum())))
        return pd.DataFrame(out, columns=[by, "lp", "n"])

    id_type = lm.gammas.schema[by].dataType.simpleString()
    sums = left.groupBy("bucket", "g").cogroup(right.groupBy("_bucket", "_g")).applyInPandas(run, f"`{by}` {id_type}, lp double, n long")
    return sums.groupBy(by).agg(F.pow(F.lit(10.0), -F.sum("lp") / F.sum("n")).alias("ppl"), F.sum("n").alias("n_words"))


def _history_structs(seq: Column, order: int) -> Column:
    """array<struct<w, hs>>: every word of a padded sentence with its histories of orders 1..N, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(seq) - 1), lambda j: F.struct(
        F.element_at(seq, j + 1).alias("w"),
        F.transform(F.sequence(F.lit(1), F.least(F.lit(order), j + 1)), lambda m: F.array_join(F.slice(seq, j - m + 2, m - 1), " ")).alias("hs")))


def perplexity(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``10 ** (-sum(log10 p) / n)`` over scored words incl. ``</s>`` and unknowns.

    Words of probability 0 (NULL ``log10p``) are left out of both sums and counted in ``n_zero``.
    """
    by = by or []
    lp = F.col("log10p")
    return scores.groupBy(*by).agg(
        F.pow(F.lit(10.0), -F.sum(lp) / F.count(lp)).alias("ppl"),
        F.count(lp).alias("n_words"), F.count(F.when(lp.isNull(), 1)).alias("n_zero"),
        F.sum(F.col("oov").cast("int")).alias("n_oov"))


def sentence_perplexity(lines: DataFrame, lm: LM, key: str = "sent_id", text_col: str = "text") -> DataFrame:
    """(key, ppl, n_words, n_zero, n_oov) per sentence."""
    return perplexity(score(lines, lm, key, text_col), by=[key])


# ------------------------------------------------------------------------------------------------
# Pruning (L7)
# ------------------------------------------------------------------------------------------------

def backoff_prob(keys: DataFrame, lm: LM, hist_cols: list[str], w_col: str = "w",
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Attach ``p`` = p(w | h) by the backoff cascade, as plain left joins and one column expression.

    ``hist_cols[m-1]`` holds the order-m history (``''`` for order 1, NULL where the sentence is too
    short for that order).  With p_m / g_m the seen-n-gram probability / history weight at order m
    (NULL when unseen) and 1/|V| below order 1::

        p = coalesce(p_N, coalesce(g_N, 1) * coalesce(p_{N-1}, ... coalesce(p_1, g_1 * 1/|V|)))

    No explode, grouping or lambda: each order is one equi-join on (history, word) or history.
    ``by`` names model-key columns present in ``keys`` and in all model tables (several models at once).
    """
    by = list(by)
    if by and set(by) <= set(lm.vocab.columns):
        nv = lm.vocab.groupBy(*by).agg(F.count(F.lit(1)).alias("_nv"))
        out = keys.join(nv, by, "left").withColumn("_p0", F.lit(1.0) / F.col("_nv")).drop("_nv")
    else:
        out = keys.withColumn("_p0", F.lit(1.0) / lm.vocab_size())
    for m in range(1, lm.order + 1):
        pm = lm.probs.where(F.col("ord") == m).select(*by, F.col("h").alias(f"_ph{m}"), F.col("w").alias(f"_pw{m}"),
                                                      F.col("p").alias(f"_p{m}"))
        if m == 1:
            # order 1 has the single empty history: join on the word, take its weight per model
            p1 = pm.drop("_ph1").withColumnRenamed("_pw1", w_col)
            out = out.join(p1, [*by, w_col], "left").withColumn("_ph1", F.lit("")).withColumn("_gh1", F.lit(""))
            g1 = lm.gammas.where(F.col("ord") == 1)
            if by:
                out = out.join(g1.groupBy(*by).agg(F.max("g").alias("_g1")), by, "left")
            else:
                out = out.withColumn("_g1", g1.select(F.max("g")).scalar())
            continue
        gm = lm.gammas.where(F.col("ord") == m).select(*by, F.col("h").alias(f"_gh{m}"), F.col("g").alias(f"_g{m}"))
        pm = pm.select(*[F.col(b).alias(f"_pb{m}_{b}") for b in by], f"_ph{m}", f"_pw{m}", f"_p{m}")
        gm = gm.select(*[F.col(b).alias(f"_gb{m}_{b}") for b in by], f"_gh{m}", f"_g{m}")
        cond_p = (F.col(hist_cols[m - 1]) == F.col(f"_ph{m}")) & (F.col(w_col) == F.col(f"_pw{m}"))
        cond_g = F.col(hist_cols[m - 1]) == F.col(f"_gh{m}")
        for b in by:
            cond_p = cond_p & (F.col(b) == F.col(f"_pb{m}_{b}"))
            cond_g = cond_g & (F.col(b) == F.col(f"_gb{m}_{b}"))
        out = out.join(pm, cond_p, "left").drop(*[f"_pb{m}_{b}" for b in by])
        out = out.join(gm, cond_g, "left").drop(*[f"_gb{m}_{b}" for b in by])
    p = F.col("_p0")
    nstar = F.lit(0)
    for m in range(1, lm.order + 1):
        seen_h = F.col(hist_cols[m - 1]).isNotNull()
        p = F.when(~seen_h, p).otherwise(F.coalesce(F.col(f"_p{m}"), F.coalesce(F.col(f"_g{m}"), F.lit(1.0)) * p))
        nstar = F.when(F.col(f"_p{m}").isNotNull(), F.lit(m)).otherwise(nstar)
    drop = [c for m in range(1, lm.order + 1) for c in (f"_ph{m}", f"_pw{m}", f"_p{m}", f"_gh{m}", f"_g{m}")]
    return out.withColumn("p", p).withColumn("ngram_len", nstar).drop(*drop, "_p0")


def lookup_prob(keys: DataFrame, lm: LM, by: tuple[str, ...] = ()) -> DataFrame:
    """p(w | h) under ``lm`` for distinct keys (h, w), ``h`` of up to order-1 words (C4 form of L6).

    Returns (by..., h, w, p).
    """
    k = keys.select(*by, "h", "w").distinct()
    k = k.withColumn("_words", F.when(F.col("h") == "", F.array().cast("array<string>")).otherwise(F.split("h", " ")))
    n = F.size("_words")
    hist = []
    for m in range(1, lm.order + 1):
        hm = F.lit("") if m == 1 else F.when(n >= m - 1, F.array_join(F.slice("_words", n - m + 2, m - 1), " "))
        k = k.withColumn(f"_h{m}", hm)
        hist.append(f"_h{m}")
    return backoff_prob(k, lm, hist, by=by).select(*by, "h", "w", "p")


def prune_lm(lm: LM, counts: DataFrame, method: str = "seymore", theta: float = 0.0) -> LM:
    """Drop n-grams of order ≥ 2 whose loss is below ``theta``, then renormalise.

    ``seymore``: loss = c(hw) · (ln p(w|h) − ln(g(h) · p(w|h'))) under the unpruned model;
    ``absolute``: loss = c(hw) (a count threshold).  Decisions go from the top order down, since an
    n-gram that is the history of a kept longer n-gram must stay.  Backoff weights of every
    history that lost n-grams are then recomputed from the bottom order up, against the already
    pruned lower orders, so each distribution sums to 1:
    g'(h) = (1 − Σ_kept p(w|h)) / (1 − Σ_kept p'(w|h')).
    """
    order = lm.order
    if method not in ("seymore", "absolute"):
        raise ValueError(f"unknown prune method {method!r}")
    probs, gammas = checkpoint(lm.probs), checkpoint(lm.gammas)
    kept_by_order = {1: probs.where(F.col("ord") == 1).select("ord", "h", "w", "p")}
    rescue = None
    # top down: the survivors of an order are stored before the next order asks for their histories
    for n in range(order, 1, -1):
        cur = probs.where(F.col("ord") == n).join(counts.where(F.col("ord") == n).select("h", "w", "c"), ["h", "w"])
        if method == "seymore":
            lo = probs.where(F.col("ord") == n - 1).select(F.col("h").alias("_lh"), F.col("w").alias("_lw"), F.col("p").alias("p_lower"))
            cur = cur.withColumn("_lh", lower_history(F.col("h"))).withColumn("_lw", F.col("w")).join(lo, ["_lh", "_lw"], "left")
            cur = cur.join(gammas.where(F.col("ord") == n).select("h", "g"), "h", "left")
            loss = F.col("c") * (F.log(F.col("p")) - F.log(F.col("g") * F.col("p_lower")))
        else:
            loss = F.col("c").cast("double")
        drop = F.coalesce(loss, F.lit(float("inf"))) < F.lit(theta)
        if rescue is not None:
            cur = cur.join(rescue, (cur["h"] == rescue["_rh"]) & (cur["w"] == rescue["_rw"]), "left")
            drop = drop & F.col("_rh").isNull()
        kept_by_order[n] = checkpoint(cur.where(~drop).select("ord", "h", "w", "p"))
        # histories of kept order-n n-grams, split into (h, w) of order n-1
        hist = kept_by_order[n].select(F.col("h").alias("_full")).distinct()
        hw = F.split("_full", " ")
        rescue = hist.select(F.array_join(F.slice(hw, 1, F.size(hw) - 1), " ").alias("_rh"), F.element_at(hw, -1).alias("_rw"))
    # bottom up: each order's new weights are stored, so the next order's look-ups read tables, not plans
    out_p, out_g = kept_by_order[1], gammas.where(F.col("ord") == 1).select("ord", "h", "g")
    for n in range(2, order + 1):
        kept = kept_by_order[n]
        p_low = lookup_prob(kept.select(lower_history(F.col("h")).alias("h"), "w"), LM(n - 1, lm.method, out_p, out_g, lm.vocab))
        p_low = p_low.select(F.col("h").alias("_lh"), F.col("w").alias("_lw"), F.col("p").alias("_pl"))
        kj = kept.join(p_low, (lower_history(kept["h"]) == p_low["_lh"]) & (kept["w"] == p_low["_lw"]), "left")
        sums = kj.groupBy("h").agg(F.sum("p").alias("_sp"), F.sum("_pl").alias("_sl"))
        g = (1 - F.coalesce(F.col("_sp"), F.lit(0.0))) / (1 - F.coalesce(F.col("_sl"), F.lit(0.0)))
        new_g = gammas.where(F.col("ord") == n).join(sums, "h", "left").select(F.lit(n).alias("ord"), "h", g.alias("g"))
        out_p, out_g = out_p.unionByName(kept), out_g.unionByName(checkpoint(new_g))
    return LM(order, lm.method, out_p, out_g, lm.vocab)
