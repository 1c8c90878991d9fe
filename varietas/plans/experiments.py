"""Learning curves over nested training prefixes, computed in one pass (X1, X2, W10, W11, W14; C1).

The reference retrains a model for every prefix (100 files, 100 trainings).  Here every training
line is tagged once with the first prefix that contains it; per-prefix statistics are then
cumulative sums over the prefix index:

* counts c_i(hw) and history totals c_i(h) accumulate the per-prefix increments;
* continuation types T_i(h) accumulate *first appearances* (an (h, w) pair counts from the first
  prefix in which it occurs);
* only statistics of histories and n-grams that the dev set asks for are kept (``left_semi``),
  so the prefix grid is (dev keys × prefixes), not (model × prefixes).

A vocabulary fixed over the whole run (``vocab='fixed'``) keeps the uniform floor 1/|V| constant,
so the points of the curve are comparable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators import vocab as Vo
from varietas.operators.ngrams import BOS as BOS_
from varietas.operators.ngrams import EOS, UNK, ngram_events
from varietas.operators.rows import first_prefix, row_count
from varietas.session import checkpoint, store

# Fixed value: counted rows of what the dev set asks for up to which they are broadcast; a plain join beyond.
ASKED_ROWS = 200_000


def _cumulate(keys: DataFrame, deltas: DataFrame, key_cols: list[str], val: str, first_i: int, max_i) -> DataFrame:
    """(keys..., i, val): running sum over prefixes first_i..max_i of increments ``deltas(keys, p, val)``.

    Increments tagged below ``first_i`` (lines present in every prefix) are folded into first_i.
    """
    max_c = max_i if not isinstance(max_i, int) else F.lit(max_i)
    grid = keys.select(*key_cols, F.explode(F.sequence(F.lit(first_i), max_c)).alias("i"))
    d = deltas.withColumn("i", F.greatest(F.col("p"), F.lit(first_i))).groupBy(*key_cols, "i").agg(F.sum(val).alias(val))
    j = grid.join(d, [*key_cols, "i"], "left")
    w = Window.partitionBy(*key_cols).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*key_cols, "i", F.sum(F.coalesce(F.col(val), F.lit(0))).over(w).alias(val))


def curve_from_tagged(tagged: DataFrame, dev: DataFrame, first_i: int, max_i, order: int = 3, k: float = 1.0,
                      text_col: str = "text", dev_key: str = "sent_id") -> DataFrame:
    """Dev perplexity of the Witten–Bell model of {lines with p <= i} for every i in first_i..max_i.

    ``tagged`` (p, text): each training line with the first prefix containing it.  Returns (i, ppl, n_words).
    """
    # words first: the vocabulary decides what the dev set asks for
    uni = checkpoint(ngram_events(tagged, 1, text_col, keep=["p"]).groupBy("ord", "h", "w", "p").agg(F.count(F.lit(1)).alias("c")))
    vocab = uni.select("w").unionByName(tagged.sparkSession.createDataFrame([(EOS,), (UNK,)], "w string")).distinct()
    shell = L.LM(order, "witten_bell", None, None, vocab)
    dev_ev = L.scoring_events(dev, shell, dev_key, text_col)
    keys = checkpoint(dev_ev.groupBy("hs", "w").agg(F.count(F.lit(1)).alias("mult")))
    kl = checkpoint(keys.select("hs", "w", F.posexplode("hs").alias("_o", "h")).withColumn("ord", F.col("_o") + 1).drop("_o"))
    ctx_keys = kl.select("ord", "h").distinct()
    ng_keys = kl.select("ord", "h", "w").distinct()
    # n-grams are counted per prefix before anything is grouped by history: a history that much of the corpus shares is a
    # row per word and prefix, and no join moves the words, which all share the empty history
    longer = ctx_keys.where(F.col("ord") > 1)
    ev = ngram_events(tagged, order, text_col, keep=["p"]).where(F.col("ord") > 1)
    few = kl.count() <= ASKED_ROWS
    if few:
        ev = ev.join(F.broadcast(longer), ["ord", "h"], "left_semi")         # the rest is never shuffled
    more = ev.groupBy("ord", "h", "w", "p").agg(F.count(F.lit(1)).alias("c"))
    if not few:
        more = more.join(longer, ["ord", "h"], "left_semi")
    raw = checkpoint(uni.unionByName(more))
    d_ch = raw.groupBy("ord", "h", "p").agg(F.sum("c").alias("c_h"))
    first = raw.groupBy("ord", "h", "w").agg(F.min("p").alias("p"))
    d_th = first.groupBy("ord", "h", "p").agg(F.count(F.lit(1)).alias("t_h"))
    d_c = raw.join(ng_keys, ["ord", "h", "w"], "left_semi")
    ctx = _cumulate(ctx_keys, d_ch, ["ord", "h"], "c_h", first_i, max_i) \
        .join(_cumulate(ctx_keys, d_th, ["ord", "h"], "t_h", first_i, max_i), ["ord", "h", "i"])
    ng = _cumulate(ng_keys, d_c, ["ord", "h", "w"], "c", first_i, max_i)
    per = kl.join(ctx, ["ord", "h"]).join(ng, ["ord", "h", "w", "i"])
    wide = per.groupBy("hs", "w", "i").agg(
        *[F.max(F.when(F.col("ord") == m, F.struct("c", "c_h", "t_h"))).alias(f"o{m}") for m in range(1, order + 1)])
    wide = wide.withColumn("_p0", F.lit(1.0) / vocab.select(F.count(F.lit(1))).scalar())
    p = F.col("_p0")
    for m in range(1, order + 1):
        o = F.col(f"o{m}")
        mixed = (o["c"] + F.lit(k) * o["t_h"] * p) / (o["c_h"] + F.lit(k) * o["t_h"])
        p = F.when(o.isNull() | (o["c_h"] == 0), p).otherwise(mixed)
    scored = wide.select("hs", "w", "i", F.log10(p).alias("lp")).join(keys, ["hs", "w"])
    return scored.groupBy("i").agg(
        F.pow(F.lit(10.0), -F.sum(F.col("lp") * F.col("mult")) / F.sum("mult")).alias("ppl"),
        F.sum("mult").alias("n_words"))


def ppl_curve(train: DataFrame, dev: DataFrame, np_: int = 100, max_p: int = 100, order: int = 3,
              k: float = 1.0, rn_col: str = "sent_id", text_col: str = "text", dev_key: str = "sent_id",
              method: str = "witten_bell") -> DataFrame:
    """Dev perplexity of models trained on prefixes 1..max_p of ``np_`` (one pass).

    Prefix i holds the first ``int(n*i/np_)`` training lines (by ``rn_col``).  ``method`` is
    ``witten_bell`` or ``kneser_ney`` (interpolated, modified, with discount fallback — the
    experiments' trainer).  Returns (i, ppl, n_words).
    """
    max_i = min(max_p, np_)
    tagged = train.withColumn("p", first_prefix(F.col(rn_col), row_count(train), np_)).where(F.col("p") <= max_i)
    if method == "kneser_ney":
        return kn_curve_from_tagged(tagged.select("p", text_col), dev, 1, max_i, order, text_col, dev_key)
    if method != "witten_bell":
        raise ValueError(f"unsupported curve method {method!r}")
    return curve_from_tagged(tagged.select("p", text_col), dev, 1, max_i, order, k, text_col, dev_key)


def cumulative_paraphrase_curve(base: DataFrame, candidates: DataFrame, dev: DataFrame, seed: int | str = 0,
                                order: int = 3, k: float = 1.0, text_col: str = "text",
                                dev_key: str = "sent_id", method: str = "witten_bell") -> DataFrame:
    """Distinct candidates (right-stripped of spaces, U2) in a seeded shuffle (W15) are added to
    the base corpus one at a time; returns (i, ppl, n_words) for i = 0 (base only) .. #candidates.

    Base lines enter at step 0, the candidate of shuffled rank j at step j.  No (dev key x step) table is built:
    see :mod:`varietas.operators.states`.
    """
    from varietas.operators import states as ST
    from varietas.operators.rows import with_row_index
    cand = (candidates.select(F.regexp_replace(F.col(text_col), " +$", "").alias("_line"))
            .where(F.length("_line") > 0).distinct())
    cand = cand.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_line"))))
    ranked = with_row_index(cand, ["_h", "_line"], "t")
    last = ranked.count()
    tagged = base.select(F.lit(0).cast("long").alias("t"), F.col(text_col).alias("text")) \
        .unionByName(ranked.select(F.col("t").cast("long").alias("t"), F.col("_line").alias("text")))
    m = _state_method(method, order, k)
    vocab, word, history, cc = ST.curve_moves(tagged, m, order, "text")
    keys, grams = ST.dev_keys(dev, order, vocab, dev_key, text_col)
    glob = ST.dense_globals(0, last, word, history, m, vocab, cc, order)
    n = keys.select(F.sum("mult")).scalar()
    total = ST.cumulative_totals(keys, grams, word, history, glob, m, order, last)
    return total.select(F.col("t").alias("i"), F.pow(F.lit(10.0), -F.col("total") / n).alias("ppl"), n.alias("n_words"))


def _state_method(method: str, order: int, k: float):
    from varietas.operators import states as ST
    if method not in ("witten_bell", "kneser_ney"):
        raise ValueError(f"unsupported curve method {method!r}")
    return ST.witten_bell(order, k) if method == "witten_bell" else ST.kneser_ney(order)


def oov_curve(chunks: DataFrame, dev: DataFrame, generated: DataFrame | None = None, top_n: int | None = None,
              chunk_col: str = "chunk_id", text_col: str = "text", gen_rn: str = "sent_id") -> DataFrame:
    """Training types and dev OOV tokens for cumulative chunk prefixes 0..top_n-1 (one pass).

    ``chunks`` (chunk_id, text): training lines in chunks (S6, W14).  With ``generated`` (gen_rn,
    text) the prefix i is augmented with the first (i+1)·len(chunk i) generated lines (W10, U1).
    Returns (i, types, oovs).

    A token type is in prefix i from its first chunk fc on, and before that while its first generated line
    g is in (m_i >= g; m_i may fall at a short last chunk).  Each type yields +1/-1 events where it comes in or
    goes (:func:`varietas.operators.signed.generated_stays`), found by equi-joins on the line number; both
    counts are running sums of events over the prefixes.
    """
    from varietas.operators.rows import running_totals
    from varietas.operators.signed import generated_stays
    ch = chunks
    if top_n is not None:
        ch = ch.where(F.col(chunk_col) < F.lit(top_n))
    ch = ch.select(F.col(chunk_col).cast("long").alias("chunk_id"), F.col(text_col).alias("text"))
    types = Vo.tokens_of(ch, "text", keys=["chunk_id"]).groupBy("tok").agg(F.min("chunk_id").alias("fc"))
    dev_t = Vo.tokens_of(dev, text_col).groupBy("tok").agg(F.count(F.lit(1)).alias("dn"))
    moves = F.array(F.struct(F.col("fc").alias("i"), F.lit(1).alias("d")))
    if generated is not None:
        gen_t = Vo.tokens_of(generated, text_col, keys=[gen_rn]).groupBy("tok").agg(F.min(gen_rn).alias("g"))
        inside = gen_t.join(generated_stays(ch), "g").groupBy("tok").agg(F.collect_list(F.struct("start", "stop")).alias("_in"))
        types = types.join(inside, "tok", "full")
        # a stay counts until the type's own chunk takes over
        early = F.filter(F.coalesce("_in", F.array().cast("array<struct<start:bigint,stop:bigint>>")),
                         lambda x: F.col("fc").isNull() | (x["start"] < F.col("fc")))
        stays = F.flatten(F.transform(early, lambda x: F.array(
            F.struct(x["start"].alias("i"), F.lit(1).alias("d")), F.struct(F.least(x["stop"], F.col("fc")).alias("i"), F.lit(-1).alias("d")))))
        moves = F.concat(moves, stays)
    events = types.join(dev_t, "tok", "left").select(F.coalesce("dn", F.lit(0)).alias("dn"), F.inline(moves)).where(F.col("i").isNotNull())
    prefixes = ch.select(F.col("chunk_id").alias("i")).distinct().withColumn("dn", F.lit(0).cast("long")).withColumn("d", F.lit(0))
    steps = events.unionByName(prefixes).groupBy("i").agg(F.sum("d").alias("types"), F.sum(F.col("d") * F.col("dn")).alias("inv"))
    total_dev = dev_t.select(F.coalesce(F.sum("dn"), F.lit(0))).scalar()
    out = running_totals(steps, "i", ["types", "inv"])
    return out.select("i", "types", (total_dev - F.col("inv")).alias("oovs"))


def evaluate_models(model_counts: DataFrame, dev: DataFrame, order: int = 3, k: float = 1.0,
                    id_col: str = "model_id", text_col: str = "text", dev_key: str = "sent_id", method: str = "witten_bell") -> DataFrame:
    """Dev perplexity of the model of every id, from counts ``(model_id, ord, h, w, c)``.

    All models are smoothed in one job, keyed by id, with the vocabulary of all of them (fixed V, as in
    :func:`ppl_curve`).  Stored models are evaluated by :func:`varietas.operators.lm.score_models` on
    :func:`varietas.sources.models.load_models`.  Returns (model_id, ppl, n_words).
    """
    models = L.build_lm(model_counts, order, method, k=k, discount_fallback=True, vocab=L.vocabulary(model_counts), by=(id_col,))
    return L.score_models(models, dev, id_col, dev_key, text_col)


def effective_paraphrases(base: DataFrame, candidates: DataFrame, dev: DataFrame, baseline: float | None = None,
                          order: int = 3, k: float = 1.0, text_col: str = "text", cand_key: str = "cand_id",
                          dev_key: str = "sent_id", method: str = "witten_bell") -> DataFrame:
    """Dev perplexity of (base + one candidate) for every candidate, and whether it beats
    ``baseline`` (default: the base model's own dev perplexity).  Returns (cand_id, ppl, effective).

    No model is trained per candidate and no (candidate x dev key) table is built.  A candidate changes the
    totals of the empty history and of ``<s>`` and, for ``kneser_ney``, the count-of-counts and so the discounts, for every dev
    key alike: its row of globals.  Its n-grams and histories are joined to the distinct ones the dev set asks for; the keys
    that use them are found inside the blocks (:func:`varietas.operators.states.candidate_totals`).  The vocabulary is that of base and all candidates.
    """
    from varietas.operators import states as ST
    from varietas.operators.rows import with_row_index
    m = _state_method(method, order, k)
    numbered = with_row_index(candidates.select(cand_key, F.col(text_col).alias("text")), [cand_key], "t")
    last = numbered.count()
    vocab, word, history, cc = ST.candidate_moves(base.select(F.col(text_col).alias("text")), numbered.select("t", "text"), m, order, "text")
    keys, grams = ST.dev_keys(dev, order, vocab, dev_key, text_col)
    glob = ST.dense_globals(0, last, word, history, m, vocab, cc, order, cumulative=False)
    n = keys.select(F.sum("mult")).scalar()
    total = ST.candidate_totals(keys, grams, word, history, glob, m, order, last)
    ppl = checkpoint(total.select("t", F.pow(F.lit(10.0), -F.col("total") / n).alias("ppl")))
    base_ppl = F.lit(float(baseline)) if baseline is not None else ppl.where("t = 0").select("ppl").scalar()
    return numbered.join(ppl, "t").select(cand_key, "ppl", (F.col("ppl") < base_ppl).alias("effective"))


def effective_summary(effective: DataFrame) -> DataFrame:
    """One row (processed, effective)."""
    return effective.agg(F.count(F.lit(1)).alias("processed"), F.count(F.when(F.col("effective"), 1)).alias("effective"))


def awer_curve(chunks: DataFrame, dev: DataFrame, unigram_table: DataFrame, seed: int = 0,
               generated: DataFrame | None = None, order: int = 3, rare_n: int = 1, top_n: int | None = None,
               rn_col: str = "sent_id", text_col: str = "text", dev_key: str = "sent_id") -> DataFrame:
    """AWER of the dev lines under the LM of every cumulative chunk prefix i (chunks 0..i), i < ``top_n``.

    Each prefix model is built as the evaluation scripts build it — tokens seen at most ``rare_n``
    times *in that prefix* become ``<unk>``, then Witten–Bell of order ``order``.  All prefix models come
    from one table of signed n-gram events (:mod:`varietas.operators.signed`): no training line is copied per
    prefix, and lattices meet the events in blocks of prefixes (:mod:`varietas.operators.prefix_decode`).  With ``generated`` (rn_col, text) prefix i also holds the first (i+1)·len(chunk i) generated lines.
    The unigram table (for the draws) is fixed, as in the reference.  Returns (i, awer, n_lines).
    """
    from varietas.operators import sampling as SMP
    from varietas.operators import signed
    from varietas.operators.prefix_decode import error_sums
    from varietas.plans import paraphrase as P
    if top_n is not None:
        chunks = chunks.where(F.col("chunk_id") < F.lit(top_n))
    last = chunks.agg(F.max("chunk_id")).first()[0]
    if last is None:
        return dev.sparkSession.createDataFrame([], "i long, awer double, n_lines long")
    models = signed.prefix_models(signed.stays(chunks, generated, rn_col, text_col), order, last, rare_n)
    # lattices: the words a slot ever holds; the draw does not depend on the model
    toks = P.sentence_tokens(dev, dev_key, text_col)
    draws = SMP.draw_words(toks.withColumn("k", SMP.draw60(seed, F.col(dev_key), F.col("pos"))), SMP.cdf(unigram_table))
    known = store(models.known(models.known(draws, "word"), "alt").select(dev_key, "pos", "word", "alt", "word_flips", "alt_flips"))
    rates = error_sums(known, dev.groupBy(dev_key).agg(F.count(F.lit(1)).alias("mult")), models, dev_key)
    n = row_count(dev)
    grid = dev.sparkSession.range(0, last + 1).select(F.col("id").alias("i"), n.alias("n_lines")).where("n_lines > 0")
    return grid.join(rates, "i", "left").select("i", (F.coalesce("rate", F.lit(0.0)) / F.col("n_lines")).alias("awer"), "n_lines")


def _thresholds(deltas: DataFrame, key_cols: list[str], val: str, upto: int) -> DataFrame:
    """(keys..., r1..r_upto): first prefix at which the running sum of ``val`` reaches 1, 2, ..."""
    w = Window.partitionBy(*key_cols).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    run = deltas.withColumn("_cum", F.sum(val).over(w))
    return run.groupBy(*key_cols).agg(*[F.min(F.when(F.col("_cum") >= j, F.col("p"))).alias(f"r{j}")
                                        for j in range(1, upto + 1)])


def kn_curve_from_tagged(tagged: DataFrame, dev: DataFrame, first_i: int, max_i, order: int = 3,
                         text_col: str = "text", dev_key: str = "sent_id") -> DataFrame:
    """Dev perplexity of interpolated modified Kneser–Ney models (discount fallback) of
    {lines with p <= i}, for every i in first_i..max_i, in one pass.

    Modified counts grow with i: at the top order (and for histories opening with ``<s>``) they are
    raw counts; below, the number of distinct left neighbours — a neighbour counts from the first
    prefix where its longer n-gram occurs.  Each n-gram's count trajectory is summarised by the
    prefixes r_j at which it reaches 1, 2, 3, 4, 5; count-of-counts (for the discounts) and the
    per-history numbers of types seen once / twice / 3+ times follow from those thresholds.
    """
    from varietas.operators.ngrams import lower_history
    spark = tagged.sparkSession
    ev = ngram_events(tagged, order, text_col, keep=["p"]).withColumn(
        "p", F.greatest(F.col("p"), F.lit(first_i)))
    vocab = (ev.where(F.col("ord") == 1).select("w")
             .unionByName(spark.createDataFrame([(EOS,), (UNK,)], "w string")).distinct())
    raw = ev.groupBy("ord", "h", "w", "p").agg(F.count(F.lit(1)).alias("d"))
    first = ev.groupBy("ord", "h", "w").agg(F.min("p").alias("p"))
    # continuation increments of order n from first appearances of order n+1
    cont = (first.where(F.col("ord") >= 2)
            .select((F.col("ord") - 1).alias("ord"), lower_history(F.col("h")).alias("h"), "w", "p")
            .groupBy("ord", "h", "w", "p").agg(F.count(F.lit(1)).alias("d")))
    bos = (F.col("h") == BOS_) | F.col("h").startswith(BOS_ + " ")
    top_or_bos = raw.where((F.col("ord") == order) | bos)
    lower = cont.where((F.col("ord") < order) & ~bos)
    da = top_or_bos.unionByName(lower)                      # (ord, h, w, p, d): increments of a
    thr = _thresholds(da, ["ord", "h", "w"], "d", 5)
    # count-of-counts per (order, prefix): n_j(i) = #{r_j <= i} - #{r_{j+1} <= i}
    steps = thr.select("ord", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"r{j}").alias("p"))
                                                 for j in range(1, 6)])).alias("s")).select("ord", "s.j", "s.p")
    steps = steps.where(F.col("p").isNotNull()).groupBy("ord", "j", "p").agg(F.count(F.lit(1)).alias("d"))
    ords = spark.range(1, order + 1).select(F.col("id").cast("int").alias("ord"))
    js = ords.select("ord", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j"))
    reach = _cumulate(js, steps, ["ord", "j"], "d", first_i, max_i)          # #{r_j <= i}
    wide = reach.groupBy("ord", "i").agg(*[F.max(F.when(F.col("j") == j, F.col("d"))).alias(f"m{j}")
                                           for j in range(1, 6)])
    n = [None] + [F.col(f"m{j}") - F.col(f"m{j + 1}") for j in range(1, 5)]
    y = L._div(n[1], n[1] + 2 * n[2])
    d1 = 1 - 2 * y * L._div(n[2], n[1])
    d2 = 2 - 3 * y * L._div(n[3], n[2])
    d3 = 3 - 4 * y * L._div(n[4], n[3])

    def ok(d, j):
        return d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d <= j)
    good = ok(d1, 1) & ok(d2, 2) & ok(d3, 3)
    disc = wide.select("ord", "i", *[F.when(good, d).otherwise(F.lit(fb)).alias(f"d{j}")
                                     for j, (d, fb) in enumerate(zip((d1, d2, d3), L.KN_FALLBACK), start=1)])
    # dev keys
    shell = L.LM(order, "kneser_ney", None, None, vocab)
    keys = L.scoring_events(dev, shell, dev_key, text_col).groupBy("hs", "w").agg(F.count(F.lit(1)).alias("mult"))
    kl = keys.select("hs", "w", F.posexplode("hs").alias("_o", "h")).withColumn("ord", F.col("_o") + 1).drop("_o")
    ctx_keys = kl.select("ord", "h").distinct()
    ng_keys = kl.select("ord", "h", "w").distinct()
    # per history: sum of a, and types with a = 1, 2, 3+
    dah = da.join(ctx_keys, ["ord", "h"], "left_semi")
    sum_a = _cumulate(ctx_keys, dah.groupBy("ord", "h", "p").agg(F.sum("d").alias("sa")), ["ord", "h"], "sa",
                      first_i, max_i)
    th = thr.join(ctx_keys, ["ord", "h"], "left_semi")
    nts = []
    for j in (1, 2, 3):
        dj = th.where(F.col(f"r{j}").isNotNull()).groupBy("ord", "h", F.col(f"r{j}").alias("p")) \
            .agg(F.count(F.lit(1)).alias(f"k{j}"))
        nts.append(_cumulate(ctx_keys, dj, ["ord", "h"], f"k{j}", first_i, max_i))
    ctx = sum_a.join(nts[0], ["ord", "h", "i"]).join(nts[1], ["ord", "h", "i"]).join(nts[2], ["ord", "h", "i"]) \
        .select("ord", "h", "i", "sa", (F.col("k1") - F.col("k2")).alias("N1"),
                (F.col("k2") - F.col("k3")).alias("N2"), F.col("k3").alias("N3"))
    a_k = _cumulate(ng_keys, da.join(ng_keys, ["ord", "h", "w"], "left_semi").select("ord", "h", "w", "p", F.col("d").alias("a")),
                    ["ord", "h", "w"], "a", first_i, max_i)
    per = kl.join(ctx, ["ord", "h"]).join(a_k, ["ord", "h", "w", "i"]).join(F.broadcast(disc), ["ord", "i"])
    wide_k = per.groupBy("hs", "w", "i").agg(
        *[F.max(F.when(F.col("ord") == m, F.struct("a", "sa", "N1", "N2", "N3", "d1", "d2", "d3"))).alias(f"o{m}")
          for m in range(1, order + 1)])
    wide_k = wide_k.withColumn("_p0", F.lit(1.0) / vocab.select(F.count(F.lit(1))).scalar())
    p = F.col("_p0")
    for m in range(1, order + 1):
        o = F.col(f"o{m}")
        a = o["a"].cast("double")
        dj = F.when(a == 1, o["d1"]).when(a == 2, o["d2"]).otherwise(o["d3"])
        gam = (o["d1"] * o["N1"] + o["d2"] * o["N2"] + o["d3"] * o["N3"]) / o["sa"]
        mixed = F.greatest(a - dj, F.lit(0.0)) / o["sa"] + gam * p
        p = F.when(o.isNull() | (o["sa"] == 0), p).otherwise(mixed)
    scored = wide_k.select("hs", "w", "i", F.log10(p).alias("lp")).join(keys, ["hs", "w"])
    return scored.groupBy("i").agg(
        F.pow(F.lit(10.0), -F.sum(F.col("lp") * F.col("mult")) / F.sum("mult")).alias("ppl"),
        F.sum("mult").alias("n_words"))
