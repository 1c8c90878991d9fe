import math

from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators import ngrams as G
from varietas.operators.ngrams import EOS, UNK
from varietas.plans import experiments as X

BASE = ["a b c", "b c d", "a a b"]
CANDS = ["c d a", "d d", "a b c", "e f a", "c d a "]
DEV = ["a b d", "f e", "c a"]


def _retrain_ppl(spark, lines, vocab_words, dev):
    counts = G.ngram_counts(spark.createDataFrame([(t,) for t in lines], "text string"), 3)
    vocab = spark.createDataFrame([(w,) for w in vocab_words], "w string")
    model = L.build_lm(counts, 3, "witten_bell", vocab=vocab)
    return L.perplexity(L.score(dev, model)).first().ppl


def test_cumulative_curve_equals_retraining(spark):
    base = spark.createDataFrame([(t,) for t in BASE], "text string")
    cands = spark.createDataFrame([(t,) for t in CANDS], "text string")
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(DEV)], "sent_id long, text string")
    curve = {r.i: r.ppl for r in X.cumulative_paraphrase_curve(base, cands, dev, seed=3).collect()}
    uniq = sorted({c.rstrip(" ") for c in CANDS})
    import hashlib
    order = sorted(uniq, key=lambda c: (hashlib.md5(f"3:{c}".encode()).hexdigest(), c))
    vocab = sorted({w for t in BASE + uniq for w in t.split()} | {EOS, UNK})
    assert sorted(curve) == list(range(len(order) + 1))
    for i in range(len(order) + 1):
        exp = _retrain_ppl(spark, BASE + order[:i], vocab, dev)
        assert math.isclose(curve[i], exp, rel_tol=1e-9), (i, curve[i], exp)


def test_evaluate_models_equals_single_models(spark):
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(DEV)], "sent_id long, text string")
    rows = []
    for mid, lines in enumerate([BASE, CANDS]):
        df = spark.createDataFrame([(t,) for t in lines], "text string")
        rows.append(G.ngram_counts(df, 3).withColumn("model_id", F.lit(mid)))
    counts = rows[0].unionByName(rows[1])
    got = {r.model_id: r.ppl for r in X.evaluate_models(counts, dev).collect()}
    vocab = sorted({w for t in BASE + CANDS for w in t.split()} | {EOS, UNK})
    for mid, lines in enumerate([BASE, CANDS]):
        assert math.isclose(got[mid], _retrain_ppl(spark, lines, vocab, dev), rel_tol=1e-9)


def test_oov_curve_properties(spark):
    chunks = spark.createDataFrame([(0, "a b"), (0, "c"), (1, "d a"), (2, "x")], "chunk_id int, text string")
    dev = spark.createDataFrame([("a d x y",)], "text string")
    out = {r.i: (r.types, r.oovs) for r in X.oov_curve(chunks, dev).collect()}
    assert out == {0: (3, 3), 1: (4, 2), 2: (5, 1)}
    train_as_dev = chunks.select("text")
    full = {r.i: r.oovs for r in X.oov_curve(chunks, train_as_dev).collect()}
    assert full[2] == 0 and full[0] >= full[1] >= full[2]


def test_effective_paraphrases_equals_retraining(spark):
    base = spark.createDataFrame([(t,) for t in BASE], "text string")
    cands = spark.createDataFrame([(i, t) for i, t in enumerate(CANDS + ["", "a", "b c d a b"])],
                                  "cand_id long, text string")
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(DEV + ["a b c", "d"])], "sent_id long, text string")
    got = {r.cand_id: (r.ppl, r.effective) for r in X.effective_paraphrases(base, cands, dev).collect()}
    all_c = CANDS + ["", "a", "b c d a b"]
    vocab = sorted({w for t in BASE + all_c for w in t.split()} | {EOS, UNK})
    base_ppl = _retrain_ppl(spark, BASE, vocab, dev)
    for i, c in enumerate(all_c):
        exp = _retrain_ppl(spark, BASE + [c], vocab, dev)
        assert math.isclose(got[i][0], exp, rel_tol=1e-9), (i, got[i][0], exp)
        assert got[i][1] == (exp < base_ppl)


def test_awer_curve_equals_per_prefix_awer(spark):
    from varietas.operators import vocab as V
    from varietas.plans.paraphrase import awer
    lines = ["a b c a", "b c d", "a a b", "c d e", "d e f b", "a c", "f f a", "b b c"]
    chunks = spark.createDataFrame([(i // 3, i + 1, t) for i, t in enumerate(lines)],
                                   "chunk_id long, sent_id long, text string")
    dev = spark.createDataFrame([(1, "a b c"), (2, "d e x"), (3, "")], "sent_id long, text string")
    uni = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("f", 1)], "word string, n long")
    got = {r.i: r.awer for r in X.awer_curve(chunks, dev, uni, seed=7).collect()}
    for i in range(3):
        pref = spark.createDataFrame([(j + 1, t) for j, t in enumerate(lines) if j // 3 <= i],
                                     "sent_id long, text string")
        rare = V.replace_rare(pref, 1)
        model = L.build_lm(G.ngram_counts(rare, 3), 3, "witten_bell")
        exp = awer(dev, uni, model, seed=7).first().awer
        assert math.isclose(got[i], exp, abs_tol=1e-12), (i, got[i], exp)


def test_kneser_ney_curve_equals_retraining(spark):
    lines = ["a b c a", "b c d", "a a b", "c d e", "d e f b", "a c", "f f a", "b b c", "a b c", "c a b"]
    tagged = spark.createDataFrame([(1 + j // 3, t) for j, t in enumerate(lines)], "p long, text string")
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "d e x", "f a b c"])],
                                "sent_id long, text string")
    got = {r.i: r.ppl for r in X.kn_curve_from_tagged(tagged, dev, 1, 4, 3).collect()}
    vocab = sorted({w for t in lines for w in t.split()} | {EOS, UNK})
    vdf = spark.createDataFrame([(w,) for w in vocab], "w string")
    for i in range(1, 5):
        pref = [t for j, t in enumerate(lines) if 1 + j // 3 <= i]
        counts = G.ngram_counts(spark.createDataFrame([(t,) for t in pref], "text string"), 3)
        model = L.build_lm(counts, 3, "kneser_ney", discount_fallback=True, vocab=vdf)
        exp = L.perplexity(L.score(dev, model)).first().ppl
        assert math.isclose(got[i], exp, rel_tol=1e-9), (i, got[i], exp)


def test_cumulative_curve_kneser_ney_equals_retraining(spark):
    base = spark.createDataFrame([(t,) for t in BASE], "text string")
    cands = spark.createDataFrame([(t,) for t in CANDS], "text string")
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(DEV)], "sent_id long, text string")
    curve = {r.i: r.ppl for r in X.cumulative_paraphrase_curve(base, cands, dev, seed=3, method="kneser_ney").collect()}
    import hashlib
    uniq = sorted({c.rstrip(" ") for c in CANDS})
    order = sorted(uniq, key=lambda c: (hashlib.md5(f"3:{c}".encode()).hexdigest(), c))
    vocab = spark.createDataFrame([(w,) for w in sorted({w for t in BASE + uniq for w in t.split()} | {EOS, UNK})],
                                  "w string")
    for i in range(len(order) + 1):
        lines = BASE + order[:i]
        counts = G.ngram_counts(spark.createDataFrame([(t,) for t in lines], "text string"), 3)
        model = L.build_lm(counts, 3, "kneser_ney", discount_fallback=True, vocab=vocab)
        exp = L.perplexity(L.score(dev, model)).first().ppl
        assert math.isclose(curve[i], exp, rel_tol=1e-9), (i, curve[i], exp)


def test_prefix_counts_are_taken_before_the_join_with_asked_histories(spark, monkeypatch):
    """Lines of one word: all events share the empty history, which no task may have to read event by event."""
    lines = spark.createDataFrame([(i, f"a{' b' * (i % 3)}") for i in range(1, 3001)], "sent_id long, text string").repartition(6)
    dev = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "a")], "sent_id long, text string")
    stored = []
    keep = X.checkpoint
    monkeypatch.setattr(X, "checkpoint", lambda df: stored.append(keep(df)) or stored[-1])
    got = {r.i: (round(r.ppl, 9), r.n_words) for r in X.ppl_curve(lines, dev, 10, 10, 3).collect()}
    counted = [d for d in stored if "p" in d.columns]
    assert counted and all(d.count() <= 10 * 20 for d in counted)        # a row per n-gram and prefix, not per event
    monkeypatch.setattr(X, "ASKED_ROWS", 0)                              # the plain join gives the same
    assert got == {r.i: (round(r.ppl, 9), r.n_words) for r in X.ppl_curve(lines, dev, 10, 10, 3).collect()}
    assert len(got) == 10 and {n for _, n in got.values()} == {8}


def test_candidates_meet_keys_in_blocks(spark, monkeypatch):
    """Many dev keys share a candidate's words: what is shuffled is a row per changed n-gram, not per (key, candidate)."""
    from varietas.operators import states as ST
    moved = []
    keep = ST.asked_moves
    monkeypatch.setattr(ST, "asked_moves", lambda *a: moved.append(keep(*a)) or moved[-1])
    for name, value in (("BLOCK", 3), ("KEYS", 7), ("PAIRS", 5)):
        monkeypatch.setattr(ST, name, value)
    base = spark.createDataFrame([(t,) for t in BASE], "text string")
    texts = CANDS + ["", "a", "b c d a b"]
    cands = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cand_id long, text string")
    lines = ["a b d", "f e", "c a", "d d a b c a e a d b a", "a"]
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "sent_id long, text string")
    vocab = sorted({w for t in BASE + texts for w in t.split()} | {EOS, UNK})
    got = {r.cand_id: r.ppl for r in X.effective_paraphrases(base, cands, dev).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i in (0, 3, 5, 7):
        assert math.isclose(got[i], _retrain_ppl(spark, BASE + [texts[i]], vocab, dev), rel_tol=1e-9)
    numbers, moves = moved[0]
    assert numbers.select("bucket").distinct().count() > 1
    assert moves.groupBy("t", "bucket", "id").count().where("count > 1").count() == 0


def test_candidates_whose_model_gives_probability_zero(spark):
    """A key of probability 0 in the base only, or with the candidate only, is no difference of infinities."""
    import numpy as np
    from varietas.operators import states as ST
    method = ST.Method(["cw"], ["ch", "th"], [], lambda s, g: np.log10(s["cw1"] + s["eos"] + 0.0 * g["p0"]))
    keys = spark.createDataFrame([("k", 2, 0, 0), ("n", 1, 0, 0)], "kid string, mult long, bos int, eos int")
    grams = spark.createDataFrame([("k", 1, "", "a"), ("n", 1, "", "b")], "kid string, ord int, h string, w string")
    word = spark.createDataFrame([(1, "", "a", 0, 10), (1, "", "b", 1, 10), (1, "", "a", 2, 90), (1, "", "b", 2, 1)], "ord int, h string, w string, t long, cw long")
    history = spark.createDataFrame([], "ord int, h string, t long, ch long, th long")
    glob = spark.range(4).select(F.col("id").alias("t"), F.lit(1.0).alias("p0"))
    got = {r.t: r.total for r in ST.candidate_totals(keys, grams, word, history, glob, method, 1, 3).collect()}
    assert got == {0: -math.inf, 1: 3.0, 2: 4.0, 3: -math.inf}


def test_cumulative_models_meet_keys_in_blocks(spark, monkeypatch):
    """Sums carried from block to block; what is shuffled is a row per changed n-gram, not per key and change."""
    from varietas.operators import states as ST
    base = spark.createDataFrame([(t,) for t in BASE], "text string")
    texts = [" ".join("abcd"[(i * j) % 4] for j in range(1, 2 + i % 4)) + f" x{i % 3}" for i in range(11)]
    cands = spark.createDataFrame([(t,) for t in texts], "text string")
    dev = spark.createDataFrame([(i, t) for i, t in enumerate(DEV + ["d d a b c a e a d b a", "x1 a"])], "sent_id long, text string")
    whole = {r.i: r.ppl for r in X.cumulative_paraphrase_curve(base, cands, dev, seed=3).collect()}
    for name, value in (("BLOCK", 3), ("KEYS", 7), ("STEP", 2)):
        monkeypatch.setattr(ST, name, value)
    got = {r.i: r.ppl for r in X.cumulative_paraphrase_curve(base, cands, dev, seed=3).collect()}
    assert sorted(got) == sorted(whole) == list(range(len(set(texts)) + 1))
    assert all(math.isclose(got[i], whole[i], rel_tol=1e-12) for i in got)
