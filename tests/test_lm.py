import math

import pytest
from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators import ngrams as G

CORPUS = ["a b c", "a b b", "b c a c", "c a"]


def _full_distribution(spark, model, hist):
    """p(w | hist) for every w in V, via the scoring cascade (one dev line per word)."""
    vocab = [r.w for r in model.vocab.collect()]
    rows = []
    for i, w in enumerate(vocab):
        if w == "</s>":
            rows.append((i, hist, True))
        else:
            rows.append((i, (hist + " " + w).strip(), False))
    return vocab, rows


@pytest.mark.parametrize("method", ["witten_bell", "absolute", "kneser_ney", "katz"])
def test_distributions_sum_to_one(spark, method):
    lines = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    counts = G.ngram_counts(lines, 3)
    model = L.build_lm(counts, 3, method, discount_fallback=True)
    probs = {(r.ord, r.h, r.w): r.p for r in model.probs.collect()}
    gam = {(r.ord, r.h): r.g for r in model.gammas.collect()}
    vocab = [r.w for r in model.vocab.collect()]
    nv = len(vocab)

    def p(w, hist):
        words = hist.split() if hist else []
        val = 1.0 / nv
        for n in range(1, 4):
            if n - 1 > len(words):
                break
            h = " ".join(words[len(words) - (n - 1):]) if n > 1 else ""
            if (n, h) not in gam:
                continue
            val = probs.get((n, h, w), gam[(n, h)] * val) if (n, h, w) in probs else gam[(n, h)] * val
        return val
    for hist in ["", "<s>", "a", "b", "<s> a", "a b", "b c", "c a"]:
        total = sum(p(w, hist) for w in vocab)
        assert math.isclose(total, 1.0, abs_tol=1e-9), (method, hist, total)


def test_witten_bell_by_hand(spark):
    # bigram WB on "a b" and "a": c(a)=2 c(b)=1 c(</s>)=2, V={a,b,</s>,<unk>}
    lines = spark.createDataFrame([("a b",), ("a",)], "text string")
    model = L.build_lm(G.ngram_counts(lines, 2), 2, "witten_bell")
    probs = {(r.ord, r.h, r.w): r.p for r in model.probs.collect()}
    # unigram: total 5, 3 types: p(a) = (2 + 3/4) / (5 + 3)
    assert math.isclose(probs[(1, "", "a")], (2 + 3 / 4) / 8)
    # p(b | a) = (1 + T(a) p(b)) / (c(a) + T(a)), T(a) = 2 (b, </s>)
    pb = (1 + 3 / 4) / 8
    assert math.isclose(probs[(2, "a", "b")], (1 + 2 * pb) / (2 + 2))


def test_perplexity_all_oov_line(spark):
    lines = spark.createDataFrame([("a b",), ("a",)], "text string")
    model = L.build_lm(G.ngram_counts(lines, 2), 2, "witten_bell")
    dev = spark.createDataFrame([(1, "zz yy")], "sent_id long, text string")
    sc = L.score(dev, model).collect()
    assert len(sc) == 3 and sum(r.oov for r in sc) == 2
    ppl = L.perplexity(L.score(dev, model)).first()
    assert ppl.n_words == 3 and ppl.ppl > 0


def test_unsmoothed_zero_probability_counted_apart(spark):
    lines = spark.createDataFrame([("a b",)], "text string")
    model = L.build_lm(G.ngram_counts(lines, 2), 2, "unsmoothed")
    dev = spark.createDataFrame([(1, "b a")], "sent_id long, text string")
    out = L.perplexity(L.score(dev, model)).first()
    assert out.n_zero >= 1


def test_shard_merge_round_trip(spark):
    lines = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    counts = G.ngram_counts(lines, 3)
    sh = G.shard_by_context(counts, ["b"])
    parts = [sh.where(F.col("shard") == s).drop("shard") for s in (0, 1)]
    merged = G.merge_counts(*parts)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, counts.collect()))


def test_prune_keeps_distributions_normalised(spark):
    lines = spark.createDataFrame([(t,) for t in CORPUS * 2 + ["a c b"]], "text string")
    counts = G.ngram_counts(lines, 3)
    model = L.build_lm(counts, 3, "witten_bell")
    pruned = L.prune_lm(model, counts, "absolute", theta=3)
    assert pruned.probs.count() < model.probs.count()
    probs = {(r.ord, r.h, r.w): r.p for r in pruned.probs.collect()}
    gam = {(r.ord, r.h): r.g for r in pruned.gammas.collect()}
    vocab = [r.w for r in pruned.vocab.collect()]
    full = {(r.ord, r.h, r.w): r.p for r in model.probs.collect()}

    def p(w, hist):
        words = hist.split() if hist else []
        val = 1.0 / len(vocab)
        for n in range(1, 4):
            if n - 1 > len(words):
                break
            h = " ".join(words[len(words) - (n - 1):]) if n > 1 else ""
            if (n, h) not in gam:
                continue
            val = probs[(n, h, w)] if (n, h, w) in probs else gam[(n, h)] * val
        return val
    for hist in ["a", "b", "a b", "b c"]:
        assert math.isclose(sum(p(w, hist) for w in vocab), 1.0, abs_tol=1e-9), hist
    assert len(full) > len(probs)
