import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators import ngrams as G
from varietas.operators import signed
from varietas.operators import vocab as V
from varietas.plans import experiments as X


def _corpus(seed, sizes, words="a b c d e f g h"):
    r = random.Random(seed)
    return [(c, sum(sizes[:c]) + i + 1, " ".join(r.choices(words.split(), [1 / (j + 1) for j in range(len(words.split()))], k=r.randint(1, 6))))
            for c, n in enumerate(sizes) for i in range(n)]


def _prefix_counts(lines, order, rare_n):
    freq = Counter(t for _, t in lines for t in t.split())
    out = Counter()
    for _, text in lines:
        seq = ["<s>"] + [w if freq[w] > rare_n else "<unk>" for w in text.split()] + ["</s>"]
        for j in range(1, len(seq)):
            for n in range(1, min(order, j + 1) + 1):
                out[(n, " ".join(seq[j - n + 1:j]), seq[j])] += 1
    return out


@pytest.mark.parametrize("sizes, generated", [([4, 4, 4, 2], False), ([3, 5, 1, 4, 2], True)])
def test_running_sums_of_signed_events_are_the_prefix_counts(spark, sizes, generated):
    rows, gen = _corpus(3, sizes), [(i + 1, t) for i, (_, _, t) in enumerate(_corpus(4, [25]))]
    chunks = spark.createDataFrame(rows, "chunk_id int, sent_id long, text string")
    g = spark.createDataFrame(gen, "sent_id long, text string") if generated else None
    lines = signed.stays(chunks, g)
    models = signed.prefix_models(lines, 3, len(sizes) - 1, rare_n=1)
    events = [tuple(r) for r in models.events.collect()]
    for i in range(len(sizes)):
        mine = [(n, t) for c, n, t in rows if c <= i] + ([(n, t) for n, t in gen if n <= (i + 1) * sizes[i]] if generated else [])
        got = Counter()
        for order, h, w, t, d in events:
            if t <= i:
                got[(order, h, w)] += d
        assert {k: v for k, v in got.items() if v} == dict(_prefix_counts(mine, 3, 1)), i


def test_prefix_models_equal_retrained_models(spark):
    sizes = [3, 5, 1, 4, 2]
    rows, gen = _corpus(5, sizes), [(i + 1, t) for i, (_, _, t) in enumerate(_corpus(6, [25]))]
    chunks = spark.createDataFrame(rows, "chunk_id int, sent_id long, text string")
    models = signed.prefix_models(signed.stays(chunks, spark.createDataFrame(gen, "sent_id long, text string")), 3, 4)
    keys = spark.createDataFrame([(i, h, w) for i in range(5) for h in ("<s>", "<s> a", "a b", "<unk> a", "zz b") for w in ("a", "b", "<unk>", "</s>", "h")],
                                 "i long, h string, w string")
    got = {(r.i, r.h, r.w): r.p for r in models.lookup(keys).collect()}
    for i in range(5):
        mine = [(n, t) for c, n, t in rows if c <= i] + [(n, t) for n, t in gen if n <= (i + 1) * sizes[i]]
        rare = V.replace_rare(spark.createDataFrame(mine, "sent_id long, text string").withColumn("sent_id", F.monotonically_increasing_id()), 1)
        lm = L.build_lm(G.ngram_counts(rare, 3), 3, "witten_bell")
        for r in lm.lookup(keys.where(F.col("i") == i).select("h", "w")).collect():
            assert abs(got[(i, r.h, r.w)] - r.p) < 1e-12, (i, r.h, r.w)


@pytest.mark.parametrize("generated, top_n", [(True, 3)])
def test_awer_curve_equals_awer_of_every_prefix(spark, generated, top_n):
    from varietas.plans.paraphrase import awer
    sizes = [4, 4, 4, 2]
    rows, gen = _corpus(7, sizes), [(i + 1, t) for i, (_, _, t) in enumerate(_corpus(8, [25]))]
    chunks = spark.createDataFrame(rows, "chunk_id int, sent_id long, text string")
    g = spark.createDataFrame(gen, "sent_id long, text string") if generated else None
    dev = spark.createDataFrame([(1, "a b c zz"), (2, "b a"), (3, ""), (4, "h g f a a b")], "sent_id long, text string")
    uni = V.unigrams(V.tokens_of(chunks.select("text")))
    got = {r.i: (r.awer, r.n_lines) for r in X.awer_curve(chunks, dev, uni, seed=2, generated=g, top_n=top_n).collect()}
    last = (top_n or len(sizes)) - 1
    assert sorted(got) == list(range(last + 1))
    for i in range(last + 1):
        mine = [(n, t) for c, n, t in rows if c <= i] + ([(n + 100, t) for n, t in gen if n <= (i + 1) * sizes[i]] if generated else [])
        rare = V.replace_rare(spark.createDataFrame(mine, "sent_id long, text string"), 1)
        want = awer(dev, uni, L.build_lm(G.ngram_counts(rare, 3), 3, "witten_bell", materialize=True), seed=2).first()
        assert abs(got[i][0] - want.awer) < 1e-12 and got[i][1] == want.n_lines, i


def test_awer_curve_asks_for_no_probability_per_prefix(spark, monkeypatch):
    from varietas.operators import prefix_decode as PD

    def dense(self, keys, by=()):
        raise AssertionError("a row per asked n-gram and prefix")
    monkeypatch.setattr(signed.PrefixModels, "lookup", dense)
    chunks = spark.createDataFrame(_corpus(12, [2] * 7), "chunk_id int, sent_id long, text string")
    long_line = " ".join(random.Random(13).choices("a b c d zz yy".split(), k=150))
    dev = spark.createDataFrame([(1, "a b c zz"), (2, long_line), (3, "")], "sent_id long, text string")
    uni = V.unigrams(V.tokens_of(chunks.select("text")))

    def curve():
        return {r.i: (r.awer, r.n_lines) for r in X.awer_curve(chunks, dev, uni, seed=4).collect()}
    whole = curve()
    monkeypatch.setattr(PD, "BLOCK", 3)
    monkeypatch.setattr(PD, "POSITIONS", 20)
    got = curve()
    assert sorted(got) == sorted(whole) == list(range(7))
    assert all(abs(got[i][0] - whole[i][0]) < 1e-12 and got[i][1] == 3 for i in whole) and len({w for w, _ in whole.values()}) > 1


@pytest.mark.parametrize("generated", [False, True])
def test_oov_curve_equals_counting_every_prefix(spark, generated):
    sizes = [3, 5, 1, 4, 2]
    words = " ".join(f"w{i}" for i in range(60))
    rows, gen = _corpus(9, sizes, words), [(i + 1, t) for i, (_, _, t) in enumerate(_corpus(10, [25], words))]
    chunks = spark.createDataFrame(rows, "chunk_id int, sent_id long, text string")
    dev = [t for _, _, t in _corpus(11, [12], words)]
    g = spark.createDataFrame(gen, "sent_id long, text string") if generated else None
    got = {r.i: (r.types, r.oovs) for r in X.oov_curve(chunks, spark.createDataFrame([(t,) for t in dev], "text string"), g).collect()}
    for i in range(len(sizes)):
        mine = [t for c, _, t in rows if c <= i] + ([t for n, t in gen if n <= (i + 1) * sizes[i]] if generated else [])
        types = {w for t in mine for w in t.split()}
        assert got[i] == (len(types), sum(w not in types for t in dev for w in t.split())), i
    assert sorted(got) == list(range(len(sizes)))
