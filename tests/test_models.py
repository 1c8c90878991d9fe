import glob
import math
import os
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators import ngrams as G
from varietas.operators.ngrams import EOS, UNK
from varietas.plans import experiments as X
from varietas.sources import files
from varietas.sources import models as M

A = ["a b c a", "b c d", "a a b", "c d e", "d e f b", "a c", "f f a", "b b c", "a b c", "c a b"]
B = ["x a y", "y y b", "a x x", "c y", "x a y b"]
DEV = ["a b d", "f e x", "c a", "x a y"]
METHODS = [("kneser_ney", {"discount_fallback": True}), ("katz", {}), ("absolute", {"bins": 3})]


def _lines(spark, lines):
    return spark.createDataFrame([(t,) for t in lines], "text string")


def _dev(spark):
    return spark.createDataFrame(list(enumerate(DEV)), "sent_id long, text string")


def _both(spark):
    counts = [G.ngram_counts(_lines(spark, x), 3).withColumn("model_id", F.lit(m)) for m, x in (("one", A), ("two", B))]
    return counts[0].unionByName(counts[1])


def _rows(df, *cols):
    return {tuple(r)[:-1]: r[-1] for r in df.select(*cols).collect()}


@pytest.mark.parametrize("method, kw", METHODS)
def test_models_built_together_equal_models_built_alone(spark, method, kw):
    keyed = L.build_lm(_both(spark), 3, method, by=("model_id",), **kw)
    for name, lines in (("one", A), ("two", B)):
        alone = L.build_lm(G.ngram_counts(_lines(spark, lines), 3), 3, method, **kw)
        for table, cols in (("probs", ("ord", "h", "w", "p")), ("gammas", ("ord", "h", "g"))):
            got = _rows(getattr(keyed, table).where(F.col("model_id") == name), *cols)
            want = _rows(getattr(alone, table), *cols)
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("method, kw", [*METHODS, ("witten_bell", {}), ("absolute", {}), ("unsmoothed", {})])
def test_weighted_rows_equal_the_join_of_the_tables(spark, method, kw):
    lm = L.build_lm(G.ngram_counts(_lines(spark, A + B), 3), 3, method, store_counts=True, **kw)
    joined = lm.probs.join(lm.gammas, ["ord", "h"]).select("ord", "h", "w", "p", "g")
    assert lm.gammas.count() == lm.probs.select("ord", "h").distinct().count()
    assert sorted(map(tuple, lm.weighted().collect())) == sorted(map(tuple, joined.collect())) == sorted(map(tuple, lm.materialize().weighted().collect()))
    # the stored counts are read by column, not row by row
    assert "FileScan parquet" in lm.probs._jdf.queryExecution().toString()


@pytest.mark.parametrize("method, kw", [("absolute", {"bins": 3}), ("absolute", {"bins": 2}), ("absolute", {})])
def test_absolute_discounts_sum_to_one(spark, method, kw):
    lm = L.build_lm(G.ngram_counts(_lines(spark, A * 2 + B), 3), 3, method, **kw)
    vocab = [r.w for r in lm.vocab.collect()]
    keys = spark.createDataFrame([(h, w) for h in ("", "a", "a b", "<s>", "zz") for w in vocab], "h string, w string")
    for r in lm.lookup(keys).groupBy("h").agg(F.sum("p").alias("p"), F.min("p").alias("least")).collect():
        assert math.isclose(r.p, 1.0, abs_tol=1e-9) and r.least > 0, r.h


def test_store_lists_reads_and_replaces_models(spark):
    root = tempfile.mkdtemp(prefix="models-", dir=os.environ.get("TMPDIR", "/tmp"))
    counts = _both(spark)
    M.save_counts(counts, root, 3)
    assert sorted(map(tuple, M.load_counts(spark, root, "two").collect())) == sorted(
        (o, h, w, float(c)) for o, h, w, c in G.ngram_counts(_lines(spark, B), 3).collect())
    M.save_models(L.build_lm(M.load_counts(spark, root), 3, "kneser_ney", discount_fallback=True, by=("model_id",)), root)
    M.save_models(L.build_lm(G.ngram_counts(_lines(spark, A), 3), 3, "witten_bell"), root, "three")
    assert sorted(map(tuple, M.list_models(spark, root, stage="lm").collect())) == [
        ("one", "lm", 3, "kneser_ney"), ("three", "lm", 3, "witten_bell"), ("two", "lm", 3, "kneser_ney")]
    assert [r.model_id for r in M.list_models(spark, root, "^t", "counts").collect()] == ["two"]
    alone = L.build_lm(G.ngram_counts(_lines(spark, A), 3), 3, "kneser_ney", discount_fallback=True)
    assert _rows(M.load_model(spark, root, "one").probs, "ord", "h", "w", "p") == pytest.approx(_rows(alone.probs, "ord", "h", "w", "p"))
    # writing one id again leaves the others
    M.save_models(L.build_lm(G.ngram_counts(_lines(spark, B), 3), 3, "kneser_ney", discount_fallback=True), root, "one")
    ppl = {r.model_id: r.ppl for r in L.score_models(M.load_models(spark, root, "^(one|two)$"), _dev(spark)).collect()}
    want = L.perplexity(L.score(_dev(spark), L.build_lm(G.ngram_counts(_lines(spark, B), 3), 3, "kneser_ney", discount_fallback=True))).first().ppl
    assert math.isclose(ppl["one"], want, rel_tol=1e-9) and math.isclose(ppl["two"], want, rel_tol=1e-9)
    with pytest.raises(ValueError):
        M.load_model(spark, root, "none")


def test_grouped_store_keeps_few_folders_and_replaces_ids(spark):
    root = tempfile.mkdtemp(prefix="models-", dir=os.environ.get("TMPDIR", "/tmp"))
    many = spark.createDataFrame([(str(i), 1, "", w, float(i + 1)) for i in range(100) for w in ("a", "</s>")], "model_id string, ord int, h string, w string, c double")
    M.save_counts(many, root, 1, grouped=True)
    M.save_counts(many.where("model_id = '7'").withColumn("c", F.lit(-1.0)).limit(1), root, 1, grouped=True)
    got = M.load_counts(spark, root, grouped=True)
    assert got.where("model_id <> '7'").count() == 198 and [r.c for r in got.where("model_id = '7'").collect()] == [-1.0]
    assert M.list_models(spark, root, stage="counts", grouped=True).count() == 100
    assert len(glob.glob(root + "/**/*.parquet", recursive=True)) <= 2 * M.GROUPS


def test_scores_of_many_models_are_those_of_each_alone(spark, monkeypatch):
    monkeypatch.setattr(L, "backoff_prob", lambda *a, **k: pytest.fail("a row per model and key"))
    counts = _both(spark)
    lm = L.build_lm(counts, 3, "witten_bell", vocab=L.vocabulary(counts), by=("model_id",))
    whole = {r.model_id: (r.ppl, r.n_words) for r in L.score_models(lm, _dev(spark)).collect()}
    monkeypatch.setattr(L, "MODELS", 1)
    monkeypatch.setattr(L, "KEYS", 3)
    got = {r.model_id: (r.ppl, r.n_words) for r in L.score_models(lm, _dev(spark)).collect()}
    monkeypatch.undo()
    for name, lines in (("one", A), ("two", B)):
        alone = L.build_lm(G.ngram_counts(_lines(spark, lines), 3), 3, "witten_bell", vocab=L.vocabulary(counts))
        want = L.perplexity(L.score(_dev(spark), alone)).first()
        for rows in (whole, got):
            assert math.isclose(rows[name][0], want.ppl, rel_tol=1e-9) and rows[name][1] == want.n_words


def test_candidate_moves_are_stored_by_column(spark):
    from varietas.operators import states as ST
    cands = spark.createDataFrame([(1, "a b"), (2, "c c c")], "t long, text string")
    word = ST.candidate_moves(_lines(spark, A), cands, ST.kneser_ney(3), 3, "text")[1]
    assert "FileScan parquet" in word._jdf.queryExecution().toString()
    assert {(r.h, r.w): r.aw for r in word.where("t = 2 and ord = 3").collect()} == {("<s> c", "c"): 1, ("c c", "c"): 1, ("c c", "</s>"): 1}


def test_reading_one_model_and_order_prunes_partitions(spark):
    root = tempfile.mkdtemp(prefix="models-", dir=os.environ.get("TMPDIR", "/tmp"))
    M.save_models(L.build_lm(_both(spark), 3, "witten_bell", by=("model_id",)), root)
    plan = M.load_model(spark, root, "one").probs.where("ord = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "(model_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and "(ord" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert glob.glob(root + "/probs/model_id=one/ord=2/*.parquet")


def test_effective_paraphrases_kneser_ney_equals_retraining(spark):
    cands = ["c d a", "", "b c d a b", "f e x"]
    vocab = spark.createDataFrame([(w,) for w in sorted({w for t in A + cands for w in t.split()} | {EOS, UNK})], "w string")

    def ppl(lines):
        lm = L.build_lm(G.ngram_counts(_lines(spark, lines), 3), 3, "kneser_ney", discount_fallback=True, vocab=vocab)
        return L.perplexity(L.score(_dev(spark), lm)).first().ppl
    base = ppl(A)
    df = spark.createDataFrame(list(enumerate(cands)), "cand_id long, text string")
    for r in X.effective_paraphrases(_lines(spark, A), df, _dev(spark), method="kneser_ney").collect():
        want = ppl(A + [cands[r.cand_id]])
        assert math.isclose(r.ppl, want, rel_tol=1e-9) and (r.effective == (want < base) or math.isclose(want, base, rel_tol=1e-9)), r.cand_id
    some = X.effective_paraphrases(_lines(spark, A), df, _dev(spark), baseline=1e9, method="kneser_ney")
    assert X.effective_summary(some).first() == (len(cands), len(cands))


def test_curves_over_many_blocks_equal_short_ones(spark, monkeypatch):
    from varietas.operators import states as ST
    base, cands = _lines(spark, A), _lines(spark, B + ["d d d", "e a", "f", "a b c d e f"])
    whole = {m: {r.i: r.ppl for r in X.cumulative_paraphrase_curve(base, cands, _dev(spark), seed=1, method=m).collect()} for m in ("witten_bell", "kneser_ney")}
    monkeypatch.setattr(ST, "BLOCK", 2)
    monkeypatch.setattr(ST, "STEP", 3)
    for m, want in whole.items():
        got = {r.i: r.ppl for r in X.cumulative_paraphrase_curve(base, cands, _dev(spark), seed=1, method=m).collect()}
        assert got.keys() == want.keys() == set(range(10)) and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)


@pytest.mark.parametrize("method, theta", [("seymore", 1.5), ("absolute", 2)])
def test_pruned_models_keep_prefixes_and_sum_to_one(spark, method, theta):
    counts = G.ngram_counts(_lines(spark, A * 2 + B), 3)
    lm = L.build_lm(counts, 3, "witten_bell")
    pruned = L.prune_lm(lm, counts, method, theta)
    kept = {(r.ord, r.h, r.w) for r in pruned.probs.collect()}
    assert 0 < len([k for k in kept if k[0] == 3]) < lm.probs.where("ord = 3").count()
    assert all((2, h.split(" ")[0], h.split(" ")[1]) in kept for o, h, _ in kept if o == 3)
    vocab = [r.w for r in pruned.vocab.collect()]
    keys = spark.createDataFrame([(h, w) for h in ("", "a", "a b", "<s>", "<s> a", "x a", "zz") for w in vocab], "h string, w string")
    for r in pruned.lookup(keys).groupBy("h").agg(F.sum("p").alias("p")).collect():
        assert math.isclose(r.p, 1.0, abs_tol=1e-9), r.h


def test_fractional_counts(spark):
    df = spark.createDataFrame([("a b", 0.25), ("a", 0.75), ("b", 0.0)], "text string, weight double")
    got = _rows(G.weighted_counts(df, "weight", 2), "ord", "h", "w", "c")
    assert got == {(1, "", "a"): 1.0, (1, "", "b"): 0.25, (1, "", "</s>"): 1.0, (2, "<s>", "a"): 1.0, (2, "a", "b"): 0.25, (2, "b", "</s>"): 0.25, (2, "a", "</s>"): 0.75}
    lm = L.build_lm(G.weighted_counts(df, "weight", 2), 2, "presmoothed")
    assert _rows(lm.probs, "ord", "h", "w", "p")[(2, "a", "b")] == 0.25
    assert _rows(G.round_counts(G.weighted_counts(df, "weight", 2)), "ord", "h", "w", "c") == {
        (1, "", "a"): 1, (1, "", "</s>"): 1, (2, "<s>", "a"): 1, (2, "a", "</s>"): 1}


def _file(lines):
    d = tempfile.mkdtemp(prefix="file-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(d, "f.txt"), "w") as f:
        f.write("\n".join(lines))
    return d


def test_readers_report_broken_lines(spark):
    report = Observation()
    got = files.read_unigrams(spark, _file(["the 0.5", "of", "", "and x", "a 0.25"]), report)
    assert sorted(map(tuple, got.collect())) == [("a", 0.25), ("the", 0.5)] and report.get == {"lines": 5, "malformed": 3}
    report = Observation()
    got = files.read_vocab(spark, _file(["<s> 1", "the\t2 extra", "", "alone"]), report)
    assert sorted(map(tuple, got.collect())) == [("<s>", "1"), ("the", "2")] and report.get == {"lines": 4, "malformed": 2}
    report = Observation()
    got = files.read_pairs(spark, _file(["a\tb", "none", "a\tb\tc"]), report)
    assert sorted(r.text for r in got.collect()) == ["a\tb", "a\tb\tc", "none"] and report.get == {"lines": 3, "malformed": 2}
    report, repeats = Observation(), Observation()
    v = files.read_vectors(spark, _file(["9 3", "a 1 0 0", "b 0 1", "a 0 0 1", "broken", "c 1 x 0", "d 0 1 0"]), report=report)
    got = files.drop_repeated_words(v, repeats).collect()
    assert {r.word: (r["rank"], list(r.v)) for r in got} == {"a": (2, [0, 0, 1]), "b": (1, [0, 1]), "d": (5, [0, 1, 0])}
    assert report.get == {"header_n": 9, "header_dim": 3, "rows": 6, "malformed": 2, "min_dim": 2, "max_dim": 3}
    assert repeats.get == {"words": 3, "repeated": 1}


def test_chunk_files_of_any_number(spark):
    d = tempfile.mkdtemp(prefix="chunks-", dir=os.environ.get("TMPDIR", "/tmp"))
    for n in (0, 7, 999, 1000):
        with open(os.path.join(d, f"{n:03d}.txt"), "w") as f:
            f.write(f"first {n}\nsecond {n}\n")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("no chunk\n")
    want = [(n, i, f"{t} {n}") for n in (0, 7, 999, 1000) for i, t in enumerate(("first", "second"))]
    assert sorted(map(tuple, files.read_chunks(spark, d).collect())) == want
    assert sorted(map(tuple, files.read_chunks(spark, d, 1000).collect())) == want[:6]


def test_curves_pairs_and_stores_round_trip(spark):
    root = tempfile.mkdtemp(prefix="round-", dir=os.environ.get("TMPDIR", "/tmp"))
    curve = spark.createDataFrame([(1, 2.5), (2, 1.25)], "i long, ppl double")
    files.write_curve(curve, root + "/curve")
    assert sorted(map(tuple, files.read_curve(spark, root + "/curve").collect())) == [(1, 2.5), (2, 1.25)]
    store = spark.createDataFrame([("line", 1, "sent\nx")], "line string, rank int, sent string")
    files.save_paraphrases(store, root + "/store")
    assert files.load_paraphrases(spark, root + "/store").collect() == store.collect()
