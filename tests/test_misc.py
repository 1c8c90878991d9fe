import hashlib
import math
import os
import tempfile

from pyspark.sql import functions as F

from varietas.operators import neighbours as N
from varietas.operators import sampling as SMP
from varietas.operators.rows import shuffle, with_row_index
from varietas.plans.pairs import bleu
from varietas.sources import files


def test_row_index_is_dense_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    out = with_row_index(df, ["k"], "rn").collect()
    assert sorted((r.k, r.rn) for r in out) == [(i, i + 1) for i in range(5000)]


def test_shuffle_is_reproducible_permutation(spark):
    df = spark.range(1, 200).withColumnRenamed("id", "sent_id")
    a = {r.sent_id: r.shuffled_rank for r in shuffle(df, 9).collect()}
    b = {r.sent_id: r.shuffled_rank for r in shuffle(df, 9).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 200))


def test_draws_match_brute_force(spark):
    uni = spark.createDataFrame([("a", 5), ("b", 1), ("c", 3), ("d", 1)], "word string, n long")
    keys = spark.range(0, 300).select(F.col("id").alias("sent_id"), F.lit(0).alias("pos"))
    d = SMP.draw_words(keys.withColumn("k", SMP.draw60(4, F.col("sent_id"), F.col("pos"))), SMP.cdf(uni))
    got = {r.sent_id: r.alt for r in d.collect()}
    items = sorted([("a", 5), ("b", 1), ("c", 3), ("d", 1)], key=lambda x: (x[1], x[0]))
    total = 10
    for sid in range(300):
        k = int(hashlib.md5(f"4:{sid}:0".encode()).hexdigest()[:15], 16)
        t = (k * total) >> 60
        lo = 0
        for w, n in items:
            if lo <= t < lo + n:
                exp = w
                break
            lo += n
        assert got[sid] == exp


def test_bleu_of_identical_text_is_one(spark):
    pairs = spark.createDataFrame([("1", "a b c d e", "a b c d e"), ("2", "x y z w", "x y z w")],
                                  "pair_id string, source string, target string")
    assert math.isclose(bleu(pairs).first().bleu, 1.0)


def _toy_vectors(spark):
    rows = [(0, "a", [1.0, 0.0, 0.0]), (1, "b", [0.9, 0.1, 0.0]), (2, "c", [0.0, 1.0, 0.0]),
            (3, "d", [0.5, 0.5, 0.5]), (4, "a", [0.0, 0.0, 2.0]), (5, "z", [0.0, 0.0, 0.0])]
    return N.normalize_vectors(spark.createDataFrame(rows, "rank int, word string, v array<double>"))


def test_near_properties(spark):
    vec = _toy_vectors(spark)
    words = spark.createDataFrame([("a",), ("b",), ("zz",)], "word string")
    r2 = {(r.query, r.rn): (r.word, r.sim) for r in N.near(words, vec, 2, block_rows=2).collect()}
    r3 = {(r.query, r.rn): (r.word, r.sim) for r in N.near(words, vec, 3, block_rows=2).collect()}
    assert all(r3[k] == v for k, v in r2.items())                    # near(k) is a prefix of near(k+1)
    assert r3[("a", 1)][0] == "a"                                      # last duplicate wins, self first
    assert not any(q == "zz" for q, _ in r3)                           # unknown word: no rows
    assert not any(v[0] == "z" for v in r3.values())                   # zero vector never listed
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "zz")], "w1 string, w2 string")
    sims = {(r.w1, r.w2): r.sim for r in N.pair_sim(pairs, vec).collect()}
    assert sims[("a", "d")] == sims[("d", "a")] and sims[("a", "zz")] is None


def test_read_vectors_file(spark):
    d = tempfile.mkdtemp(prefix="vecs-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(d, "v.txt"), "w") as f:
        f.write("3 2\nthe 1.0 0.0\nof 0.6 0.8\nand 0.0 2.0\n")
    v = files.read_vectors(spark, d, maxtypes=2).orderBy("rank").collect()
    assert [(r.rank, r.word) for r in v] == [(0, "the"), (1, "of")]
    assert list(v[1].v) == [0.6000000238418579, 0.800000011920929]


def test_stream_equals_batch(spark):
    from varietas.streaming.interactive import serve_lines, word_query_service
    vec = _toy_vectors(spark)
    words = spark.createDataFrame([("a",), ("c",), ("d",), ("q",)], "text string")
    streamed = sorted(tuple(r) for r in serve_lines(spark, words, word_query_service(vec, "nearest", 2), files=2)
                      .select("query", "rn", "word", "sim").collect())
    batch = sorted(tuple(r) for r in N.near(words.withColumnRenamed("text", "word"), vec, 2)
                   .select("query", "rn", "word", "sim").collect())
    assert streamed == batch


def test_draws_over_very_many_tokens(spark):
    counts = [("w%02d" % i, 1 + i * i) for i in range(60)] + [("hot", 4_000_000_000), ("hotter", 9_000_000_000)]
    keys = spark.range(0, 400).select(F.col("id").alias("sent_id"), F.lit(0).alias("pos"))
    d = SMP.draw_words(keys.withColumn("k", SMP.draw60(4, F.col("sent_id"), F.col("pos"))),
                       SMP.cdf(spark.createDataFrame(counts, "word string, n long")))
    got = {r.sent_id: r.alt for r in d.collect()}
    items, total = sorted(counts, key=lambda x: (x[1], x[0])), sum(n for _, n in counts)
    for sid in range(400):
        t = int(hashlib.md5(f"4:{sid}:0".encode()).hexdigest()[:15], 16) * total >> 60
        ends = 0
        for w, n in items:
            ends += n
            if t < ends:
                break
        assert got[sid] == w
    # every value of a small distribution finds its word
    small = [("a", 1), ("b", 1), ("c", 40), ("d", 300), ("e", 301)]
    every = spark.range(0, 643).withColumn("k", F.expr(f"cast((cast(id as decimal(19,0)) * {1 << 60}BD + 642) div 643 as long)"))
    got = dict(SMP.draw_words(every, SMP.cdf(spark.createDataFrame(small, "word string, n long"))).groupBy("alt").count().collect())
    assert got == dict(small)


def test_restore_multiplicity_splits_a_popular_row(spark):
    from varietas.operators.vocab import restore_multiplicity
    df = spark.createDataFrame([("a", 1), ("b", 25), ("c", 10)], "text string, num long")
    got = sorted((r.text, r.copy) for r in restore_multiplicity(df, block=10).collect())
    assert got == sorted((t, i) for t, n in (("a", 1), ("b", 25), ("c", 10)) for i in range(1, n + 1))


def test_split_files_keep_line_numbers(spark):
    d = tempfile.mkdtemp(prefix="lines-", dir=os.environ.get("TMPDIR", "/tmp"))
    want = {}
    for name, n in (("a", 5000), ("b", 0), ("c", 3)):
        rows = ["" if i % 7 == 0 else f"{name} line {i}" for i in range(n)]
        with open(os.path.join(d, name + ".txt"), "w") as f:
            f.writelines(r + "\n" for r in rows)
        want |= {(name, i): r for i, r in enumerate(rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        back = files.read_sentences(spark, d)
        got = {(os.path.basename(r.file)[:-4], r.line_no): r.text for r in back.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_streams_answer_every_repeated_line(spark):
    from varietas.streaming.interactive import lex_alternatives_service, serve_lines, word_query_service
    vec = _toy_vectors(spark)
    lines = spark.createDataFrame([("a b",)] * 3 + [("c d",)], "text string")
    out = serve_lines(spark, lines, lex_alternatives_service(vec), files=1)
    per_line = {(r.file, r.line_no, r.text) for r in out.collect()}
    assert sorted(t for _, _, t in per_line) == ["a b", "a b", "a b", "c d"]
    words = spark.createDataFrame([("a",), ("a",)], "text string")
    assert serve_lines(spark, words, word_query_service(vec, "nearest", 2), files=1).count() == 4


def test_line_without_a_path_is_all_wrong(spark):
    from varietas.operators import lm as L
    from varietas.operators import ngrams as G
    from varietas.plans import paraphrase as P
    lm = L.build_lm(G.ngram_counts(spark.createDataFrame([("a b",), ("b c",)], "text string"), 2), 2, "unsmoothed")
    uni = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "word string, n long")
    dev = spark.createDataFrame([(1, "zz zz zz"), (2, "")], "sent_id long, text string")
    row = P.awer(dev, uni, lm).first()
    assert (row.awer, row.n_lines) == (0.5, 2)


def test_vector_index_loses_no_vector_and_finds_most_neighbours(spark):
    import numpy as np

    from varietas.operators import vector_index as VI
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([centre[i % 12] + 0.4 * rng.normal(size=16) for i in range(600)]).reshape(600, 16)
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 16))                 # a third of the vectors in one cell
    vec = spark.createDataFrame([(i, f"w{i:03d}", v.tolist()) for i, v in enumerate(x)] + [(600, "zero", [0.0] * 16)], "rank int, word string, v array<double>")
    u = N.normalize_vectors(vec)
    words = spark.createDataFrame([(f"w{i:03d}",) for i in range(0, 600, 7)] + [("unknown",), ("zero",)], "word string")
    exact = N.near(words, u, 10)
    index = VI.build_index(u, sample=100)
    assert index.table.count() == 600 and index.cells == 24
    full = VI.near_indexed(words, index, 10, probes=index.cells, block_rows=64)
    assert sorted(map(tuple, full.collect())) == sorted((r.query, r.rn, r.word, r.sim) for r in exact.collect())
    some = VI.near_indexed(words, index, 10, probes=8, block_rows=64)
    got = VI.recall(some, exact).first()
    assert got.pairs == 860 and got.recall >= 0.9
    none = VI.build_index(u.where("word = 'nothing'"))
    assert VI.near_indexed(words, none, 10).count() == 0


def test_queries_are_copied_per_block_of_cells_not_per_cell():
    import numpy as np

    from varietas.operators import vector_index as VI
    sizes = {**{c: 10 for c in range(30)}, 30: 900, 31: 10}
    packed = VI.pack_cells(sizes, 300)
    assert [packed[c] for c in (0, 29, 30, 31)] == [(0, 1), (0, 1), (1, 3), (4, 1)]
    first, parts = (np.array([packed[c][i] for c in range(32)]) for i in (0, 1))
    held = np.array([30, 1, 1, 1, 1])
    own, block, cells = VI._blocks_of(np.array([list(range(32)), list(range(1, 32)) + [31]])[:, :32], first, parts, held)
    assert own[:5].tolist() == [0] * 5 and block[:5].tolist() == [0, 1, 2, 3, 4] and cells[:5] == [None] * 5
    own, block, cells = VI._blocks_of(np.array([[3, 30, 7]]), first, parts, held)
    assert block.tolist() == [0, 1, 2, 3] and cells[0].tolist() == [3, 7] and cells[1:] == [None] * 3


def test_blocks_meet_when_partitions_are_not_coalesced(spark):
    import numpy as np
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    u = N.normalize_vectors(spark.createDataFrame([(i, f"w{i:02d}", v.tolist()) for i, v in enumerate(x)], "rank int, word string, v array<double>"))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = N.near(u.select("word"), u, 3, block_rows=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {(f"w{i:02d}", f"w{j:02d}") for i in range(60) for j in np.argsort(-(x @ x[i]))[:3]}
    assert len(got) == 180 and {(r.query, r.word) for r in got} == want
