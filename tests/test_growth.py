"""What is shuffled or stored per row of input: findings on disk."""

import numpy as np
from pyspark.sql import functions as F


def test_only_words_that_can_have_a_rank_are_ranked(spark):
    from varietas.sources.tables import most_frequent
    counts = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 7), ("e", 2), ("f", 1)], "word string, n long")
    kept = lambda k: sorted(r.word for r in most_frequent(counts, F.lit(k)).collect())
    assert kept(1) == ["a"] and kept(2) == kept(3) == kept(4) == ["a", "b", "c", "d"]      # ties with the last one stay
    assert kept(5) == ["a", "b", "c", "d", "e"] and len(kept(6)) == len(kept(60)) == 6
    assert len(most_frequent(counts, F.lit(None).cast("long")).collect()) == 6


def test_blocks_of_vectors_grow_with_the_tables(spark):
    """What is shuffled is (vectors x query blocks + queries x vector blocks): more vectors, larger blocks, up to a bound."""
    from varietas.operators import neighbours as N
    sizes = [N.rows_per_block(spark, n, n) for n in (10, 10_000, 200_000, 10_000_000)]
    assert sizes[0] == N.BLOCK_ROWS and sizes == sorted(sizes) and N.BLOCK_ROWS < sizes[2] <= sizes[3] == N.MAX_ROWS
    rng = np.random.default_rng(3)
    rows = [(f"w{i}", [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(90, 6)))]
    vec = spark.createDataFrame(rows, "word string, u array<double>")
    words = vec.select("word").where("word < 'w4'")
    found = {(r.query, r.rn): (r.word, r.sim) for r in N.near(words, vec, 4).collect()}
    assert found == {(r.query, r.rn): (r.word, r.sim) for r in N.near(words, vec, 4, block_rows=16).collect()}


def _lattices(spark, n):
    """Random lattices with a word that is in every slot, and a model over their words."""
    import random

    from varietas.operators import lm as L
    from varietas.operators import ngrams as G
    rng = random.Random(n)
    lines = spark.createDataFrame([(" ".join(rng.choices("abcdef", weights=[9, 3, 2, 1, 1, 1], k=8)),) for _ in range(40)], "text string")
    lm = L.build_lm(G.ngram_counts(lines, n), n, "witten_bell", materialize=True)
    rows = [(s, p, w, round(rng.random() / 10, 6)) for s in range(12) for p in range(9) for w in {"a", *rng.sample(["b", "c", "d", "e", "f", "zz"], 2)}]
    return lm, spark.createDataFrame(rows, "sent_id long, pos int, word string, cost double"), rows


def test_windows_cost_what_the_model_says(spark, monkeypatch):
    """Orders 1 to 4, with the words of a slot in many blocks: the same LM costs as one look-up per (history, word)."""
    import itertools
    import math

    from varietas.operators import decode as D
    for n, asked in ((1, 32_768), (2, 5), (3, 32_768), (3, 5), (4, 50)):
        monkeypatch.setattr(D, "ASKED", asked)
        lm, slots, rows = _lattices(spark, n)
        own = {}
        for s, p, w, _ in rows:
            own.setdefault((s, p), set()).add(w)
        at = lambda s, p: sorted(own[s, p]) if p >= 0 else ["<s>"] if p == -1 else [""]
        want = {}
        for s in range(12):
            for p in range(10):
                before = [at(s, p - i) for i in range(n - 1, 0, -1)]
                words = at(s, p) if p < 9 else ["</s>"]
                want[s, p] = [(" ".join(x for x in h if x), w) for h in itertools.product(*before) for w in words]
        keys = spark.createDataFrame(sorted({x for pairs in want.values() for x in pairs}), "h string, w string")
        p_of = {(r.h, r.w): r.p for r in lm.lookup(keys).collect()}
        got = {(r.sent_id, r.pos): r.lm for r in D.lattice_windows(slots, lm).collect()}
        assert got.keys() == want.keys()
        for place, pairs in want.items():
            assert got[place] == [math.floor(-math.log(p_of[x]) * D.UNIT + 0.5) for x in pairs], (n, place)


def test_no_row_per_history_and_word_is_shuffled(spark, monkeypatch):
    """A window asks for its n-grams by one row per word of the slot before, not by one per (history, word) pair."""
    from varietas.operators import decode as D
    lm, slots, rows = _lattices(spark, 3)
    sent, real = [], D._window_costs
    monkeypatch.setattr(D, "_window_costs", lambda n: sent.append(n) or real(n))
    D.nbest(slots, lm, 3).collect()
    assert sent == [3]


def test_hashes_of_windows_see_where_a_slot_ends(spark):
    from varietas.operators import decode as D
    from varietas.operators import lm as L
    from varietas.operators import ngrams as G
    lines = spark.createDataFrame([("a b c",), ("a c b",)], "text string")
    lm = L.build_lm(G.ngram_counts(lines, 3), 3, "witten_bell")
    slots = [(1, 0, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a"), (2, 1, "a"), (2, 2, "b"), (2, 2, "c")]
    df = spark.createDataFrame([(*x, 0.0) for x in slots], "sent_id long, pos int, word string, cost double")
    sizes = {(r.sent_id, r.pos): len(r.lm) for r in D.lattice_windows(df, lm).collect()}
    assert sizes[1, 2] == 2 and sizes[2, 2] == 2 and sizes[1, 1] == 2 and sizes[1, 3] == 2 and sizes[2, 3] == 2


def test_shuffle_files_of_finished_steps_are_released(spark, monkeypatch):
    from varietas import session
    monkeypatch.setattr(session, "RELEASE_S", 0)
    ids = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    import time
    for _ in range(20):                                                 # what earlier tests left
        session.release(spark)
        time.sleep(0.1)
    before = ids()
    kept = [session.store(spark.range(50).repartition(7).groupBy((F.col("id") % 5).alias("g")).count()) for _ in range(6)]
    kept += [session.checkpoint(spark.range(50).repartition(7).groupBy((F.col("id") % 5).alias("g")).count()) for _ in range(6)]
    for _ in range(50):
        session.release(spark)
        if ids() <= before + 2:
            break
        time.sleep(0.1)
    assert ids() <= before + 2 and all(d.count() == 5 for d in kept)


def test_lexical_alternatives_by_buckets_equal_one_query_at_a_time(spark, monkeypatch):
    """A hot target in many buckets, unknown words, and queries that share a qid: the same scores as a loop over the definition."""
    import math
    import random

    from varietas.operators import neighbours as N
    rng = random.Random(2)
    names = [f"w{i}" for i in range(30)]
    raw = {w: [rng.gauss(0.4, 1) for _ in range(5)] for w in names}
    unit = {w: [x / math.sqrt(sum(y * y for y in v)) for x in v] for w, v in raw.items()}
    vec = spark.createDataFrame(list(unit.items()), "word string, u array<double>")
    queries = [(f"q{i}", "w1" if i % 2 else rng.choice([*names, "zz"]), rng.choices([*names, "zz"], k=rng.randint(0, 4))) for i in range(60)]
    queries += [queries[0], queries[1]]
    df = spark.createDataFrame(queries, "qid string, target string, context array<string>")
    sim = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b])), 6)
    for dist in (False, True):
        monkeypatch.setattr(N, "LEAST_QUERIES", 3)
        monkeypatch.setattr(N, "QUERIES", 3)
        got = {}
        for r in N.lex_alternatives(df, vec, dist, num_alts=4, num_near=9).collect():
            got.setdefault(r.qid, []).append((r.rn, r.word, r.score))
        want = {}
        for qid in {q[0] for q in queries}:
            rows = [q for q in queries if q[0] == qid]
            target, context = rows[0][1], sorted((i, w) for q in rows for i, w in enumerate(q[2]) if w in unit)
            if target not in unit:
                continue
            best = []
            for rn, w in enumerate(sorted(names, key=lambda w: (sim(target, w), w), reverse=True)[:9]):
                s = sim(target, w)
                for i, c in context:
                    f = sim(c, w)
                    s = None if s is None or dist and f < 0 else s * (f ** (1 / (i + 2)) if dist else f)
                best.append((s is None, -round(s or 0, 6), rn, w))
            want[qid] = [(i + 1, w, None if none else -s) for i, (none, s, _, w) in enumerate(sorted(best)[:4]) for _ in rows]
        assert {q: sorted(v, key=lambda x: x[0]) for q, v in got.items()} == want, dist
