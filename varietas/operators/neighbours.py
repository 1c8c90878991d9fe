"""Word-vector operators (S2 normalisation, M1–M3, J1, J2, J11, W2–W4, W13).

Nearest neighbours (J2 + W2/W3) is the one operator with a quadratic core: every query is scored
against every vocabulary vector.  It runs as a blocked matrix product:

* vocabulary rows are hashed into ``vb = ceil(n_vocab / block_rows)`` blocks and queries into
  ``qb = ceil(n_queries / block_rows)`` buckets, so a block holds about ``block_rows`` vectors: as many as leave
  every core some groups, ``MAX_ROWS`` at most (:func:`rows_per_block`), since what is shuffled falls with the blocks;
* each vocabulary block is co-grouped with each query bucket (vectors are replicated ``qb`` times,
  queries ``vb`` times — the usual 2-D GEMM layout), so a group's size stays near
  ``2 * block_rows`` vectors however large the inputs;
* inside a group one ``numpy`` product scores the pairs and only the per-query top-k leaves the
  task (rounded similarity desc, word desc — the reference's reversed tuple sort);
* the ≤ ``vb * k`` partial winners of a query are merged with ``row_number() <= k``, which Spark
  plans as a WindowGroupLimit.

Nothing passes through the driver and no all-pairs table is materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varietas.functions import dot, l2_normalize
from varietas.session import checkpoint, store

SIM_DP = 6          # similarities are ranked and reported at 6 decimals (H5)
BLOCK_ROWS = 4096   # least vectors per block on either side of the product
MAX_ROWS = 65_536   # most of them (32 MB at 64 dimensions)
ENTRIES = 1 << 20   # similarities of a block worked out by one matrix product
LEAST_QUERIES, QUERIES = 512, 16_384    # queries for lexical alternatives that are dealt to one bucket


def normalize_vectors(vectors: DataFrame, maxtypes: int = 0, vec_col: str = "v") -> DataFrame:
    """(rank, word, u): unit vectors in double (M1), the first ``maxtypes`` ranks only.

    A word that appears twice keeps its *last* row, as a dictionary load would.  A zero vector
    yields a NULL ``u``, which never appears in a neighbour list.
    """
    v = vectors if maxtypes <= 0 else vectors.where(F.col("rank") < F.lit(maxtypes))
    last = Window.partitionBy("word").orderBy(F.col("rank").desc())
    v = v.withColumn("_last", F.row_number().over(last)).where(F.col("_last") == 1).drop("_last")
    return v.select("rank", "word", l2_normalize(F.col(vec_col)).alias("u"))


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def rows_per_block(spark: SparkSession, n_vocab: int, n_queries: int) -> int:
    """Vectors per block: three groups a core if blocks of ``BLOCK_ROWS`` to ``MAX_ROWS`` vectors can give that."""
    even = math.isqrt(n_vocab * n_queries // (3 * spark.sparkContext.defaultParallelism))
    return min(MAX_ROWS, max(BLOCK_ROWS, even))


def _topk_block(k: int, include_self: bool):
    def run(key, vocab: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series([], dtype=object), "word": pd.Series([], dtype=object),
                              "sim": pd.Series([], dtype="float64")})
        if len(vocab) == 0 or len(q) == 0:
            return empty
        mat = np.stack(vocab["u"].to_numpy()).astype(np.float64)
        words = vocab["word"].to_numpy(object)
        qids, vecs = q["qid"].to_numpy(object), q["qv"].to_numpy()
        qwords = q["qword"].to_numpy() if "qword" in q else None
        probed = q["cells"].to_numpy(object) if "cells" in q else None      # null: every vector of the block
        out_q, out_w, out_s = [], [], []
        kk = min(k, len(words))
        word_order = np.argsort(words)[::-1]            # word descending, for tie-breaks
        rank_of = np.empty(len(words), dtype=np.int64)
        rank_of[word_order] = np.arange(len(words))
        step = max(1, ENTRIES // len(words))
        for i, qid in enumerate(qids):
            if i % step == 0:                           # a few queries' similarities at a time
                sims = np.round(np.stack(vecs[i:i + step]).astype(np.float64) @ mat.T, SIM_DP)
            row = sims[i % step]
            if not include_self and qwords is not None:
                row = np.where(words == qwords[i], -np.inf, row)
            if probed is not None and probed[i] is not None:
                row = np.where(np.isin(vocab["cell"].to_numpy(), probed[i]), row, -np.inf)
            if kk < len(row):
                kth = -np.partition(-row, kk - 1)[kk - 1]
                cand = np.nonzero(row >= kth)[0]
            else:
                cand = np.arange(len(row))
            order = np.lexsort((rank_of[cand], -row[cand]))[:kk]
            sel = cand[order]
            sel = sel[np.isfinite(row[sel])]
            out_q.extend([qid] * len(sel))
            out_w.extend(words[sel].tolist())
            out_s.extend(row[sel].tolist())
        return pd.DataFrame({"qid": out_q, "word": out_w, "sim": out_s})
    return run


def block_topk(queries: DataFrame, vocab: DataFrame, k: int, include_self: bool = True,
               block_rows: int | None = None) -> DataFrame:
    """Top-k vocabulary words per query vector.

    ``queries``: (qid string, qv array<double>[, qword string]); ``vocab``: (word, u array<double>).
    Returns (qid, word, sim, rn) with ``rn`` 1..k by (sim desc, word desc).
    """
    # both sides are materialised once (reliable checkpoint): the block counts below then read the
    # stored rows instead of recomputing the inputs, and a lost executor does not recompute them
    vocab = checkpoint(vocab.where(F.col("u").isNotNull()).select("word", "u"))
    has_qword = "qword" in queries.columns
    queries = checkpoint(queries.where(F.col("qv").isNotNull()))
    n_v, n_q = vocab.count(), queries.count()
    block_rows = block_rows or rows_per_block(vocab.sparkSession, n_v, n_q)
    vb, qb = _blocks(n_v, block_rows), _blocks(n_q, block_rows)
    # longs on both sides: keys of unequal types are hashed to different partitions, and their groups never meet
    zero = F.lit(0).cast("long")
    vrep = vocab.select("word", "u", F.pmod(F.xxhash64("word"), F.lit(vb)).alias("vb"),
                        F.explode(F.sequence(zero, F.lit(qb - 1).cast("long"))).alias("qb"))
    qcols = ["qid", "qv"] + (["qword"] if has_qword else [])
    qrep = queries.select(*qcols, F.pmod(F.xxhash64("qid"), F.lit(qb)).alias("qb"),
                          F.explode(F.sequence(zero, F.lit(vb - 1).cast("long"))).alias("vb"))
    schema = "qid string, word string, sim double"
    partial = (vrep.groupBy("vb", "qb").cogroup(qrep.groupBy("vb", "qb"))
               .applyInPandas(_topk_block(k, include_self), schema))
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("word").desc())
    return partial.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.lit(k))


def near(words: DataFrame, vectors: DataFrame, k: int = 10, include_self: bool = True,
         word_col: str = "word", block_rows: int | None = None) -> DataFrame:
    """The k nearest vocabulary words of each distinct query word (unknown words give no rows).

    ``vectors`` is the output of :func:`normalize_vectors`.  Returns (query, rn, word, sim).
    Work is done once per *distinct* query word.
    """
    q = words.select(F.col(word_col).alias("qid")).distinct()
    qv = q.join(vectors.select(F.col("word").alias("qid"), F.col("u").alias("qv")), "qid")   # J1
    qv = qv.withColumn("qword", F.col("qid"))
    top = block_topk(qv, vectors, k, include_self, block_rows)
    return top.select(F.col("qid").alias("query"), "rn", "word", "sim")


def near_vec(query_vectors: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "qid",
             vec_col: str = "v", block_rows: int | None = None) -> DataFrame:
    """The k nearest words of raw (not normalised) query vectors.  Returns (qid, rn, word, sim)."""
    q = query_vectors.select(F.col(id_col).cast("string").alias("qid"),
                             F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("qv"))
    return block_topk(q, vectors, k, True, block_rows).select("qid", "rn", "word", "sim")


def pair_sim(pairs: DataFrame, vectors: DataFrame, w1: str = "w1", w2: str = "w2") -> DataFrame:
    """M2: cosine similarity of word pairs (NULL when either word is unknown); adds ``sim``."""
    a = vectors.select(F.col("word").alias("_a"), F.col("u").alias("_ua"))
    b = vectors.select(F.col("word").alias("_b"), F.col("u").alias("_ub"))
    out = (pairs.join(a, pairs[w1] == a["_a"], "left").join(b, pairs[w2] == b["_b"], "left"))
    return out.select(*pairs.columns, F.round(dot(F.col("_ua"), F.col("_ub")), SIM_DP).alias("sim"))


def lookup_vectors(words: DataFrame, vectors: DataFrame, word_col: str = "word", decimals: int = 6) -> DataFrame:
    """M3: ``word v1 v2 ...`` for known words (unknown words are reported with ``line`` NULL)."""
    v = vectors.select(F.col("word").alias("_w"), "u")
    out = words.join(v, words[word_col] == v["_w"], "left")
    fmt = F.transform(F.col("u"), lambda x: F.format_string(f"%.{decimals}f", x))
    return out.select(F.col(word_col).alias("word"),
                      F.when(F.col("u").isNotNull(), F.concat_ws(" ", F.col(word_col), fmt)).alias("line"))


def lex_alternatives(queries: DataFrame, vectors: DataFrame, dist_flag: bool = False, num_alts: int = 10,
                     num_near: int = 100, block_rows: int | None = None) -> DataFrame:
    """Context-adjusted lexical alternatives.

    ``queries``: (qid, target string, context array<string>).  The target's ``num_near`` nearest
    words (itself included) are re-scored by every *known* context word c at index i:
    ``score *= sim(c, w)`` or, with ``dist_flag``, ``score *= sim(c, w) ** (1/(i+2))`` — i counts
    unknown context words too.  The best ``num_alts`` by score desc (ties keep the neighbour order)
    are returned as (qid, rn, word, score).

    Queries are dealt by target into buckets (a target with many queries into several).  A bucket gets the vector of every word that
    its queries and their targets' neighbours hold once, so no similarity is shuffled (:func:`_alternatives`).  Queries that
    share their ``qid`` share their context words too (:func:`_shared_alternatives`).
    """
    queries = store(queries.select("qid", "target", "context"))
    nb = near(queries.select(F.col("target").alias("word")), vectors, num_near, True, "word", block_rows)
    nb = store(nb.select(F.col("query").alias("target"), F.struct("rn", "word", "sim").alias("c")))
    once = queries.groupBy("qid").count().where("count = 1 and qid is not null").select("qid")
    scored = _alternatives(store(queries.join(once, "qid", "left_semi")), nb, vectors, dist_flag, num_alts)
    shared = store(queries.join(once, "qid", "left_anti"))
    if not shared.isEmpty():
        scored = scored.unionByName(_shared_alternatives(shared, nb, vectors, dist_flag))
    # (no score, falling score, neighbour order): the first num_alts of a sorted array
    ranked = F.array_sort(F.zip_with("_c", "_s", lambda c, s: F.struct(
        s.isNull().alias("none"), (-F.round(s, SIM_DP)).alias("neg"), c["rn"].alias("at"), c["word"].alias("word"))))
    best = scored.select("qid", F.posexplode(F.slice(ranked, 1, num_alts)).alias("_i", "_b"))
    return best.select("qid", (F.col("_i") + 1).alias("rn"), F.col("_b.word").alias("word"), (-F.col("_b.neg")).alias("score"))


def _alternatives(queries: DataFrame, nb: DataFrame, vectors: DataFrame, dist_flag: bool, num_alts: int) -> DataFrame:
    """(qid, _c, _s): neighbours (rn, word) with their scores, of queries that each have a ``qid`` of their own.

    Only those within rounding of the ``num_alts`` best are returned.
    """
    spark = queries.sparkSession
    n = queries.count()
    per = min(QUERIES, max(LEAST_QUERIES, n // (3 * spark.sparkContext.defaultParallelism)))
    hot = F.broadcast(queries.groupBy("target").count().where(F.col("count") > per).select("target", F.ceil(F.col("count") / per).alias("_parts")))
    salt = F.pmod(F.xxhash64("qid"), F.coalesce("_parts", F.lit(1)))
    dealt = store(queries.join(hot, "target", "left").select("qid", "target", "context", F.pmod(F.xxhash64("target", salt), F.lit(max(1, -(-n // per)))).alias("_bucket")))
    mine = nb.join(dealt.select("_bucket", "target").distinct(), "target")
    held = dealt.select("_bucket", F.explode("context").alias("word")).unionByName(mine.select("_bucket", F.col("c.word").alias("word"))).distinct()
    none = F.lit(None)
    sent = held.join(vectors.where(F.col("u").isNotNull()).select("word", "u"), "word").select(F.col("_bucket").alias("_at"), "word", "u", none.cast("string").alias("target"), none.cast("int").alias("rn"), none.cast("double").alias("sim"))
    sent = sent.unionByName(mine.select(F.col("_bucket").alias("_at"), "c.word", none.cast("array<double>").alias("u"), "target", "c.rn", "c.sim"))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        of_target = held["target"].notna()
        words = held[~of_target]
        place = {w: i for i, w in enumerate(words["word"])}
        mat = np.stack(words["u"].to_numpy()).astype(np.float64) if len(words) else None
        near_of = {t: g.sort_values("rn") for t, g in held[of_target].groupby("target")}
        out = []
        for target, group in asked.groupby("target"):
            own = near_of.get(target)
            if own is None:
                continue
            rn, names, start = own["rn"].to_numpy(np.int32), own["word"].to_numpy(object), own["sim"].to_numpy(np.float64)
            block = mat[[place[w] for w in names]]
            known = {w: None for context in group["context"] for w in context if w in place}
            at = {w: i for i, w in enumerate(known)}
            sims = np.round(mat[[place[w] for w in known]] @ block.T, SIM_DP) if known else None
            for qid, context in zip(group["qid"], group["context"]):
                score = start
                for i, w in enumerate(context):
                    if w in at:
                        f = sims[at[w]]
                        if dist_flag:
                            f = np.where(f >= 0, np.power(np.abs(f), 1.0 / (i + 2.0)), np.nan)
                        score = score * f
                ranked = np.where(np.isnan(score), -np.inf, score)
                last = -np.partition(-ranked, num_alts - 1)[num_alts - 1] if num_alts < len(ranked) else -np.inf
                keep = np.flatnonzero(ranked >= last - 2.0 * 10.0 ** -SIM_DP)
                out.append((qid, rn[keep], names[keep], score[keep]))
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(("qid", "rns", "words", "scores"))})

    qid_type = queries.schema["qid"].dataType.simpleString()
    found = dealt.groupBy("_bucket").cogroup(sent.groupBy("_at")).applyInPandas(run, f"qid {qid_type}, rns array<int>, words array<string>, scores array<double>")
    return found.select("qid", F.zip_with("rns", "words", lambda r, w: F.struct(r.alias("rn"), w.alias("word"))).alias("_c"),
                        F.transform("scores", lambda s: F.when(~F.isnan(s), s)).alias("_s"))


def _shared_alternatives(queries: DataFrame, nb: DataFrame, vectors: DataFrame, dist_flag: bool) -> DataFrame:
    """(qid, _c, _s) where several queries have one ``qid`` (or none): each is re-scored by the context words of all of them.

    A distinct (target, context word) yields one array of similarities, aligned with the target's neighbours.
    """
    own = nb.join(queries.select("target").distinct(), "target").join(vectors.select(F.col("word").alias("_w"), F.col("u").alias("wu")), F.col("c.word") == F.col("_w"))
    own = store(own.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("c.rn", "c.word", "c.sim", "wu"))).alias("_c")))
    ctx = queries.select("qid", "target", F.posexplode("context").alias("widx", "cword"))
    known = vectors.select(F.col("word").alias("cword"), F.col("u").alias("cu")).where(F.col("cu").isNotNull())
    asked = ctx.select("target", "cword").distinct().join(known, "cword").join(own, "target")
    sims = asked.select("target", "cword", F.transform("_c", lambda c: F.round(dot(F.col("cu"), c["wu"]), SIM_DP)).alias("sims"))
    factors = ctx.join(sims, ["target", "cword"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("widx", "sims"))).alias("_f"))

    def factor(x, s):
        return F.when(s >= 0, F.pow(s, F.lit(1.0) / (x["widx"] + F.lit(2.0)))) if dist_flag else s

    rows = queries.select("qid", "target").join(own, "target").join(factors, "qid", "left")
    start = F.transform("_c", lambda c: c["sim"])
    rows = rows.withColumn("_s", F.when(F.col("_f").isNull(), start).otherwise(F.aggregate(
        "_f", start, lambda acc, x: F.zip_with(acc, x["sims"], lambda have, s: have * factor(x, s)))))
    return rows.select("qid", F.transform("_c", lambda c: F.struct(c["rn"].alias("rn"), c["word"].alias("word"))).alias("_c"), "_s")


def word_queries(words: DataFrame, vectors: DataFrame, mode: str = "nearest", k: int = 10,
                 word_col: str = "word") -> DataFrame:
    """Batch word queries — ``nearest`` (W2) or ``query`` (M3)."""
    if mode == "nearest":
        return near(words, vectors, k, True, word_col)
    if mode == "query":
        return lookup_vectors(words.select(word_col).distinct(), vectors, word_col)
    raise ValueError(f"unknown mode {mode!r}")
