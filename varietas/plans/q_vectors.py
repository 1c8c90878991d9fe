"""Registered queries: word vectors, neighbours, similarities, lexical alternatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.functions import dot, treebank_tokens
from varietas.operators import neighbours as N
from varietas.operators import vocab as V
from varietas.oracle import sql as S
from varietas.plans.registry import query
from varietas.sources import tables as T

_VEC = [S.DOC_LINES, S.doc_tokens_cte(), S.vectors_cte(), S.vec_norm_cte()]


def vectors(spark, sf_dir, maxtypes: int = 0):
    """Normalised vector table, stored once: several joins of a job read it."""
    from varietas.session import checkpoint
    return checkpoint(N.normalize_vectors(T.vector_table(spark, sf_dir), maxtypes))


def _qid(*cols):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


_NEAR_SQL = """
nb_pairs as (select q.qword as query, v.word, round(list_dot_product(qv.u, v.u), 6) as sim
             from q join vec_norm qv on qv.word = q.qword and qv.u is not null
             join vec_norm v on v.u is not null),
nb_{k} as (select query, word, sim, rn from (select *, row_number() over (partition by query order by sim desc, word desc) as rn
           from nb_pairs) where rn <= {k})"""


@query("read_vectors", S.with_(*_VEC) + """
select rank, word, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) as norm, len(u) as dim,
       round(u[1], 6) as u1 from vec_norm""")
def read_vectors_q(spark, sf_dir):
    """The vector table, L2-normalised (norm 1, first component shown)."""
    v = vectors(spark, sf_dir)
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("rank", "word", F.round(norm, 6).alias("norm"), F.size("u").alias("dim"),
                    F.round(F.col("u")[0], 6).alias("u1"))


@query("vectors_maxtypes", S.with_(*_VEC) + "select rank, word from vec_norm where rank < 100")
def vectors_maxtypes_q(spark, sf_dir):
    """Only the first ``maxtypes`` (100) vectors by frequency rank are loaded."""
    return vectors(spark, sf_dir, maxtypes=100).select("rank", "word")


_USER_WORDS = f"q as (select distinct unnest({S.tb_tokens()}) as qword from user_lines0)"


@query("near", S.with_(*_VEC, S.USER_LINES, _USER_WORDS, _NEAR_SQL.format(k=10)) + """
select query, rn, word, sim from nb_10""")
def near_q(spark, sf_dir):
    """10 nearest words (itself included) of every distinct user-turn token."""
    words = V.tokens_of(T.user_lines(spark, sf_dir)).select(F.col("tok").alias("word"))
    return N.near(words, vectors(spark, sf_dir), k=10)


@query("near_indexed", S.with_(*_VEC, S.USER_LINES, _USER_WORDS, _NEAR_SQL.format(k=10)) + """
select query, rn, word, sim from nb_10""")
def near_indexed_q(spark, sf_dir):
    """W2 / J2 through the vector index with every cell probed: the exact neighbours, so no vector is lost in the index."""
    from varietas.operators import vector_index as VI
    words = V.tokens_of(T.user_lines(spark, sf_dir)).select(F.col("tok").alias("word"))
    index = VI.build_index(vectors(spark, sf_dir))
    return VI.near_indexed(words, index, k=10, probes=index.cells)


@query("near_index_recall", S.with_(*_VEC, S.USER_LINES, _USER_WORDS, _NEAR_SQL.format(k=10)) + """
select count(*) as pairs, true as recall_of_09 from nb_10""")
def near_index_recall_q(spark, sf_dir):
    """Whether the index finds at least 0.9 of the exact 10 nearest words when three quarters of its cells are probed (these
    vectors have hardly any clusters; measured 0.94)."""
    from varietas.operators import vector_index as VI
    words = V.tokens_of(T.user_lines(spark, sf_dir)).select(F.col("tok").alias("word")).distinct()
    vec = vectors(spark, sf_dir)
    index = VI.build_index(vec)
    found = VI.near_indexed(words, index, k=10, probes=(3 * index.cells + 3) // 4)
    return VI.recall(found, N.near(words, vec, k=10)).select("pairs", (F.col("recall") >= 0.9).alias("recall_of_09"))


@query("near_vec", S.with_(*_VEC) + """,
qs as (select cast(vec_id as varchar) as qid, list_transform(embedding, lambda x: cast(x as double)) as qv from embeddings),
pairs as (select qs.qid, v.word, round(list_dot_product(qs.qv, v.u), 6) as sim from qs join vec_norm v on v.u is not null)
select qid, rn, word, sim from (select *, row_number() over (partition by qid order by sim desc, word desc) as rn
from pairs) where rn <= 10""")
def near_vec_q(spark, sf_dir):
    """10 nearest words of each raw (un-normalised) embedding row."""
    emb = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return N.near_vec(emb, vectors(spark, sf_dir), k=10)


_PAIRS = f"""tp as (select distinct t[i] as w1, t[i + 1] as w2
       from (select {S.tb_tokens()} as t from user_lines0), lateral (select unnest(range(1, len(t))) as i))"""


@query("pair_sim", S.with_(*_VEC, S.USER_LINES, _PAIRS) + """
select w1, w2, round(list_dot_product(a.u, b.u), 6) as sim
from tp left join vec_norm a on a.word = tp.w1 left join vec_norm b on b.word = tp.w2""")
def pair_sim_q(spark, sf_dir):
    """M2: similarity of every distinct pair of adjacent user-turn tokens (NULL if a word is unknown)."""
    toks = T.user_lines(spark, sf_dir).select(treebank_tokens(F.col("text")).alias("t"))
    pairs = (toks.select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))),
                                                F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))))).alias("p"))
             .select(F.col("p.0").alias("w1"), F.col("p.1").alias("w2")).distinct())
    return N.pair_sim(pairs, vectors(spark, sf_dir))


@query("lookup_vectors", S.with_(*_VEC, S.USER_LINES, _USER_WORDS) + """
select q.qword as word, case when v.u is not null then q.qword || ' ' ||
       array_to_string(list_transform(v.u, lambda x: printf('%.6f', x)), ' ') end as line
from q left join vec_norm v on v.word = q.qword""")
def lookup_vectors_q(spark, sf_dir):
    """M3 / P6 ``query`` mode: ``word v1 v2 ...`` for every distinct user-turn token (NULL if unknown)."""
    words = V.tokens_of(T.user_lines(spark, sf_dir)).select(F.col("tok").alias("word"))
    return N.word_queries(words, vectors(spark, sf_dir), mode="query")


_LEX = S.with_(*_VEC, S.USER_LINES, f"""
q0 as (select conv_id || ':' || turn || ':' || line_no as qid, {S.tb_tokens()} as toks from user_lines0)""", """
lq as (select qid, toks[1] as target, toks[2:] as context from q0 where len(toks) > 0)""",
               "q as (select distinct target as qword from lq)", _NEAR_SQL.format(k=100), """
cand as (select lq.qid, nb.rn, nb.word, nb.sim from lq join nb_100 nb on nb.query = lq.target),
ctx as (select qid, generate_subscripts(context, 1) - 1 as widx, unnest(context) as cword from lq),
kctx as (select ctx.qid, ctx.widx, v.u as cu from ctx join vec_norm v on v.word = ctx.cword),
pairs as (select cand.qid, cand.word, kctx.widx, round(list_dot_product(kctx.cu, vw.u), 6) as sc
          from cand join kctx on kctx.qid = cand.qid join vec_norm vw on vw.word = cand.word),
facs as (select qid, word, list({factor} order by widx) as fs from pairs group by qid, word),
scored as (select cand.qid, cand.rn, cand.word,
           round(list_reduce(list_prepend(cand.sim, coalesce(fs, []::double[])), lambda a, b: a * b), 6) as score
           from cand left join facs on facs.qid = cand.qid and facs.word = cand.word)
select qid, rn, word, score from (select qid, word, score,
  row_number() over (partition by qid order by score desc nulls last, rn) as rn from scored) where rn <= 10""")


@query("lex_alternatives", _LEX.replace("{factor}", "case when sc >= 0 then pow(sc, 1.0 / (widx + 2)) end"))
def lex_alternatives_q(spark, sf_dir):
    """First token of each user line = target, the rest = context; 100 neighbours
    re-scored with the distance-weighted product (the command-line behaviour), 10 kept."""
    toks = T.user_lines(spark, sf_dir).select(_qid("conv_id", "turn", "line_no").alias("qid"),
                                              treebank_tokens(F.col("text")).alias("t"))
    q = toks.where(F.size("t") > 0).select("qid", F.col("t")[0].alias("target"),
                                           F.slice("t", 2, 1 << 30).alias("context"))
    return N.lex_alternatives(q, vectors(spark, sf_dir), dist_flag=True, num_alts=10)


@query("lex_alternatives_plain", _LEX.replace("{factor}", "sc"))
def lex_alternatives_plain_q(spark, sf_dir):
    """W4 with ``dist_flag=False`` (the API default): plain product of context similarities."""
    toks = T.user_lines(spark, sf_dir).select(_qid("conv_id", "turn", "line_no").alias("qid"),
                                              treebank_tokens(F.col("text")).alias("t"))
    q = toks.where(F.size("t") > 0).select("qid", F.col("t")[0].alias("target"),
                                           F.slice("t", 2, 1 << 30).alias("context"))
    return N.lex_alternatives(q, vectors(spark, sf_dir), dist_flag=False, num_alts=10)


@query("stream_word_queries", S.with_(*_VEC, S.USER_LINES, _USER_WORDS, _NEAR_SQL.format(k=10),
                                         f"asked as (select unnest({S.tb_tokens()}) as qword from user_lines0)") + """
select query, rn, word, sim from asked join nb_10 on nb_10.query = asked.qword""")
def stream_word_queries_q(spark, sf_dir):
    """ST3 / P6: the user-turn tokens streamed as word-query files (one file per micro-batch), every one of
    them answered with its 10 nearest words."""
    from varietas.streaming.interactive import serve_lines, word_query_service
    words = V.tokens_of(T.user_lines(spark, sf_dir)).select(F.col("tok").alias("text"))
    out = serve_lines(spark, words, word_query_service(vectors(spark, sf_dir), "nearest", 10))
    return out.select("query", "rn", "word", "sim")


_LEX_STREAM = _LEX.replace("select qid, rn, word, score from (select", """,
answers as (select qid, rn, word, score from (select""", 1).rstrip() + """)
select u.text as line, rn, word, score from answers
join user_lines0 u on u.conv_id || ':' || u.turn || ':' || u.line_no = answers.qid"""


@query("stream_lex_alternatives", _LEX_STREAM.replace("{factor}", "case when sc >= 0 then pow(sc, 1.0 / (widx + 2)) end"))
def stream_lex_alternatives_q(spark, sf_dir):
    """ST1 / P5: user lines streamed as files; every line, repeated ones too, gets 10 lexical alternatives."""
    from varietas.streaming.interactive import lex_alternatives_service, serve_lines
    out = serve_lines(spark, T.user_lines(spark, sf_dir), lex_alternatives_service(vectors(spark, sf_dir)))
    return out.select(F.col("text").alias("line"), "rn", "word", "score")


@query("vectors_file_roundtrip", S.with_(*_VEC) + """
select word, round(list_dot_product(u, u), 6) as norm2, round(u[1], 6) as u1 from vec_norm""")
def vectors_file_roundtrip_q(spark, sf_dir):
    """The vector table written in word2vec text format (header line, then ``word f1 ... fd``),
    read back with ``read_vectors`` and normalised."""
    from varietas.sources import files
    from varietas.streaming.interactive import scratch_dir
    raw = T.vector_table(spark, sf_dir)
    path = scratch_dir(spark, "w2v")
    files.write_vectors(raw, path)
    back = N.normalize_vectors(files.read_vectors(spark, path))
    return back.select("word", F.round(dot(F.col("u"), F.col("u")), 6).alias("norm2"), F.round(F.col("u")[0], 6).alias("u1"))
