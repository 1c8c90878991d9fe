"""Registered queries: prefix partitions, splits, chunks and learning curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.operators import rows as R
from varietas.oracle import lm_sql as LS
from varietas.oracle import sql as S
from varietas.plans import experiments as X
from varietas.plans.registry import query
from varietas.sources import tables as T

NP, MAX_P, ORDER, CHUNK = 100, 100, 3, 64
_U = [S.USER_LINES, S.USER_ORDERED, "nn as (select count(*) as n from user_lines)"]


@query("prefix_partitions", S.with_(*_U) + f"""
select sent_id, (sent_id * {NP} + n - 1) // n as p from user_lines, nn""")
def prefix_partitions_q(spark, sf_dir):
    """First nested prefix (of 100) containing each user line."""
    return R.prefix_partitions(T.ordered_user_lines(spark, sf_dir), NP, MAX_P, "sent_id").select("sent_id", "p")


@query("tail_split", S.with_(*_U) + """
select sent_id, sent_id > n - floor(0.1 * n) as is_dev from user_lines, nn""")
def tail_split_q(spark, sf_dir):
    """The last int(0.1 n) user lines form the dev set."""
    lines = T.ordered_user_lines(spark, sf_dir)
    train, dev = R.tail_split(lines, 0.1, "sent_id")
    return (train.select("sent_id", F.lit(False).alias("is_dev"))
            .unionByName(dev.select("sent_id", F.lit(True).alias("is_dev"))))


@query("chunks", S.with_(*_U) + f"select sent_id, (sent_id - 1) // {CHUNK} as chunk_id from user_lines")
def chunks_q(spark, sf_dir):
    """User lines in chunks of 64 (files 000.txt, 001.txt ...)."""
    return R.chunk_ids(T.ordered_user_lines(spark, sf_dir), CHUNK, "sent_id").select("sent_id", "chunk_id")


@query("prefix_lines", S.with_(S.GEN_LINES, S.GEN_ORDERED) + """
select sent_id from gen_lines where sent_id <= 128""")
def prefix_lines_q(spark, sf_dir):
    """The first (i+1)*64 = 128 generated lines (``head -128``)."""
    return R.prefix_lines(T.ordered_generated_lines(spark, sf_dir), 128, "sent_id").select("sent_id")


@query("shuffle", S.with_(*_U) + """
select sent_id, row_number() over (order by md5('7:' || sent_id), sent_id) as shuffled_rank from user_lines""")
def shuffle_q(spark, sf_dir):
    """Reproducible shuffle of the user lines (seed 7)."""
    lines = T.ordered_user_lines(spark, sf_dir)
    return R.shuffle(lines, seed=7, key="sent_id").select("sent_id", "shuffled_rank")


_PPL = S.with_(*_U, S.DEV_LINES, S.DEV_ORDERED, f"""
pref as (select i from range(1, {min(NP, MAX_P)} + 1) t(i))""", """
tl as (select i, text from user_lines, nn, pref where sent_id <= (n * i) // """ + str(NP) + ")",
               f"cnt_ev as ({LS.events_sql('tl', ORDER, LS.ws_tokens('text'), keep='i')})",
               "cnt as (select i, ord, h, w, count(*) as c from cnt_ev group by i, ord, h, w)",
               "ctx as (select i, ord, h, sum(c) as ch, count(*) as th from cnt group by i, ord, h)",
               "vocab as (select distinct w from cnt where ord = 1 union select '</s>' union select '<unk>')",
               "vsize as (select count(*) * 1.0 as nv from vocab)",
               *LS.dev_events_ctes("dev_lines", ORDER),
               f"sc as ({LS.recursion_score_sql(ORDER, by_i='pref')})")


@query("ppl_curve", _PPL + """
select i, round(pow(10, -sum(log10p) / count(*)), 6) as ppl, count(*) as n_words from sc group by i""")
def ppl_curve_q(spark, sf_dir):
    """X1 (C1): benchmark perplexity of Witten–Bell order-3 models of user-turn prefixes 1%..100%,
    one pass over the training lines instead of 100 trainings."""
    c = X.ppl_curve(T.ordered_user_lines(spark, sf_dir), T.ordered_dev_lines(spark, sf_dir), NP, MAX_P, ORDER)
    return c.select("i", F.round("ppl", 6).alias("ppl"), "n_words")


_OOV = S.with_(*_U, S.DEV_LINES, S.GEN_LINES, S.GEN_ORDERED, f"""
ch as (select (sent_id - 1) // {CHUNK} as chunk_id, text from user_lines)""", """
fl as (select chunk_id as i, count(*) as flen from ch group by chunk_id)""", f"""
tt as (select distinct f.i, unnest({S.tb_tokens()}) as tok from ch join fl f on ch.chunk_id <= f.i)""", f"""
gt as (select distinct f.i, unnest({S.tb_tokens('g.text')}) as tok from gen_lines g join fl f on g.sent_id <= (f.i + 1) * f.flen)""",
               f"dt as (select unnest({S.tb_tokens()}) as tok from dev_lines0)")


@query("oov_curve", _OOV + """,
v as (select i, tok from tt)
select fl.i, (select count(*) from v where v.i = fl.i) as types,
       (select count(*) from dt where dt.tok not in (select tok from v where v.i = fl.i)) as oovs from fl""")
def oov_curve_q(spark, sf_dir):
    """Types and dev OOV tokens for cumulative chunks of 64 user lines."""
    ch = R.chunk_ids(T.ordered_user_lines(spark, sf_dir), CHUNK, "sent_id")
    return X.oov_curve(ch, T.dev_lines(spark, sf_dir))


@query("oov_curve_generated", _OOV + """,
v as (select i, tok from tt union select i, tok from gt)
select fl.i, (select count(*) from v where v.i = fl.i) as types,
       (select count(*) from dt where dt.tok not in (select tok from v where v.i = fl.i)) as oovs from fl""")
def oov_curve_generated_q(spark, sf_dir):
    """X2 with automatic variety: each prefix i also gets the first (i+1)*len(chunk i) generated lines."""
    ch = R.chunk_ids(T.ordered_user_lines(spark, sf_dir), CHUNK, "sent_id")
    return X.oov_curve(ch, T.dev_lines(spark, sf_dir), T.ordered_generated_lines(spark, sf_dir))


_EVAL = S.with_(*_U, S.DEV_LINES, S.DEV_ORDERED, f"""
tl as (select (sent_id - 1) // {CHUNK} as i, text from user_lines)""",
                f"cnt_ev as ({LS.events_sql('tl', ORDER, LS.ws_tokens('text'), keep='i')})",
                "cnt as (select i, ord, h, w, count(*) as c from cnt_ev group by i, ord, h, w)",
                "ctx as (select i, ord, h, sum(c) as ch, count(*) as th from cnt group by i, ord, h)",
                "pref as (select distinct i from tl)",
                "vocab as (select distinct w from cnt where ord = 1 union select '</s>' union select '<unk>')",
                "vsize as (select count(*) * 1.0 as nv from vocab)",
                *LS.dev_events_ctes("dev_lines", ORDER),
                f"sc as ({LS.recursion_score_sql(ORDER, by_i='pref')})")


def _stored_models(spark, sf_dir, method):
    """A store with one model per chunk of 64 user lines, all over the vocabulary of all chunks."""
    from varietas.operators import lm as L
    from varietas.operators import ngrams as G
    from varietas.sources import models as M
    from varietas.streaming.interactive import scratch_dir
    root = scratch_dir(spark, "models")
    ch = R.chunk_ids(T.ordered_user_lines(spark, sf_dir), CHUNK, "sent_id")
    ev = G.ngram_events(ch, ORDER, keep=["chunk_id"])
    counts = ev.groupBy(F.col("chunk_id").cast("string").alias("model_id"), "ord", "h", "w").agg(F.count(F.lit(1)).alias("c"))
    M.save_counts(counts, root, ORDER, grouped=True)
    counts = M.load_counts(spark, root, grouped=True)
    M.save_models(L.build_lm(counts, ORDER, method, discount_fallback=True, vocab=L.vocabulary(counts), by=("model_id",)), root, grouped=True)
    return root


def _evaluated(spark, sf_dir, method):
    from varietas.operators import lm as L
    from varietas.sources import models as M
    out = L.score_models(M.load_models(spark, _stored_models(spark, sf_dir, method), grouped=True), T.ordered_dev_lines(spark, sf_dir))
    return out.select(F.col("model_id").cast("long").alias("model_id"), F.round("ppl", 6).alias("ppl"), "n_words")


@query("evaluate_models", _EVAL + """
select i as model_id, round(pow(10, -sum(log10p) / count(*)), 6) as ppl, count(*) as n_words from sc group by i""")
def evaluate_models_q(spark, sf_dir):
    """Witten–Bell models of the chunks of 64 user lines, built from stored counts, stored by
    model_id, read back and evaluated on the benchmark lines in one job."""
    return _evaluated(spark, sf_dir, "witten_bell")


@query("evaluate_models_kneser_ney", S.with_(*_U, S.DEV_LINES, S.DEV_ORDERED, f"""
tl as (select (sent_id - 1) // {CHUNK} as i, text from user_lines)""", "pref as (select distinct i from tl)", *LS.kn_curve_sql(ORDER)) + """
select i as model_id, round(pow(10, -sum(log10p) / count(*)), 6) as ppl, count(*) as n_words from sc group by i""")
def evaluate_models_kneser_ney_q(spark, sf_dir):
    """X6 with the experiments' trainer (Kneser–Ney, discount fallback), from the model store."""
    return _evaluated(spark, sf_dir, "kneser_ney")


@query("list_models", S.with_(*_U) + f"select distinct (sent_id - 1) // {CHUNK} as model_id, 3 as ord, 'witten_bell' as method from user_lines")
def list_models_q(spark, sf_dir):
    """Ids, order and method of the stored models."""
    from varietas.sources import models as M
    found = M.list_models(spark, _stored_models(spark, sf_dir, "witten_bell"), "^[0-9]+$", "lm", grouped=True)
    return found.select(F.col("model_id").cast("long").alias("model_id"), "ord", "method")


_STEPS = [S.USER_LINES, S.GEN_LINES, S.DEV_LINES, S.DEV_ORDERED,
          "cand as (select distinct regexp_replace(text, ' +$', '') as line from gen_lines0)",
          "ranked as (select line, row_number() over (order by md5('3:' || line), line) as p from cand where length(line) > 0)",
          "pref as (select unnest(range(0, (select count(*) from ranked) + 1)) as i)",
          "tl as (select i, text from user_lines0, pref union all select i, line from ranked, pref where p <= i)"]
_X5 = S.with_(*_STEPS, f"cnt_ev as ({LS.events_sql('tl', ORDER, LS.ws_tokens('text'), keep='i')})",
              "cnt as (select i, ord, h, w, count(*) as c from cnt_ev group by i, ord, h, w)",
              "ctx as (select i, ord, h, sum(c) as ch, count(*) as th from cnt group by i, ord, h)",
              "vocab as (select distinct w from cnt where ord = 1 union select '</s>' union select '<unk>')",
              "vsize as (select count(*) * 1.0 as nv from vocab)",
              *LS.dev_events_ctes("dev_lines", ORDER), f"sc as ({LS.recursion_score_sql(ORDER, by_i='pref')})")
_CURVE = """
select i, round(pow(10, -sum(log10p) / count(*)), 6) as ppl, count(*) as n_words from sc group by i"""


@query("cumulative_paraphrase_curve", _X5 + _CURVE)
def cumulative_paraphrase_curve_q(spark, sf_dir):
    """Generated lines, deduplicated and shuffled (seed 3), added one by one to the user
    turns; benchmark perplexity after each addition.  One pass; the oracle retrains every step."""
    c = X.cumulative_paraphrase_curve(T.user_lines(spark, sf_dir), T.generated_lines(spark, sf_dir),
                                      T.ordered_dev_lines(spark, sf_dir), seed=3, order=ORDER)
    return c.select("i", F.round("ppl", 6).alias("ppl"), "n_words")


def _x4_sql(order=ORDER):
    parts = [S.USER_LINES, S.GEN_LINES, S.DEV_LINES, S.DEV_ORDERED,
             f"bev as ({LS.events_sql('user_lines0', order, LS.ws_tokens('text'))})",
             "bcnt as (select ord, h, w, count(*) as c from bev group by ord, h, w)",
             "bctx as (select ord, h, sum(c) as C, count(*) as T from bcnt group by ord, h)",
             "cand as (select conv_id || ':' || turn || ':' || line_no as cand_id, text from gen_lines0)",
             f"cev as ({LS.events_sql('cand', order, LS.ws_tokens('text'), keep='cand_id')})",
             "ccnt as (select cand_id, ord, h, w, count(*) as e from cev group by cand_id, ord, h, w)",
             "cnew as (select cand_id, ord, h, count(*) as N from ccnt where not exists (select 1 from bcnt b "
             "where b.ord = ccnt.ord and b.h = ccnt.h and b.w = ccnt.w) group by cand_id, ord, h)",
             "cctx as (select c.cand_id, c.ord, c.h, sum(c.e) as E from ccnt c group by c.cand_id, c.ord, c.h)",
             "vocab as (select w from bcnt where ord = 1 union select w from ccnt where ord = 1 "
             "union select '</s>' union select '<unk>')",
             "vsize as (select count(*) * 1.0 as nv from vocab)",
             *LS.dev_events_ctes("dev_lines", order)]
    joins, expr = [], "(1.0 / (select nv from vsize))"
    for m in range(1, order + 1):
        joins.append(f"""left join bcnt b{m} on b{m}.ord = {m} and b{m}.h = e.h{m} and b{m}.w = e.w
  left join bctx x{m} on x{m}.ord = {m} and x{m}.h = e.h{m}
  left join ccnt d{m} on d{m}.cand_id = g.cand_id and d{m}.ord = {m} and d{m}.h = e.h{m} and d{m}.w = e.w
  left join cctx y{m} on y{m}.cand_id = g.cand_id and y{m}.ord = {m} and y{m}.h = e.h{m}
  left join cnew z{m} on z{m}.cand_id = g.cand_id and z{m}.ord = {m} and z{m}.h = e.h{m}""")
        cm = f"(coalesce(b{m}.c, 0) + coalesce(d{m}.e, 0))"
        Cm = f"(coalesce(x{m}.C, 0) + coalesce(y{m}.E, 0))"
        Tm = f"(coalesce(x{m}.T, 0) + coalesce(z{m}.N, 0))"
        expr = (f"case when e.h{m} is null or {Cm} = 0 then ({expr}) else ({cm} + {Tm} * ({expr})) / "
                f"({Cm} + {Tm}) end")
    parts.append(f"""sc as (select g.cand_id, log10({expr}) as lp
  from (select distinct cand_id from cand) g cross join dev_ev e {' '.join(joins)})""")
    base_joins, bexpr = [], "(1.0 / (select nv from vsize))"
    for m in range(1, order + 1):
        base_joins.append(f"left join bcnt b{m} on b{m}.ord = {m} and b{m}.h = e.h{m} and b{m}.w = e.w "
                          f"left join bctx x{m} on x{m}.ord = {m} and x{m}.h = e.h{m}")
        bexpr = (f"case when e.h{m} is null or coalesce(x{m}.C, 0) = 0 then ({bexpr}) else "
                 f"(coalesce(b{m}.c, 0) + x{m}.T * ({bexpr})) / (x{m}.C + x{m}.T) end")
    parts.append(f"bsc as (select log10({bexpr}) as lp from dev_ev e {' '.join(base_joins)})")
    parts.append("bppl as (select pow(10, -sum(lp) / count(*)) as ppl from bsc)")
    return S.with_(*parts) + """
select cand_id, round(pow(10, -sum(lp) / count(*)), 6) as ppl, pow(10, -sum(lp) / count(*)) < (select ppl from bppl) as effective
from sc group by cand_id"""


@query("effective_paraphrases", _x4_sql())
def effective_paraphrases_q(spark, sf_dir):
    """Benchmark perplexity of (user turns + one generated line) for every generated line,
    and whether it beats the user turns' own perplexity — without training a model per candidate."""
    cands = T.generated_lines(spark, sf_dir).select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("conv_id", "turn", "line_no")]).alias("cand_id"), "text")
    out = X.effective_paraphrases(T.user_lines(spark, sf_dir), cands, T.ordered_dev_lines(spark, sf_dir), order=ORDER)
    return out.select("cand_id", F.round("ppl", 6).alias("ppl"), "effective")


@query("effective_paraphrases_kneser_ney", S.with_(
    S.USER_LINES, S.GEN_LINES, S.DEV_LINES, S.DEV_ORDERED,
    "cand as (select conv_id || ':' || turn || ':' || line_no as cand_id, text from gen_lines0)",
    "pref as (select cand_id as i from cand union all select 'base'), ptext as (select cand_id as i, text from cand)",
    "tl as (select i, text from pref, (select text from user_lines0) union all select i, text from ptext)",
    *LS.kn_curve_sql(ORDER), "res as (select i, pow(10, -sum(log10p) / count(*)) as ppl from sc group by i)") + """
select i as cand_id, round(ppl, 6) as ppl, round(ppl, 9) < (select round(ppl, 9) from res where i = 'base') as effective from res where i <> 'base'""")
def effective_paraphrases_kneser_ney_q(spark, sf_dir):
    """X4 with the experiments' trainer (Kneser–Ney, discount fallback): every generated line added alone to the
    user turns; the oracle retrains each model."""
    cands = T.generated_lines(spark, sf_dir).select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("conv_id", "turn", "line_no")]).alias("cand_id"), "text")
    out = X.effective_paraphrases(T.user_lines(spark, sf_dir), cands, T.ordered_dev_lines(spark, sf_dir), order=ORDER, method="kneser_ney")
    return out.select("cand_id", F.round("ppl", 6).alias("ppl"), "effective")


@query("effective_summary", _x4_sql().replace("""
select cand_id, round(""", """, eff as (
select cand_id, round(""", 1) + """)
select count(*) as processed, count(*) filter (where effective) as effective from eff""")
def effective_summary_q(spark, sf_dir):
    """How many candidates were processed and how many are effective."""
    cands = T.generated_lines(spark, sf_dir).select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("conv_id", "turn", "line_no")]).alias("cand_id"), "text")
    return X.effective_summary(X.effective_paraphrases(T.user_lines(spark, sf_dir), cands, T.ordered_dev_lines(spark, sf_dir), order=ORDER))


def _awer_inputs(spark, sf_dir):
    from varietas.operators import vocab as V
    ch = R.chunk_ids(T.ordered_user_lines(spark, sf_dir), CHUNK, "sent_id")
    uni = V.unigrams(V.tokens_of(T.user_lines(spark, sf_dir)))
    return ch, T.ordered_dev_lines(spark, sf_dir), uni


def _awer_curve_sql(generated: bool) -> str:
    from varietas.oracle import decode_sql as DS
    from varietas.plans import q_paraphrase as Q
    more = " union all select f.i, 'g' || g.sent_id as lid, g.text from gen_lines g join fl f on g.sent_id <= (f.i + 1) * f.flen" if generated else ""
    train = [f"ch as (select (sent_id - 1) // {CHUNK} as chunk_id, sent_id, text from user_lines)",
             "fl as (select chunk_id as i, count(*) as flen from ch group by chunk_id)",
             *([S.GEN_LINES, S.GEN_ORDERED] if generated else []),
             f"tl as (select f.i, 'b' || ch.sent_id as lid, text from ch join fl f on ch.chunk_id <= f.i{more})",
             f"rt as (select i, lid, generate_subscripts(t, 1) as pos, unnest(t) as tok from (select i, lid, {LS.ws_tokens('text')} as t from tl))",
             "rc as (select i, tok, count(*) as c from rt group by i, tok)",
             "lb as (select rt.i, lid, pos, case when c > 1 then rt.tok else '<unk>' end as t from rt join rc on rc.i = rt.i and rc.tok = rt.tok)",
             "rl as (select i, list(t order by pos) as t from lb group by i, lid)",
             "lmv as (select distinct i, t as w from lb union select i, unnest(['</s>', '<unk>']) from fl)",
             f"cnt_ev as ({LS.events_sql('rl', ORDER, 't', keep='i')})", "cnt as (select i, ord, h, w, count(*) as c from cnt_ev group by i, ord, h, w)"]
    slots = """slots as (select fl.i, sent_id, pos, coalesce(lmv.w, '<unk>') as word, 0.0::double as cost
    from dk cross join fl left join lmv on lmv.i = fl.i and lmv.w = dk.word
  union all select lmv.i, sent_id, pos, alt, 0.0 from da join lmv on lmv.w = alt where alt <> word)"""
    return S.recursive(*Q._draws_sql(*train), slots, *DS.decode_ctes(1, by="i")) + f"""
select fl.i, round(avg({DS.error_rate('ws', 'sent')}), 9) as awer, count(*) as n_lines
from dev_lines cross join fl left join dw on dw.sent_id = dev_lines.sent_id
left join best on best.sent_id = dev_lines.sent_id and best.i = fl.i group by fl.i"""


@query("awer_curve", _awer_curve_sql(False))
def awer_curve_q(spark, sf_dir):
    """Benchmark AWER under the LM (rare → <unk>, Witten–Bell order 3) of every cumulative chunk
    prefix of the user turns, all prefixes from one table of signed events; the oracle retrains every prefix."""
    ch, dev, uni = _awer_inputs(spark, sf_dir)
    return X.awer_curve(ch, dev, uni, seed=11).select("i", F.round("awer", 9).alias("awer"), "n_lines")


@query("awer_curve_generated", _awer_curve_sql(True))
def awer_curve_generated_q(spark, sf_dir):
    """X3 with automatic variety: prefix i also holds the first (i+1)*len(chunk i) generated lines."""
    ch, dev, uni = _awer_inputs(spark, sf_dir)
    out = X.awer_curve(ch, dev, uni, seed=11, generated=T.ordered_generated_lines(spark, sf_dir))
    return out.select("i", F.round("awer", 9).alias("awer"), "n_lines")


_PPL_KN = S.with_(*_U, S.DEV_LINES, S.DEV_ORDERED, f"""
pref as (select i from range(1, {min(NP, MAX_P)} + 1) t(i))""", """
tl as (select i, text from user_lines, nn, pref where sent_id <= (n * i) // """ + str(NP) + ")",
                  *LS.kn_curve_sql(ORDER))


@query("ppl_curve_kneser_ney", _PPL_KN + """
select i, round(pow(10, -sum(log10p) / count(*)), 6) as ppl, count(*) as n_words from sc group by i""")
def ppl_curve_kneser_ney_q(spark, sf_dir):
    """X1 with the experiments' trainer: interpolated modified Kneser–Ney (order 3, discount
    fallback) on user-turn prefixes 1%..100%, one pass; the oracle retrains every prefix."""
    c = X.ppl_curve(T.ordered_user_lines(spark, sf_dir), T.ordered_dev_lines(spark, sf_dir), NP, MAX_P, ORDER,
                    method="kneser_ney")
    return c.select("i", F.round("ppl", 6).alias("ppl"), "n_words")


@query("cumulative_paraphrase_curve_kneser_ney", S.with_(
    *_STEPS, "steps as (select 0 as p, text from user_lines0 union all select p, line from ranked)", *LS.kn_steps_sql(ORDER)) + """
select i, round(pow(10, -sum(log10p * mult) / sum(mult)), 6) as ppl, sum(mult)::bigint as n_words from sc group by i""")
def cumulative_paraphrase_curve_kneser_ney_q(spark, sf_dir):
    """X5 with the experiments' trainer (Kneser–Ney, discount fallback): generated lines added one by
    one to the user turns, benchmark perplexity after each; the oracle uses running counts and as-of joins."""
    c = X.cumulative_paraphrase_curve(T.user_lines(spark, sf_dir), T.generated_lines(spark, sf_dir),
                                      T.ordered_dev_lines(spark, sf_dir), seed=3, order=ORDER, method="kneser_ney")
    return c.select("i", F.round("ppl", 6).alias("ppl"), "n_words")
