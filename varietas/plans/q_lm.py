"""Registered queries: n-gram counts, smoothed models, scoring, perplexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.operators import lm as L
from varietas.operators import ngrams as G
from varietas.operators import vocab as V
from varietas.oracle import lm_sql as LS
from varietas.oracle import sql as S
from varietas.plans.registry import query
from varietas.sources import tables as T

ORDER = 3
_USER = [S.USER_LINES]
_USER_TOKS = LS.ws_tokens("text")


def _counts(spark, sf_dir, order=ORDER):
    return G.ngram_counts(T.user_lines(spark, sf_dir), order)


def _cnt_sql(order=ORDER):
    return _USER + LS.counts_ctes("user_lines0", order, _USER_TOKS)


@query("ngram_counts", S.with_(*_cnt_sql()) + "select ord, h, w, c from cnt")
def ngram_counts_q(spark, sf_dir):
    """Counts of orders 1..3 over the user turns (whitespace tokens, <s> ... </s>)."""
    return _counts(spark, sf_dir)


@query("ngram_counts_o4", S.with_(*_cnt_sql(4)) + "select ord, h, w, c from cnt")
def ngram_counts_o4_q(spark, sf_dir):
    """A7 at order 4 (the shipped model's order)."""
    return _counts(spark, sf_dir, 4)


@query("count_of_counts", S.with_(*_cnt_sql()) + "select ord, c, count(*) as n from cnt group by ord, c")
def count_of_counts_q(spark, sf_dir):
    """Number of n-grams per (order, count)."""
    return G.count_of_counts(_counts(spark, sf_dir))


@query("context_stats", S.with_(*_cnt_sql()) + """
select ord, h, sum(c) as c_h, count(*) as t_h, count(*) filter (where c = 1) as n1,
       count(*) filter (where c = 2) as n2, count(*) filter (where c >= 3) as n3p from cnt group by ord, h""")
def context_stats_q(spark, sf_dir):
    """A10: per history: total count, continuation types, and types seen once / twice / 3+ times."""
    return G.context_stats(_counts(spark, sf_dir))


@query("merge_counts", S.with_(S.USER_LINES, S.GEN_LINES,
                               *LS.counts_ctes("user_lines0", ORDER, _USER_TOKS, "cu"),
                               *LS.counts_ctes("gen_lines0", ORDER, _USER_TOKS, "cg")) + """
select ord, h, w, sum(c) as c from (select * from cu union all select * from cg) group by ord, h, w""")
def merge_counts_q(spark, sf_dir):
    """Counts of user turns and of generated turns, merged by summation."""
    return G.merge_counts(_counts(spark, sf_dir), G.ngram_counts(T.generated_lines(spark, sf_dir), ORDER))


@query("shard_by_context", S.with_(*_cnt_sql()) + """
select ord, h, w, c, case when coalesce(nullif(split_part(h, ' ', 1), ''), w) >= 'p' then 2
                          when coalesce(nullif(split_part(h, ' ', 1), ''), w) >= 'h' then 1 else 0 end as shard from cnt""")
def shard_by_context_q(spark, sf_dir):
    """N-gram counts split into three shards by the first context word (boundaries 'h', 'p')."""
    return G.shard_by_context(_counts(spark, sf_dir), ["h", "p"])


_RARE_LINES = [S.USER_LINES, S.USER_ORDERED, f"""
rt as (select sent_id, generate_subscripts(t, 1) as pos, unnest(t) as tok
       from (select sent_id, {LS.ws_tokens('text')} as t from user_lines))""",
               "rc as (select tok, count(*) as c from rt group by tok)", """
rare as (select sent_id, string_agg(case when c > 1 then rt.tok else '<unk>' end, ' ' order by pos) as text
         from rt join rc using (tok) group by sent_id)"""]


@query("ngram_counts_skip", S.with_(*_RARE_LINES, *LS.counts_ctes(
    "rare", ORDER, f"list_filter({LS.ws_tokens('text')}, lambda x: x not in ('<s>', '</s>', '<unk>'))")) +
       "select ord, h, w, c from cnt")
def ngram_counts_skip_q(spark, sf_dir):
    """Counts of the rare-replaced user turns with reserved symbols (<unk>) skipped."""
    rare = V.replace_rare(T.ordered_user_lines(spark, sf_dir), 1)
    return G.ngram_counts(rare, ORDER, skip_symbols=True)


def _model_q(method, **kw):
    def run(spark, sf_dir):
        m = L.build_lm(_counts(spark, sf_dir), ORDER, method, **kw)
        return m.weighted().select("ord", "h", "w", F.round("p", 9).alias("p"), F.round("g", 9).alias("g"))
    return run


def _model_sql(method, **kw):
    return S.with_(*_cnt_sql(), *LS.model_ctes(ORDER, method, **kw)) + \
        "select ord, h, w, round(p, 9) as p, round(g, 9) as g from probs"


for _m, _doc in [("witten_bell", "L1: Witten–Bell (k=1) probabilities of every seen n-gram and the weight of its history."),
                 ("unsmoothed", "L2: maximum-likelihood c(hw)/c(h)."),
                 ("absolute", "L3: absolute discounting, D = n1/(n1+2 n2) per order."),
                 ("kneser_ney", "L5: interpolated modified Kneser–Ney with discount fallback."),
                 ("katz", "L4: Katz backoff with Good–Turing discounts for counts ≤ 5.")]:
    kw = {"discount_fallback": True} if _m == "kneser_ney" else {}
    _f = _model_q(_m, **kw)
    _f.__doc__ = _doc
    query(f"lm_{_m}", _model_sql(_m, **kw))(_f)


_abs_bins = _model_q("absolute", bins=3)
_abs_bins.__doc__ = "L3 with three discounts: counts 1, 2 and from 3 on take discounts of their own."
query("lm_absolute_bins", _model_sql("absolute", bins=3))(_abs_bins)


def _wb_model(spark, sf_dir):
    return L.build_lm(_counts(spark, sf_dir), ORDER, "witten_bell")


_SCORE = [*_cnt_sql(), *LS.model_ctes(ORDER, "witten_bell"), S.DEV_LINES, S.DEV_ORDERED,
          *LS.dev_events_ctes("dev_lines", ORDER), f"sc as ({LS.recursion_score_sql(ORDER)})"]


@query("score_dev", S.with_(*_SCORE) + "select sent_id, pos, w, round(log10p, 9) as log10p, oov from sc")
def score_dev_q(spark, sf_dir):
    """log10 p of every benchmark word and </s> under the Witten–Bell model of the user turns."""
    sc = L.score(T.ordered_dev_lines(spark, sf_dir), _wb_model(spark, sf_dir))
    return sc.select("sent_id", "pos", "w", F.round("log10p", 9).alias("log10p"), "oov")


@query("perplexity_dev", S.with_(*_SCORE) + """
select round(pow(10, -sum(log10p) / count(log10p)), 6) as ppl, count(log10p) as n_words,
       count(*) - count(log10p) as n_zero, sum(oov::int) as n_oov from sc""")
def perplexity_dev_q(spark, sf_dir):
    """Dev perplexity, unknown words and </s> included."""
    p = L.perplexity(L.score(T.ordered_dev_lines(spark, sf_dir), _wb_model(spark, sf_dir)))
    return p.select(F.round("ppl", 6).alias("ppl"), "n_words", "n_zero", "n_oov")


@query("sentence_perplexity", S.with_(*_SCORE) + """
select sent_id, round(pow(10, -sum(log10p) / count(log10p)), 6) as ppl, count(log10p) as n_words
from sc group by sent_id""")
def sentence_perplexity_q(spark, sf_dir):
    """Perplexity of each benchmark line."""
    p = L.sentence_perplexity(T.ordered_dev_lines(spark, sf_dir), _wb_model(spark, sf_dir))
    return p.select("sent_id", F.round("ppl", 6).alias("ppl"), "n_words")


def _prune_sql(loss: str, theta: float) -> str:
    """Order-3 Witten–Bell model, n-grams of orders 3 and 2 dropped where ``loss`` is below theta, weights from what is left."""
    lossy = loss.format(c="c.c", p="x.p", g="x.g", lower="l.p")
    return S.with_(*_cnt_sql(), *LS.model_ctes(ORDER, "witten_bell"), f"""
k3 as (select x.h, x.w, x.p, x.g from p3 x join cnt c on c.ord = 3 and c.h = x.h and c.w = x.w
  join p2 l on l.h = {LS.lower('x.h')} and l.w = x.w where {lossy} >= {theta})""", f"""
k2 as (select x.h, x.w, x.p, x.g from p2 x join cnt c on c.ord = 2 and c.h = x.h and c.w = x.w join p1 l on l.w = x.w
  where {lossy} >= {theta} or x.h || ' ' || x.w in (select h from k3))""", """
g2 as (select a.h, (1 - coalesce(sum(k2.p), 0)) / (1 - coalesce(sum(l.p), 0)) as g from (select distinct h from p2) a
  left join k2 on k2.h = a.h left join p1 l on l.w = k2.w group by a.h)""", f"""
low as (select k3.h, k3.w, coalesce(k2.p, g2.g * p1.p) as pl from k3 left join k2 on k2.h = {LS.lower('k3.h')} and k2.w = k3.w
  left join g2 on g2.h = {LS.lower('k3.h')} left join p1 on p1.w = k3.w)""", """
g3 as (select a.h, (1 - coalesce(sum(k3.p), 0)) / (1 - coalesce(sum(low.pl), 0)) as g from (select distinct h from p3) a
  left join k3 on k3.h = a.h left join low on low.h = k3.h and low.w = k3.w group by a.h)""") + """
select 1 as ord, h, w, round(p, 9) as p, round(g, 9) as g from p1
union all select 2, k2.h, k2.w, round(k2.p, 9), round(g2.g, 9) from k2 join g2 on g2.h = k2.h
union all select 3, k3.h, k3.w, round(k3.p, 9), round(g3.g, 9) from k3 join g3 on g3.h = k3.h"""


def _pruned(spark, sf_dir, method, theta):
    counts = _counts(spark, sf_dir)
    pruned = L.prune_lm(L.build_lm(counts, ORDER, "witten_bell", materialize=True), counts, method, theta=theta)
    return pruned.probs.join(pruned.gammas, ["ord", "h"]).select(
        "ord", "h", "w", F.round("p", 9).alias("p"), F.round("g", 9).alias("g"))


@query("prune_lm", _prune_sql("{c}", 2))
def prune_lm_q(spark, sf_dir):
    """Witten–Bell model of the user turns pruned with a count threshold of 2 (order ≥ 2), backoff
    weights renormalised (tests check that every distribution still sums to 1)."""
    return _pruned(spark, sf_dir, "absolute", 2)


@query("prune_lm_seymore", _prune_sql("{c} * (ln({p}) - ln({g} * {lower}))", 2.5))
def prune_lm_seymore_q(spark, sf_dir):
    """L7 with the default method: n-grams whose loss of log likelihood is below 2.5 nats are dropped."""
    return _pruned(spark, sf_dir, "seymore", 2.5)


@query("lm_stage_roundtrip", _model_sql("witten_bell"))
def lm_stage_roundtrip_q(spark, sf_dir):
    """The Witten–Bell model saved at the ``lm`` stage (Parquet, partitioned by order) and
    loaded back; must equal the freshly built model."""
    from varietas.sources import files
    from varietas.streaming.interactive import scratch_dir
    m = L.build_lm(_counts(spark, sf_dir), ORDER, "witten_bell")
    path = scratch_dir(spark, "lm-stage")
    files.save_lm(m, path)
    back = files.load_lm(spark, path, ORDER)
    return back.probs.join(back.gammas, ["ord", "h"]).select(
        "ord", "h", "w", F.round("p", 9).alias("p"), F.round("g", 9).alias("g"))
