"""Registered queries: lattices, k-best paraphrases, rescoring, AWER."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.functions import treebank_tokens
from varietas.operators import lm as L
from varietas.operators import ngrams as G
from varietas.operators import sampling as SMP
from varietas.operators import vocab as V
from varietas.oracle import decode_sql as DS
from varietas.oracle import duck
from varietas.oracle import lm_sql as LS
from varietas.oracle import sql as S
from varietas.plans import paraphrase as P
from varietas.plans.q_vectors import _NEAR_SQL, _VEC, vectors
from varietas.plans.registry import query
from varietas.sources import tables as T

ORDER, SEED = 3, 11
_STOP = ", ".join(duck.lit(w) for w in P.STOP_WORDS)


def _tb_lines(lines):
    """LM training text: Treebank tokens joined by spaces (the decoder works on Treebank tokens)."""
    return lines.select(F.array_join(treebank_tokens(F.col("text")), " ").alias("text"))


def _lm(spark, sf_dir):
    return L.build_lm(G.ngram_counts(_tb_lines(T.user_lines(spark, sf_dir)), ORDER), ORDER, "witten_bell",
                      materialize=True)


def _sentences(spark, sf_dir):
    return T.ordered_user_lines(spark, sf_dir)


_LM_VOCAB = f"""lmv as (select distinct unnest({S.tb_tokens()}) as w from user_lines union select '</s>' union select '<unk>')"""
_TOKS = f"""tk as (select sent_id, generate_subscripts(t, 1) - 1 as pos, unnest(t) as word
       from (select sent_id, {S.tb_tokens()} as t from user_lines))"""


@query("replaceable", S.with_(S.USER_LINES, S.USER_ORDERED, _TOKS) + f"""
select sent_id, pos, word, word not in ({_STOP}) and not starts_with(word, '''') as replaceable from tk""")
def replaceable_q(spark, sf_dir):
    """which user-line tokens may be replaced (stop list, leading apostrophe)."""
    t = P.sentence_tokens(_sentences(spark, sf_dir))
    return t.select("sent_id", "pos", "word", P.is_replaceable(F.col("word")).alias("replaceable"))


@query("paraphrase_lattice", S.with_(*_VEC, S.USER_LINES, S.USER_ORDERED, _LM_VOCAB, _TOKS, f"""
q as (select distinct word as qword from tk where word not in ({_STOP}) and not starts_with(word, ''''))""",
                                     _NEAR_SQL.format(k=5)) + """
select sent_id, pos, coalesce(lmv.w, '<unk>') as word, 0.0 as cost, true as orig from tk left join lmv on lmv.w = tk.word
union all
select tk.sent_id, tk.pos, nb.word, round(-ln(nb.sim) / 1000, 12) as cost, false as orig
from tk join nb_5 nb on nb.query = tk.word
where tk.word not in (""" + _STOP + """) and not starts_with(tk.word, '''')
  and nb.sim > 0.1 and nb.word <> nb.query and nb.word in (select w from lmv)""")
def paraphrase_lattice_q(spark, sf_dir):
    """P1 lattice: per token the word (or <unk>) and its 5 nearest LM-known neighbours with sim > 0.1
    at cost -ln(sim)/1000 (F1, F2, J6, J10, M4)."""
    slots = P.lattice(_sentences(spark, sf_dir), vectors(spark, sf_dir), _lm(spark, sf_dir))
    return slots.select("sent_id", "pos", "word", F.round("cost", 12).alias("cost"), "orig")


def _decode_sql(k: int, sentences: str = "select sent_id, text from user_lines") -> list[str]:
    """CTEs of the lattices of ``sentences`` and their k best strings, ending in ``best``."""
    return [*_VEC, S.USER_LINES, S.USER_ORDERED, _LM_VOCAB, *LS.counts_ctes("user_lines", ORDER, S.tb_tokens()),
            "uniq_lines as (select regexp_replace(text, '[' || chr(10) || ' ]+$', '') as line, count(*) as num from user_lines group by 1)",
            "uniq as (select line, num, row_number() over (order by line) as sent_id from uniq_lines)",
            f"sents as ({sentences})",
            f"""tk as (select sent_id, generate_subscripts(t, 1) - 1 as pos, unnest(t) as word
       from (select sent_id, {S.tb_tokens()} as t from sents))""",
            f"q as (select distinct word as qword from tk where word not in ({_STOP}) and not starts_with(word, ''''))",
            _NEAR_SQL.format(k=5), f"""slots as (
  select sent_id, pos, coalesce(lmv.w, '<unk>') as word, 0.0::double as cost from tk left join lmv on lmv.w = tk.word
  union all
  select tk.sent_id, tk.pos, nb.word, -ln(nb.sim) / 1000 as cost from tk join nb_5 nb on nb.query = tk.word
  where tk.word not in ({_STOP}) and not starts_with(tk.word, '''')
    and nb.sim > 0.1 and nb.word <> nb.query and nb.word in (select w from lmv))""", *DS.decode_ctes(k)]


_UNIQ = "select sent_id, line as text from uniq"


@query("paraphrase", S.recursive(*_decode_sql(5)) + """
select sent_id, rank::integer as rank, sent, round(score, 9) as score, round(score, 9) as new_score from best""")
def paraphrase_q(spark, sf_dir):
    """P1 / W1 / W8 / W9 / L9 (identity): 5 best paraphrases of every user line."""
    out = P.paraphrase(_sentences(spark, sf_dir), vectors(spark, sf_dir), _lm(spark, sf_dir), k=5)
    return out.select("sent_id", "rank", "sent", F.round("score", 9).alias("score"),
                      F.round("new_score", 9).alias("new_score"))


_POST = ["pc as (select sent_id, rank, sent, exp(min(score) over (partition by sent_id) - score) as m, score from best)",
         "po as (select sent_id, rank, sent, m / sum(m) over (partition by sent_id) as wt from pc)",
         f"fev as ({LS.events_sql('po', ORDER, LS.ws_tokens('sent'), keep='wt')})",
         "fcnt as (select ord, h, w, sum(wt) as c from fev group by ord, h, w)"]


def _expected_counts(spark, sf_dir):
    """Expected n-gram counts of the user lines' 5 best paraphrases under their posteriors."""
    from varietas.operators.decode import posteriors
    out = P.paraphrase(_sentences(spark, sf_dir), vectors(spark, sf_dir), _lm(spark, sf_dir), k=5)
    return G.weighted_counts(posteriors(out), "weight", ORDER, "sent")


@query("expected_counts", S.recursive(*_decode_sql(5), *_POST) + "select ord, h, w, round(c, 7) as c from fcnt")
def expected_counts_q(spark, sf_dir):
    """A7 with fractional counts: expected n-gram counts over the readings of every user line's lattice."""
    return _expected_counts(spark, sf_dir).select("ord", "h", "w", F.round("c", 7).alias("c"))


@query("lm_presmoothed", S.recursive(*_decode_sql(5), *_POST, *LS.model_ctes(ORDER, "presmoothed", cnt="fcnt")) + """
select ord, h, w, round(p, 7) as p, round(g, 7) as g from probs""")
def lm_presmoothed_q(spark, sf_dir):
    """Fractional (expected) counts normalised as given."""
    m = L.build_lm(_expected_counts(spark, sf_dir), ORDER, "presmoothed", store_counts=True)
    return m.weighted().select("ord", "h", "w", F.round("p", 7).alias("p"), F.round("g", 7).alias("g"))


@query("rounded_counts", S.recursive(*_decode_sql(5), *_POST) + """
select ord, h, w, floor(c + 0.5)::bigint as c from fcnt where abs(c - floor(c) - 0.5) > 1e-6 and floor(c + 0.5) > 0
union all select ord, h, w, -1 from fcnt where abs(c - floor(c) - 0.5) <= 1e-6""")
def rounded_counts_q(spark, sf_dir):
    """L5d: fractional counts rounded to integers, zero counts dropped (counts within 1e-6 of a half are marked -1,
    since the order of a sum decides them)."""
    from varietas.session import checkpoint
    counts = checkpoint(_expected_counts(spark, sf_dir))
    half = F.abs(F.col("c") - F.floor("c") - 0.5) <= 1e-6
    return G.round_counts(counts.where(~half)).select("ord", "h", "w", "c").unionByName(
        counts.where(half).select("ord", "h", "w", F.lit(-1).cast("long").alias("c")))


@query("paraphrase_corpus", S.recursive(*_decode_sql(5, _UNIQ)) + """
select line, unnest(range(1, num + 1)) as copy, rank::integer as rank, sent, round(score, 9) as new_score
from uniq join best using (sent_id)""")
def paraphrase_corpus_q(spark, sf_dir):
    """Paraphrase each distinct user line once, repeat the results per occurrence."""
    out = P.paraphrase_corpus(T.user_lines(spark, sf_dir), vectors(spark, sf_dir), _lm(spark, sf_dir), k=5)
    return out.select("line", "copy", "rank", "sent", F.round("new_score", 9).alias("new_score"))


_RESCORE = ["texts as (select distinct sent as text from best union select line from uniq)",
            "strs as (select row_number() over (order by text) as sent_id, text from texts)",
            "vocab as (select w from cnt where ord = 1 union select '</s>' union select '<unk>')",
            "vsize as (select count(*) * 1.0 as nv from vocab)",
            "ctx as (select ord, h, sum(c) as ch, count(*) as th from cnt group by ord, h)",
            *LS.dev_events_ctes("strs", ORDER), f"sc as ({LS.recursion_score_sql(ORDER)})",
            "sp as (select text, round(pow(10, -sum(log10p) / count(*)), 9) as ppl from sc join strs using (sent_id) group by text)"]


@query("paraphrase_conservative", S.recursive(*_decode_sql(10, _UNIQ), *_RESCORE, """
ranked as (select uniq.line, num, sent, sp.ppl as new_score, b.ppl as baseline,
  row_number() over (partition by sent_id order by sp.ppl, score, sent) as rank
  from uniq join best using (sent_id) join sp on sp.text = sent join sp b on b.text = line)""") + """
select line, unnest(range(1, num + 1)) as copy, rank::integer as rank, sent, round(new_score, 6) as new_score
from ranked where new_score <= baseline""")
def paraphrase_conservative_q(spark, sf_dir):
    """10 best, rescored by perplexity under the LM, kept only when not worse than
    the original line's own perplexity."""
    lm = _lm(spark, sf_dir)
    out = P.paraphrase_corpus(T.user_lines(spark, sf_dir), vectors(spark, sf_dir), lm, k=10,
                              conservative=True, rescorer=lm)
    return out.select("line", "copy", "rank", "sent", F.round("new_score", 6).alias("new_score"))


@query("training_sets_from_store", S.recursive(*_decode_sql(5, _UNIQ), "nn as (select count(*) as n from user_lines)") + """
select u.sent_id, (u.sent_id * 100 + n - 1) // n as p, best.rank::integer as rank, sent
from user_lines u join nn on true join uniq on uniq.line = regexp_replace(u.text, '[' || chr(10) || ' ]+$', '')
join best on best.sent_id = uniq.sent_id""")
def training_sets_from_store_q(spark, sf_dir):
    """The paraphrase store (P2 output) expanded over the 100 nested training prefixes."""
    lm = _lm(spark, sf_dir)
    train = _sentences(spark, sf_dir)
    store = P.paraphrase_corpus(T.user_lines(spark, sf_dir), vectors(spark, sf_dir), lm, k=5)
    store = store.where(F.col("copy") == 1).select("line", "rank", "sent")
    found, _missing = P.training_sets_from_store(train, store, 100)
    return found.select("sent_id", "p", "rank", "sent")


_UNI = [S.USER_LINES, S.USER_ORDERED, S.DEV_LINES, S.DEV_ORDERED, f"""
uw as (select unnest({S.tb_tokens()}) as word from user_lines)""",
        "uni as (select word, count(*) as n from uw group by word)",
        "cdf as (select word, n, sum(n) over (order by n, word rows between unbounded preceding and current row) - n as lo, "
        "sum(n) over (order by n, word rows between unbounded preceding and current row) as hi from uni)",
        "tot as (select sum(n) as total from uni)"]


@query("unigram_cdf", S.with_(*_UNI) + "select word, n, lo, hi from cdf")
def unigram_cdf_q(spark, sf_dir):
    """W6 / W7 (H2): cumulative count intervals of the user-turn unigrams, ascending by (n, word)."""
    uni = V.unigrams(V.tokens_of(T.user_lines(spark, sf_dir)))
    return SMP.cdf(uni)


_RARE_LM = [f"""rt as (select sent_id, generate_subscripts(t, 1) as pos, unnest(t) as tok
       from (select sent_id, {duck.split_whitespace('text')} as t from user_lines))""",
            "rc as (select tok, count(*) as c from rt group by tok)",
            "lmv as (select distinct case when c > 1 then tok else '<unk>' end as w from rt join rc using (tok) "
            "union select '</s>' union select '<unk>')"]
_DTOK = f"""dk as (select sent_id, generate_subscripts(t, 1) - 1 as pos, unnest(t) as word
       from (select sent_id, {S.tb_tokens()} as t from dev_lines))"""


@query("awer_draws", S.with_(*_UNI, *_RARE_LM, _DTOK, f"""
dr as (select sent_id, pos, word, ('0x' || substr(md5('{SEED}:' || sent_id || ':' || pos), 1, 15))::ubigint::hugeint
       * (select total from tot) // {1 << 60} as t from dk)""") + """
select dr.sent_id, dr.pos, dr.word, coalesce(cdf.word, '<unk>') as alt,
       coalesce(cdf.word, '<unk>') in (select w from lmv) and coalesce(cdf.word, '<unk>') <> dr.word as usable
from dr left join cdf on cdf.lo <= dr.t and dr.t < cdf.hi""")
def awer_draws_q(spark, sf_dir):
    """M8 / J8 (C2) / F8: the seeded unigram draw for every benchmark token, and whether it enters the
    AWER lattice (known to the LM of the rare-replaced user turns, and different from the word)."""
    uni = V.unigrams(V.tokens_of(T.user_lines(spark, sf_dir)))
    lm = _awer_lm(spark, sf_dir)
    toks = P.sentence_tokens(T.ordered_dev_lines(spark, sf_dir))
    d = SMP.draw_words(toks.withColumn("k", SMP.draw60(SEED, F.col("sent_id"), F.col("pos"))), SMP.cdf(uni))
    v = lm.vocab.select(F.col("w").alias("_v"))
    d = d.join(v, d.alt == v._v, "left")
    return d.select("sent_id", "pos", "word", "alt", (F.col("_v").isNotNull() & (F.col("alt") != F.col("word")))
                    .alias("usable"))


def _awer_lm(spark, sf_dir):
    """The evaluation LM: rare tokens (count 1) → <unk>, then Witten–Bell order 3 on whitespace tokens."""
    rare = V.replace_rare(T.ordered_user_lines(spark, sf_dir), 1)
    return L.build_lm(G.ngram_counts(rare, ORDER), ORDER, "witten_bell", materialize=True)


def _draws_sql(*ctes: str) -> list[str]:
    return [*_UNI, *ctes, _DTOK, f"""
dr as (select sent_id, pos, word, ('0x' || substr(md5('{SEED}:' || sent_id || ':' || pos), 1, 15))::ubigint::hugeint
       * (select total from tot) // {1 << 60} as t from dk)""", """
da as (select dr.sent_id, dr.pos, dr.word, coalesce(cdf.word, '<unk>') as alt from dr left join cdf on cdf.lo <= dr.t and dr.t < cdf.hi)""", """
dw as (select sent_id, list(word order by pos) as ws from dk group by sent_id)"""]


_AWER = S.recursive(*_draws_sql(*_RARE_LM), """
rl as (select sent_id, list(case when c > 1 then tok else '<unk>' end order by pos) as t from rt join rc using (tok) group by sent_id)""",
                    *LS.counts_ctes("rl", ORDER, "t"), """
slots as (select sent_id, pos, coalesce(lmv.w, '<unk>') as word, 0.0::double as cost from dk left join lmv on lmv.w = dk.word
  union all select sent_id, pos, alt, 0.0 from da where alt <> word and alt in (select w from lmv))""", *DS.decode_ctes(1))


@query("awer", _AWER + f"""
select round(avg({DS.error_rate('ws', 'sent')}), 9) as awer, count(*) as n_lines
from dev_lines left join dw using (sent_id) left join best using (sent_id)""")
def awer_q(spark, sf_dir):
    """Artificial word error rate of the benchmark lines (1-best decoding of word-or-draw lattices)."""
    uni = V.unigrams(V.tokens_of(T.user_lines(spark, sf_dir)))
    out = P.awer(T.ordered_dev_lines(spark, sf_dir), uni, _awer_lm(spark, sf_dir), seed=SEED)
    return out.select(F.round("awer", 9).alias("awer"), "n_lines")


@query("stream_paraphrase", S.recursive(*_decode_sql(5)) + """
select text as line, rank::integer as rank, sent, round(score, 9) as score from best join user_lines using (sent_id)""")
def stream_paraphrase_q(spark, sf_dir):
    """ST2 / P1: user lines streamed as files and paraphrased (5 best) line by line."""
    from varietas.streaming.interactive import paraphrase_service, serve_lines
    out = serve_lines(spark, T.user_lines(spark, sf_dir), paraphrase_service(vectors(spark, sf_dir), _lm(spark, sf_dir), 5))
    return out.select(F.col("text").alias("line"), "rank", "sent", F.round("score", 9).alias("score"))
