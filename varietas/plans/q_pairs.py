"""Registered queries: pair data."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.operators import vocab as V
from varietas.oracle import duck
from varietas.oracle import sql as S
from varietas.plans import pairs as PR
from varietas.plans.registry import query
from varietas.sources import tables as T

SEED = 5
_WS_S = duck.split_whitespace("source")
_WS_T = duck.split_whitespace("target")
_PAIRS = ["""pl as (select a.conv_id || ':' || a.turn as pair_id,
       replace(a.text, chr(10), ' ') || chr(9) || replace(b.text, chr(10), ' ') as text
       from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)""",
          """pairs as (select pair_id, string_split(text, chr(9))[1] as source, string_split(text, chr(9))[2] as target
       from pl where len(string_split(text, chr(9))) = 2)"""]


def _pairs(spark, sf_dir):
    good, _bad = PR.split_pairs(T.pair_lines(spark, sf_dir))
    return good


@query("split_pairs", S.with_(*_PAIRS) + "select pair_id, source, target from pairs")
def split_pairs_q(spark, sf_dir):
    """TSV pair lines (turn t, turn t+1) split into aligned source and target."""
    return _pairs(spark, sf_dir)


@query("filter_pair_length", S.with_(*_PAIRS) + f"""
select pair_id from pairs where len({_WS_S}) <= 70 and len({_WS_T}) <= 70""")
def filter_pair_length_q(spark, sf_dir):
    """pairs with at most 70 source and 70 target tokens."""
    return PR.filter_pair_length(_pairs(spark, sf_dir)).select("pair_id")


@query("prepare_pairs", S.with_(*_PAIRS, f"""
f as (select pair_id, len({_WS_S}) as src_len from pairs where len({_WS_S}) <= 70 and len({_WS_T}) <= 70)""") + f"""
select pair_id, src_len, ceil(src_len / 5)::int as bucket,
       (row_number() over (partition by ceil(src_len / 5) order by md5('{SEED}:' || pair_id), pair_id) - 1) // 64 as batch_id
from f""")
def prepare_pairs_q(spark, sf_dir):
    """Filtered, shuffled (seed 5), bucketed by source length (width 5) and batched by 64."""
    return PR.prepare_pairs(_pairs(spark, sf_dir), seed=SEED)


def _vocab_sql(col):
    ws = duck.split_whitespace(col)
    return f"""
ws as (select unnest({ws}) as token from pairs),
cnt as (select token, count(*) as freq from ws where token not in ('<blank>', '<s>', '</s>') group by token
        having count(*) >= 2),
top as (select token, freq from cnt order by freq desc, token limit 80000),
vocab as (select 0 as id, '<blank>' as token, 0::bigint as freq union all select 1, '<s>', 0
          union all select 2, '</s>', 0
          union all select (row_number() over (order by freq desc, token) + 2)::int, token, freq from top)"""


@query("source_vocab", S.with_(*_PAIRS, _vocab_sql("source")) + "select id, token, freq from vocab")
def source_vocab_q(spark, sf_dir):
    """A6 (source side): pair vocabulary with specials, min count 2, at most 80,000."""
    return V.build_vocab(_pairs(spark, sf_dir), text_col="source")


@query("target_vocab", S.with_(*_PAIRS, _vocab_sql("target")) + "select id, token, freq from vocab")
def target_vocab_q(spark, sf_dir):
    """A6 (target side)."""
    return V.build_vocab(_pairs(spark, sf_dir), text_col="target")


@query("encode_pairs", S.with_(*_PAIRS, _vocab_sql("source"), f"""
st as (select pair_id, generate_subscripts(t, 1) as pos, unnest(t) as token from (select pair_id, {_WS_S} as t from pairs))""") + """
select p.pair_id, coalesce(e.ids, '') as ids from pairs p left join (
  select st.pair_id, string_agg(cast(coalesce(v.id, (select max(id) + 1 from vocab)) as varchar), ' ' order by pos) as ids
  from st left join vocab v on v.token = st.token group by st.pair_id) e on e.pair_id = p.pair_id""")
def encode_pairs_q(spark, sf_dir):
    """Source tokens as vocabulary ids (unknown → one past the last id)."""
    pairs = _pairs(spark, sf_dir)
    return PR.encode(pairs, V.build_vocab(pairs, text_col="source"))


def _bleu_sql(max_n=4):
    grams = []
    for side, col in (("h", "target"), ("r", "source")):
        ws = duck.split_whitespace(col)
        grams.append(f"""{side}g as (select pair_id, n, array_to_string(t[i : i + n - 1], ' ') as g, count(*) as c
  from (select pair_id, {ws} as t from pairs), lateral (select unnest(range(1, {max_n} + 1)) as n) nn,
  lateral (select unnest(range(1, len(t) - n + 2)) as i) ii where len(t) >= n group by pair_id, n, g)""")
    return grams + ["""cl as (select hg.n, sum(hg.c) as total, sum(least(hg.c, coalesce(rg.c, 0))) as match
  from hg left join rg on rg.pair_id = hg.pair_id and rg.n = hg.n and rg.g = hg.g group by hg.n)""",
                    f"""ln as (select sum(len({_WS_T})) as hyp_len, sum(len({_WS_S})) as ref_len from pairs)"""]


@query("bleu", S.with_(*_PAIRS, *_bleu_sql()) + """,
pp as (select max(case when n = 1 then match / total end) as p1, max(case when n = 2 then match / total end) as p2,
              max(case when n = 3 then match / total end) as p3, max(case when n = 4 then match / total end) as p4 from cl)
select round(case when coalesce(least(p1, p2, p3, p4), 0) <= 0 then 0.0 else
         (case when hyp_len < ref_len then exp(1 - ref_len / hyp_len) else 1.0 end) *
         exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) end, 9) as bleu,
       round(p1, 9) as p1, round(p2, 9) as p2, round(p3, 9) as p3, round(p4, 9) as p4, hyp_len, ref_len from pp, ln""")
def bleu_q(spark, sf_dir):
    """Corpus BLEU of the pair targets against their sources."""
    b = PR.bleu(_pairs(spark, sf_dir))
    return b.select(F.round("bleu", 9).alias("bleu"), *[F.round(f"p{n}", 9).alias(f"p{n}") for n in range(1, 5)],
                    "hyp_len", "ref_len")
