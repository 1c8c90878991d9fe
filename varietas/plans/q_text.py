"""Registered queries: scans, tokenisation, frequency tables, vocabularies, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from varietas.functions import (join_tokens, rstrip_line, split_whitespace, treebank_detokenize,
                                treebank_string, treebank_tokens)
from varietas.operators import vocab as V
from varietas.oracle import duck
from varietas.oracle import sql as S
from varietas.plans.registry import query
from varietas.sources import tables as T


@query("tokenize_corpus", S.with_(S.DOC_LINES, S.doc_tokens_cte()) + """
select doc_id, line_no, len(toks) as n_tok, array_to_string(toks, ' ') as toks from doc_toks""")
def tokenize_corpus(spark, sf_dir):
    """Treebank tokens of every corpus line (tokens joined by a space, which no token contains)."""
    toks = treebank_tokens(F.col("text"))
    return (T.corpus_lines(spark, sf_dir)
            .select("doc_id", "line_no", toks.alias("t"))
            .select("doc_id", "line_no", F.size("t").alias("n_tok"), F.array_join("t", " ").alias("toks")))


def _doc_tokens(spark, sf_dir):
    return V.tokens_of(T.corpus_lines(spark, sf_dir))


def _user_ordered(spark, sf_dir):
    return T.ordered_user_lines(spark, sf_dir)


_DOC_TOKS = S.with_(S.DOC_LINES, S.doc_tokens_cte(), "w as (select unnest(toks) as word from doc_toks)")


@query("tokenize_str", S.with_(S.DOC_LINES) + f"""
select doc_id, line_no, {duck.treebank_string('text')} as padded from doc_lines""")
def tokenize_str(spark, sf_dir):
    """The padded Treebank string instead of the token list."""
    return T.corpus_lines(spark, sf_dir).select("doc_id", "line_no", treebank_string(F.col("text")).alias("padded"))


@query("tokenize_ptb", S.with_(S.DOC_LINES) + f"""
select doc_id, line_no, array_to_string({duck.treebank_tokens('text', True)}, ' ') as toks from doc_lines""")
def tokenize_ptb(spark, sf_dir):
    """Treebank tokens with brackets converted to -LRB- ... -RCB-."""
    return T.corpus_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.array_join(treebank_tokens(F.col("text"), True), " ").alias("toks"))


@query("detokenize_corpus", S.with_(S.DOC_LINES, S.doc_tokens_cte()) + f"""
select doc_id, line_no, {duck.treebank_detokenize('toks')} as text from doc_toks""")
def detokenize_corpus(spark, sf_dir):
    """Tokens of every corpus line joined back into text by the inverse cascade."""
    toks = T.corpus_lines(spark, sf_dir).select("doc_id", "line_no", treebank_tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", "line_no", treebank_detokenize(F.col("t")).alias("text"))


@query("whitespace_tokens", S.with_(S.DOC_LINES) + f"""
select doc_id, line_no, len({duck.split_whitespace('text')}) as n_tok,
       array_to_string({duck.split_whitespace('text')}, ' ') as toks from doc_lines""")
def whitespace_tokens(spark, sf_dir):
    """T3 + T4: ``str.split()`` tokens of every corpus line, re-joined with single spaces."""
    t = split_whitespace(F.col("text"))
    return T.corpus_lines(spark, sf_dir).select("doc_id", "line_no", F.size(t).alias("n_tok"),
                                                join_tokens(t).alias("toks"))


@query("rstrip_lines", S.with_(S.DOC_LINES) + f"""
select doc_id, line_no, rtrim(text, ' ' || chr(10)) as text from doc_lines""")
def rstrip_lines(spark, sf_dir):
    """Corpus lines with ``rstrip('\\n ')``."""
    return T.corpus_lines(spark, sf_dir).select("doc_id", "line_no", rstrip_line(F.col("text")).alias("text"))


@query("drop_blank", S.with_(S.DOC_LINES) + """
select doc_id, line_no from doc_lines where length(rtrim(text, ' ' || chr(10))) > 0""")
def drop_blank(spark, sf_dir):
    """corpus lines that are not blank."""
    return T.non_blank(T.corpus_lines(spark, sf_dir)).select("doc_id", "line_no")


@query("unigrams", _DOC_TOKS + """
select word, count(*) as n, count(*) / (select count(*) from w) as p from w group by word""")
def unigrams_q(spark, sf_dir):
    """A1: Treebank unigram counts and relative frequencies of the whole corpus."""
    return V.unigrams(_doc_tokens(spark, sf_dir))


@query("unigrams_text", _DOC_TOKS + """,
c as (select word, count(*) as n from w group by word),
t as (select count(*) as total from w),
q as (select word, (n * 200000 + total) // (2 * total) as q from c, t)
select word || ' ' || cast(q // 100000 as varchar) || '.' || lpad(cast(q % 100000 as varchar), 5, '0') as line
from q""")
def unigrams_text_q(spark, sf_dir):
    """The unigram table as ``word p`` lines, p to 5 decimals."""
    return V.unigram_lines(V.unigrams(_doc_tokens(spark, sf_dir)))


@query("corpus_stats", _DOC_TOKS + """
select count(*) as n_tokens, count(distinct word) as n_types from w""")
def corpus_stats_q(spark, sf_dir):
    """A2: number of tokens and of types in the corpus."""
    return V.corpus_stats(_doc_tokens(spark, sf_dir))


_TRAIN_DEV_TOKS = S.with_(
    S.USER_LINES, S.DEV_LINES,
    f"tr as (select distinct unnest({S.tb_tokens()}) as tok from user_lines0)",
    f"dv as (select unnest({S.tb_tokens()}) as tok from dev_lines0)")


@query("oov", _TRAIN_DEV_TOKS + """
select (select count(*) from tr) as types,
       (select count(*) from dv where tok not in (select tok from tr)) as oovs""")
def oov_q(spark, sf_dir):
    """Training types (user turns) and dev tokens (benchmark) not among them."""
    return V.oov(V.tokens_of(T.user_lines(spark, sf_dir)), V.tokens_of(T.dev_lines(spark, sf_dir)))


@query("oov_types", _TRAIN_DEV_TOKS + """
select distinct tok from dv where tok not in (select tok from tr)""")
def oov_types_q(spark, sf_dir):
    """Set difference — distinct dev types missing from training."""
    tr = V.tokens_of(T.user_lines(spark, sf_dir))
    dv = V.tokens_of(T.dev_lines(spark, sf_dir))
    return dv.join(tr, "tok", "left_anti").distinct()


@query("vocab_distinct", S.with_(S.USER_LINES) + f"""
select distinct unnest({S.tb_tokens()}) as tok from user_lines0""")
def vocab_distinct_q(spark, sf_dir):
    """Distinct vocabulary of the user turns."""
    return V.tokens_of(T.user_lines(spark, sf_dir)).distinct()


@query("dedupe_counts", """
select text, count(*) as num, min(doc_id) as first from documents group by text""")
def dedupe_counts_q(spark, sf_dir):
    """A4: multiset of identical documents — count and first occurrence."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.dedupe_counts(docs, order_col="doc_id").withColumnRenamed("min(doc_id)", "first")


@query("distinct_sentences", S.with_(S.USER_LINES) + """
select distinct rtrim(text, ' ') as text from user_lines0""")
def distinct_sentences_q(spark, sf_dir):
    """Distinct user lines (right-trimmed of spaces)."""
    return (T.user_lines(spark, sf_dir).select(rstrip_line(F.col("text"), " ").alias("text"))
            .dropDuplicates(["text"]))


@query("restore_multiplicity", """
with d as (select text, count(*) as num from documents group by text)
select md5(text) as text_md5, c.copy from d, lateral (select unnest(generate_series(1, d.num)) as copy) c""")
def restore_multiplicity_q(spark, sf_dir):
    """U4: deduplicated documents expanded back to their multiplicity (bag semantics)."""
    d = V.dedupe_counts(T.table(spark, sf_dir, "documents").select("text"), order_col=None)
    return V.restore_multiplicity(d).select(F.md5("text").alias("text_md5"), "copy")


@query("union_corpora", S.with_(S.USER_LINES, S.GEN_LINES) + """
select 'base' as source, conv_id, turn, line_no, text from user_lines0
union all
select 'generated' as source, conv_id, turn, line_no, text from gen_lines0""")
def union_corpora_q(spark, sf_dir):
    """Base corpus plus generated text, concatenated."""
    base = T.user_lines(spark, sf_dir).withColumn("source", F.lit("base"))
    gen = T.generated_lines(spark, sf_dir).withColumn("source", F.lit("generated"))
    return base.unionByName(gen).select("source", "conv_id", "turn", "line_no", "text")


_RARE = S.with_(S.USER_LINES, S.USER_ORDERED, f"""
toks as (select sent_id, generate_subscripts(t, 1) as pos, unnest(t) as tok
         from (select sent_id, {duck.split_whitespace('text')} as t from user_lines))""",
                "cnt as (select tok, count(*) as c from toks group by tok)")


@query("replace_rare", _RARE + """
select sent_id, string_agg(case when c > 1 then toks.tok else '<unk>' end, ' ' order by pos) as text
from toks join cnt using (tok) group by sent_id""")
def replace_rare_q(spark, sf_dir):
    """A5: whitespace tokens seen once in the user turns become <unk>, line order kept."""
    return V.replace_rare(_user_ordered(spark, sf_dir), n=1).select("sent_id", "text")


_VOCAB_SQL = S.with_(S.USER_LINES, f"""
ws as (select unnest({duck.split_whitespace('text')}) as token from user_lines0)""", """
cnt as (select token, count(*) as freq from ws where token not in ('<blank>', '<s>', '</s>') group by token
        having count(*) >= 2),
top as (select token, freq from cnt order by freq desc, token limit 80000),
vocab as (select 0 as id, '<blank>' as token, 0::bigint as freq
          union all select 1, '<s>', 0 union all select 2, '</s>', 0
          union all select (row_number() over (order by freq desc, token) + 2)::int, token, freq from top)""")


@query("build_vocab", _VOCAB_SQL + "select id, token, freq from vocab")
def build_vocab_q(spark, sf_dir):
    """Vocabulary of the user turns — specials, then min count 2, at most 80,000 tokens."""
    return V.build_vocab(T.user_lines(spark, sf_dir), max_size=80000, min_freq=2)


@query("map_unknown", _VOCAB_SQL.replace("with ", "with " + S.DEV_LINES + ",\n" + S.DEV_ORDERED + ",\n", 1) + f""",
dt as (select sent_id, generate_subscripts(t, 1) as pos, unnest(t) as tok
       from (select sent_id, {duck.split_whitespace('text')} as t from dev_lines))
select sent_id, string_agg(case when v.token is null then '<unk>' else dt.tok end, ' ' order by pos) as text
from dt left join (select distinct token from vocab) v on dt.tok = v.token group by sent_id""")
def map_unknown_q(spark, sf_dir):
    """Dev lines with tokens outside the user-turn vocabulary replaced by <unk>."""
    vocab = V.build_vocab(T.user_lines(spark, sf_dir))
    return V.map_unknown(T.ordered_dev_lines(spark, sf_dir), vocab).select("sent_id", "text")


@query("map_unknown_drop", _VOCAB_SQL.replace("with ", "with " + S.DEV_LINES + ",\n" + S.DEV_ORDERED + ",\n", 1) + f""",
dt as (select sent_id, generate_subscripts(t, 1) as pos, unnest(t) as tok
       from (select sent_id, {duck.split_whitespace('text')} as t from dev_lines))
select sent_id, string_agg(case when v.token is null or ('0x' || substr(md5('5:' || sent_id || ':' || (pos - 1)), 1, 15))::bigint < {int(0.02 * (1 << 60))}
  then '<unk>' else dt.tok end, ' ' order by pos) as text
from dt left join (select distinct token from vocab) v on dt.tok = v.token group by sent_id""")
def map_unknown_drop_q(spark, sf_dir):
    """As ``map_unknown``, with 2 % of the known tokens dropped to <unk> by seeded draws."""
    vocab = V.build_vocab(T.user_lines(spark, sf_dir))
    return V.map_unknown(T.ordered_dev_lines(spark, sf_dir), vocab, drop_rate=0.02, seed=5).select("sent_id", "text")


@query("text_roundtrip", S.with_(S.USER_LINES) + "select rtrim(text, ' ' || chr(10)) as text, count(*) as n "
       "from user_lines0 group by 1")
def text_roundtrip_q(spark, sf_dir):
    """S8 → S1: user lines written as text files in parallel and read back (numbered by file and
    position, right-stripped); the multiset of lines must be unchanged."""
    from varietas.sources import files
    from varietas.streaming.interactive import scratch_dir
    path = scratch_dir(spark, "text-lines")
    files.write_lines(T.user_lines(spark, sf_dir), path)
    back = files.read_sentences(spark, path)
    return back.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
