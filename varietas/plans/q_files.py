"""Registered queries: every text and table format written by Spark and read back (S2–S6, S9–S13, §2.11 reports)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from varietas.functions import treebank_tokens
from varietas.operators import rows as R
from varietas.operators import vocab as V
from varietas.oracle import sql as S
from varietas.plans import pairs as PR
from varietas.plans.registry import query
from varietas.sources import files
from varietas.sources import tables as T
from varietas.streaming.interactive import scratch_dir

_TOK = f"tk as (select unnest({S.tb_tokens()}) as tok from doc_lines)"


def _tokens(spark, sf_dir):
    return T.corpus_lines(spark, sf_dir).select(F.explode(treebank_tokens(F.col("text"))).alias("tok"))


@query("unigram_file", S.with_(S.DOC_LINES, _TOK, "u as (select tok, count(*) as n from tk group by tok)", "t as (select sum(n) as total from u)") + """
select tok as word, round((n * 200000 + total) // (2 * total) / 100000.0, 5) as p, (select count(*) from u) as lines, 0 as malformed from u, t""")
def unigram_file_q(spark, sf_dir):
    """S9 → S3: the unigram file of the corpus written as ``word p`` lines and read back, with the reader's report."""
    path = scratch_dir(spark, "unigrams")
    files.write_unigrams(V.unigram_lines(V.unigrams(_tokens(spark, sf_dir))), path)
    report = Observation()
    back = files.read_unigrams(spark, path, report)
    return _with_report(back.select("word", F.round("p", 5).alias("p")), report, "lines", "malformed")


def _with_report(df, report, *names):
    """The rows with the reader's counts as constant columns (one action fills the report)."""
    from varietas.session import checkpoint
    df = checkpoint(df)
    return df.select("*", *[F.lit(report.get[n]).alias(n) for n in names])


@query("symbol_file", S.with_(S.DOC_LINES, _TOK, """u as (select tok, count(*) as n from tk group by tok having count(*) >= 2)""", """
v as (select tok, row_number() over (order by n desc, tok) + 2 as id from u qualify id < 3 + 500)""", """
w as (select tok as token, id::varchar as id from v union all select unnest(['<blank>', '<s>', '</s>']), unnest(['0', '1', '2']))""") + """
select token, id, (select count(*) from w) + 2 as lines, 2 as malformed from w""")
def symbol_file_q(spark, sf_dir):
    """A6 → S4: a vocabulary of 500 tokens written as ``symbol id`` lines, two broken lines among them, and read back;
    the report counts the broken ones."""
    path = scratch_dir(spark, "symbols")
    toks = T.corpus_lines(spark, sf_dir).select(F.array_join(treebank_tokens(F.col("text")), " ").alias("text"))
    vocab = V.build_vocab(toks, max_size=500)
    broken = spark.range(2).select(F.lit("").alias("token"), F.lit(None).cast("int").alias("id"))
    files.write_symbols(vocab.select("token", "id").unionByName(broken), path)
    report = Observation()
    return _with_report(files.read_vocab(spark, path, report), report, "lines", "malformed")


@query("vocab_table", S.with_(S.DOC_LINES, _TOK, "u as (select tok, count(*) as n from tk group by tok having count(*) >= 2)", """
v as (select tok, n, row_number() over (order by n desc, tok) + 2 as id from u qualify id < 3 + 500)""") + """
select id::integer as id, tok as token, n as freq from v union all select unnest([0, 1, 2]), unnest(['<blank>', '<s>', '</s>']), 0""")
def vocab_table_q(spark, sf_dir):
    """The vocabulary table (id, token, freq), special tokens first, written and read back."""
    path = scratch_dir(spark, "vocab")
    toks = T.corpus_lines(spark, sf_dir).select(F.array_join(treebank_tokens(F.col("text")), " ").alias("text"))
    files.write_vocab(V.build_vocab(toks, max_size=500), path)
    return spark.read.parquet(path)


_PAIRS = """pl as (select a.conv_id || ':' || a.turn as pair_id, replace(a.text, chr(10), ' ') || chr(9) || replace(b.text, chr(10), ' ') as text
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"""
_SPLIT = "sp as (select text, string_split(text, chr(9)) as f from pl)"


@query("pair_file", S.with_(_PAIRS, _SPLIT) + """
select f[1] as source, f[2] as target, (select count(*) from pl) as lines, (select count(*) from sp where len(f) <> 2) as malformed
from sp where len(f) = 2""")
def pair_file_q(spark, sf_dir):
    """S8 → S5 → F5 → S12: conversation pairs as a TSV file, read with a report, split, written as the aligned table
    and read back."""
    path, table = scratch_dir(spark, "pairs-tsv"), scratch_dir(spark, "pairs")
    files.write_lines(T.pair_lines(spark, sf_dir), path)
    report = Observation()
    good, _ = PR.split_pairs(files.read_pairs(spark, path, report))
    files.write_pairs(good, table)
    counts = report.get
    return spark.read.parquet(table).select("source", "target", F.lit(counts["lines"]).alias("lines"), F.lit(counts["malformed"]).alias("malformed"))


@query("pairs_rejected", S.with_(S.DOC_LINES, "al as (select doc_id || ':' || line_no as pair_id, replace(text, ', ', chr(9)) as text from doc_lines)") + """
select pair_id, text from al where len(string_split(text, chr(9))) <> 2""")
def pairs_rejected_q(spark, sf_dir):
    """the rejected side — corpus lines whose commas, read as tabs, do not make two fields."""
    lines = T.corpus_lines(spark, sf_dir).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("pair_id"),
                                                 F.replace("text", F.lit(", "), F.lit("\t")).alias("text"))
    return PR.split_pairs(lines)[1].select("pair_id", "text")


@query("chunk_files", S.with_(S.USER_LINES, S.USER_ORDERED) + """
select (sent_id - 1) // 64 as chunk_id, (sent_id - 1) % 64 as line_no, text from user_lines where (sent_id - 1) // 64 < 5""")
def chunk_files_q(spark, sf_dir):
    """User lines written as numbered chunk files of 64 lines and the first five read back in order."""
    path = scratch_dir(spark, "chunks")
    files.write_chunks(R.chunk_ids(T.ordered_user_lines(spark, sf_dir), 64, "sent_id"), path)
    return files.read_chunks(spark, path, 5)


@query("curve_file", S.with_(S.USER_LINES, S.USER_ORDERED, "c as (select (sent_id - 1) // 64 as i, count(*) * 1.0 as n from user_lines group by 1)") + """
select i, round(n, 6) as ppl from c""")
def curve_file_q(spark, sf_dir):
    """A curve (lines per chunk) written as ``i<TAB>value`` rows and read back."""
    path = scratch_dir(spark, "curve")
    ch = R.chunk_ids(T.ordered_user_lines(spark, sf_dir), 64, "sent_id")
    files.write_curve(ch.groupBy(F.col("chunk_id").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("ppl")), path)
    return files.read_curve(spark, path).select("i", F.round("ppl", 6).alias("ppl"))


@query("paraphrase_store", S.with_(S.USER_LINES, S.GEN_LINES) + """
select distinct u.text as line, 1 as rank, g.text as sent from user_lines0 u join gen_lines0 g
on g.conv_id = u.conv_id and g.turn = u.turn + 1 and g.line_no = u.line_no""")
def paraphrase_store_q(spark, sf_dir):
    """A paraphrase store (each user line with the matching line of the answer), saved and loaded."""
    path = scratch_dir(spark, "store")
    u, g = T.user_lines(spark, sf_dir), T.generated_lines(spark, sf_dir).withColumnRenamed("text", "sent")
    g = g.select("conv_id", (F.col("turn") - 1).alias("turn"), "line_no", "sent")
    store = u.join(g, ["conv_id", "turn", "line_no"]).select(F.col("text").alias("line"), F.lit(1).alias("rank"), "sent").distinct()
    files.save_paraphrases(store, path)
    return files.load_paraphrases(spark, path)


@query("vectors_report", S.with_(S.DOC_LINES, S.doc_tokens_cte(), S.vectors_cte()) + """
select rank, word, (select count(*) from vectors) + 3 as header_n, 64 as header_dim, (select count(*) from vectors) + 2 as rows_read,
  1 as malformed, 64 as min_dim, 64 as max_dim, (select count(*) from vectors) as words, 1 as repeated from vectors""")
def vectors_report_q(spark, sf_dir):
    """S2 / §2.11: a word2vec file whose header announces one row too many, with one repeated word and one broken row;
    the readers' reports count each, and the last row of the repeated word is kept."""
    from varietas.session import checkpoint
    path = scratch_dir(spark, "vectors")
    v = checkpoint(T.vector_table(spark, sf_dir))
    n = v.count()
    lines = v.select((F.col("rank") + 2).cast("long").alias("_r"), F.concat_ws(" ", "word", F.array_join(F.col("v").cast("array<string>"), " ")).alias("value"))
    first = v.where("rank = 0").select(F.lit(1).cast("long").alias("_r"), F.concat_ws(" ", "word", F.array_join(F.transform("v", lambda x: F.lit("0.5")), " ")).alias("value"))
    extra = spark.createDataFrame([(0, f"{n + 3} 64"), (1 << 40, "broken")], "_r long, value string")
    lines.unionByName(first).unionByName(extra).orderBy("_r").select("value").write.text(path)
    report, repeats = Observation(), Observation()
    back = checkpoint(files.drop_repeated_words(files.read_vectors(spark, path, report=report), repeats))
    a, b = report.get, repeats.get
    return back.select((F.col("rank") - 1).alias("rank"), "word", *[F.lit(x).alias(name) for name, x in (
        ("header_n", a["header_n"]), ("header_dim", a["header_dim"]), ("rows_read", a["rows"]), ("malformed", a["malformed"]),
        ("min_dim", a["min_dim"]), ("max_dim", a["max_dim"]), ("words", b["words"]), ("repeated", b["repeated"]))])
