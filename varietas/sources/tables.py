"""Stand-in inputs built from the driver's Parquet tables (see FIXTURES.md).

These only reshape rows into the schemas the jobs expect — a corpus of lines, user utterances,
a dev set, a word-vector table.  They do none of the jobs' work.

* corpus lines      ``documents``: ``text`` split on ``\\n`` → (doc_id, line_no, text)
* user utterances   ``conversations`` with role ``user``, non-blank lines
* generated text    ``conversations`` with role ``assistant``, non-blank lines
* dev set           ``benchmark`` lines, non-blank
* word vectors      ``embeddings``: the row with ``vec_id = r`` belongs to the token of frequency rank
                    r (0-based, ties by token) among Treebank tokens of the corpus lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varietas.functions import treebank_tokens
from varietas.operators.rows import with_row_index

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread rows over at least ``2 x defaultParallelism`` tasks before per-row CPU work.

    Only when the scan produced fewer splits (a small file with one row group); inputs made of
    many files or row groups are left untouched, so at scale this adds no shuffle.
    """
    target = min_partitions or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target)


def split_lines(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per ``\\n``-separated line: (keys..., line_no, text), spread over the cluster."""
    return balanced(df.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "text")))


def non_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop lines that are blank after ``rstrip(' \\n')``."""
    return df.where(F.length(F.regexp_replace(F.col(text_col), "[\n ]+$", "")) > 0)


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def conversation_lines(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == role).select("conv_id", "turn", "text")
    return non_blank(split_lines(conv, ["conv_id", "turn"]))


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, one row per non-blank line: (conv_id, turn, line_no, text)."""
    return conversation_lines(spark, sf_dir, "user")


def generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns standing in for generated text."""
    return conversation_lines(spark, sf_dir, "assistant")


def dev_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` lines: (item_id, line_no, text)."""
    return non_blank(split_lines(table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"]))


def ordered(lines: DataFrame, keys: list[str], name: str = "sent_id") -> DataFrame:
    """Attach the 1-based line order (file order) as ``name``."""
    return with_row_index(lines, [*keys, "line_no"], name)


def ordered_user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, text): user lines numbered in (conv_id, turn, line_no) order."""
    return ordered(user_lines(spark, sf_dir), ["conv_id", "turn"]).select("sent_id", "text")


def ordered_generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(generated_lines(spark, sf_dir), ["conv_id", "turn"]).select("sent_id", "text")


def ordered_dev_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(dev_lines(spark, sf_dir), ["item_id"]).select("sent_id", "text")


def most_frequent(counts: DataFrame, k: Column) -> DataFrame:
    """The rows (word, n) whose ``n`` is at least that of the k-th greatest: the first k, and all that tie with the last of them.

    The k-th greatest is read off the number of words per count, a row per distinct count; all rows where there are fewer than k.
    """
    falling = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_words")).select("n", F.sum("_words").over(falling).alias("_upto"))
    return counts.where(F.col("n") >= F.coalesce(upto.where(F.col("_upto") >= k).select(F.max("n")).scalar(), F.lit(0)))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, word, v): the embedding of rank r is assigned to the r-th most frequent corpus token.

    Ranks are the global row index of the vocabulary by falling frequency (range-partitioned sort) of the words
    that can have a rank up to the largest ``vec_id``.
    """
    emb = table(spark, sf_dir, "embeddings")
    toks = corpus_lines(spark, sf_dir).select(F.explode(treebank_tokens(F.col("text"))).alias("word"))
    counts = most_frequent(toks.groupBy("word").agg(F.count(F.lit(1)).alias("n")), emb.select(F.max("vec_id") + 1).scalar())
    ranked = with_row_index(counts, [F.col("n").desc(), F.col("word")], "rank").withColumn("rank", F.col("rank") - 1)
    return (emb.join(ranked, emb.vec_id == ranked["rank"])
            .select(F.col("rank").cast("int").alias("rank"), "word", F.col("embedding").alias("v")))


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, text): turn t and turn t+1 of a conversation as one ``source<TAB>target`` line,
    newlines inside a turn replaced by spaces."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    line = F.concat(F.regexp_replace("a.text", "\n", " "), F.lit("\t"), F.regexp_replace("b.text", "\n", " "))
    return j.select(F.concat_ws(":", F.col("a.conv_id").cast("string"), F.col("a.turn").cast("string")).alias("pair_id"),
                    line.alias("text"))
