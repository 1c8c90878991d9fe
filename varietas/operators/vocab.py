"""Frequency tables and vocabularies.

All of them are ``groupBy`` aggregations (Spark combines map-side, so a token holding a third of the
corpus costs one partial row per task, not a third of the shuffle) and equi-joins on the token.
Where tokens are joined back to their sentences, the per-token table is joined on the token: AQE's
skew-join split handles a hot token on the occurrence side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions import split_whitespace, treebank_tokens
from varietas.operators.rows import div

UNK = "<unk>"


def tokens_of(lines: DataFrame, text_col: str = "text", tokenizer: str = "treebank",
              keys: list[str] | None = None, with_pos: bool = False) -> DataFrame:
    """Long form (keys..., [pos,] tok) of a line table, Treebank (T1) or whitespace (T3) tokens."""
    arr = treebank_tokens(F.col(text_col)) if tokenizer == "treebank" else split_whitespace(F.col(text_col))
    keys = keys or []
    if with_pos:
        return lines.select(*keys, F.posexplode(arr).alias("pos", "tok"))
    return lines.select(*keys, F.explode(arr).alias("tok"))


def unigrams(tokens: DataFrame, tok_col: str = "tok") -> DataFrame:
    """(word, n, p): count per token type and relative frequency p = n / total tokens (A1)."""
    counts = tokens.groupBy(F.col(tok_col).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    # the total is summed from the same aggregate, so its shuffle is reused, not recomputed
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn("p", F.col("n") / total)


def corpus_stats(tokens: DataFrame, tok_col: str = "tok", approximate: bool = False) -> DataFrame:
    """One row (n_tokens, n_types) (A2). ``approximate`` uses HyperLogLog++ for the type count."""
    types = F.approx_count_distinct(tok_col) if approximate else F.count_distinct(tok_col)
    return tokens.agg(F.count(F.lit(1)).alias("n_tokens"), types.alias("n_types"))


def oov(train_tokens: DataFrame, dev_tokens: DataFrame, tok_col: str = "tok") -> DataFrame:
    """One row (types, oovs): training types, and dev *tokens* whose type is not in training."""
    vocab = train_tokens.select(F.col(tok_col).alias("_t")).distinct()
    missing = dev_tokens.join(vocab, dev_tokens[tok_col] == vocab["_t"], "left_anti")
    return (vocab.agg(F.count(F.lit(1)).alias("types"))
            .withColumn("oovs", missing.select(F.count(F.lit(1))).scalar()))


def dedupe_counts(lines: DataFrame, text_col: str = "text", order_col: str | None = "sent_id") -> DataFrame:
    """Sentence multiset (A4): (text, num[, first]) — how often each identical line occurs."""
    aggs = [F.count(F.lit(1)).alias("num")]
    if order_col:
        aggs.append(F.min(order_col).alias("first"))
    return lines.groupBy(text_col).agg(*aggs)


def restore_multiplicity(df: DataFrame, num_col: str = "num", block: int = 10_000) -> DataFrame:
    """Bag semantics (U4): repeat each row ``num`` times (adds ``copy`` 1..num).

    A row of more than ``block`` copies is first cut into blocks of that many, which are dealt over the
    tasks, so one very popular line is not expanded in one task.
    """
    n = F.col(num_col).cast("long")
    few = df.where((n >= 1) & (n <= block)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    blocks = df.where(n > block).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), div(n - 1, F.lit(block)))))
    first = F.col("_block") * block
    many = blocks.repartition("_block", *df.columns).withColumn(
        "copy", F.explode(F.sequence(first + 1, F.least(first + block, n)))).drop("_block")
    return few.unionByName(many)


def _regroup(long: DataFrame, keys: list[str], tok: Column, name: str) -> DataFrame:
    """(keys, pos, tok) → (keys, name array) in position order."""
    return (long.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), tok.alias("t")))).alias("_s"))
            .select(*keys, F.col("_s.t").alias(name)))


def replace_rare(sentences: DataFrame, n: int = 1, key: str = "sent_id", text_col: str = "text",
                 unk: str = UNK) -> DataFrame:
    """Whitespace tokens with corpus frequency ≤ n become ``<unk>`` (A5); line order is kept.

    Returns (key, toks array, text).  Lines with no tokens come back with an empty array.
    """
    long = sentences.select(key, F.posexplode(split_whitespace(F.col(text_col))).alias("pos", "tok"))
    counts = long.groupBy("tok").agg(F.count(F.lit(1)).alias("_c"))
    marked = long.join(counts, "tok")
    tok = F.when(F.col("_c") > F.lit(n), F.col("tok")).otherwise(F.lit(unk))
    grouped = _regroup(marked, [key], tok, "toks")
    out = sentences.select(key).join(grouped, key, "left")
    toks = F.coalesce(F.col("toks"), F.array().cast("array<string>"))
    return out.select(key, toks.alias("toks"), F.array_join(toks, " ").alias("text"))


def map_unknown(sentences: DataFrame, vocab: DataFrame, key: str = "sent_id", text_col: str = "text",
                vocab_col: str = "token", unk: str = UNK, drop_rate: float = 0.0, seed: int | str = 0) -> DataFrame:
    """Tokens not in ``vocab`` become ``unk`` (J6, L10); returns (key, toks, text).

    With ``drop_rate`` a known token becomes ``unk`` as well where its seeded draw (M8: 60 bits of md5 over seed, key
    and 0-based position) falls below the rate, so a model trained on the result has seen unknown words.
    """
    long = sentences.select(key, F.posexplode(split_whitespace(F.col(text_col))).alias("pos", "tok"))
    v = vocab.select(F.col(vocab_col).alias("_v")).distinct()
    marked = long.join(v, long.tok == v._v, "left")
    keep = F.col("_v").isNotNull()
    if drop_rate:
        from varietas.operators.sampling import draw60
        keep = keep & (draw60(seed, F.col(key), F.col("pos")) >= F.lit(int(drop_rate * (1 << 60))))
    tok = F.when(keep, F.col("tok")).otherwise(F.lit(unk))
    grouped = _regroup(marked, [key], tok, "toks")
    out = sentences.select(key).join(grouped, key, "left")
    toks = F.coalesce(F.col("toks"), F.array().cast("array<string>"))
    return out.select(key, toks.alias("toks"), F.array_join(toks, " ").alias("text"))


# The three special tokens that open a sequence-model vocabulary.
SPECIAL_TOKENS = ("<blank>", "<s>", "</s>")


def build_vocab(lines: DataFrame, text_col: str = "text", max_size: int = 80000, min_freq: int = 2,
                specials: tuple[str, ...] = SPECIAL_TOKENS) -> DataFrame:
    """(id, token, freq): specials first (freq 0), then whitespace tokens with freq ≥ min_freq, most frequent
    first (ties by token), at most ``max_size`` of them (A6, F6).

    The cut is a distributed top-k (TakeOrderedAndProject); numbering runs over at most
    ``max_size`` rows.
    """
    from pyspark.sql import Window
    counts = (lines.select(F.explode(split_whitespace(F.col(text_col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
              .where(F.col("freq") >= F.lit(min_freq))
              .where(~F.col("token").isin(*specials)))
    top = counts.orderBy(F.col("freq").desc(), F.col("token")).limit(max_size)
    ranked = top.select((F.row_number().over(Window.orderBy(F.col("freq").desc(), F.col("token")))
                         + F.lit(len(specials) - 1)).alias("id"), "token", "freq")
    spark = lines.sparkSession
    head = spark.createDataFrame([(i, t) for i, t in enumerate(specials)], "id int, token string")
    head = head.select(F.col("id").cast("int"), "token", F.lit(0).cast("long").alias("freq"))
    return head.unionByName(ranked.select(F.col("id").cast("int"), "token", "freq"))


def unigram_lines(unigram_table: DataFrame, decimals: int = 5) -> DataFrame:
    """``word p`` lines with p to ``decimals`` places.

    The rounding is done on the exact ratio n/total in integer arithmetic (half up), so the text
    does not depend on how a double is printed.
    """
    scale = 10 ** decimals
    total = unigram_table.select(F.sum("n")).scalar()
    q = div(F.col("n") * F.lit(2 * scale) + total, F.lit(2) * total)
    frac = F.lpad((q % F.lit(scale)).cast("string"), decimals, "0")
    return unigram_table.select(F.concat_ws(" ", F.col("word"),
                                            F.concat(div(q, F.lit(scale)).cast("string"),
                                                     F.lit("."), frac)).alias("line"))
