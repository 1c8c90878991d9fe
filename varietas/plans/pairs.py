"""Parallel (source, target) pair data for sequence models.

The neural training itself is not built; these are the data steps around it: split TSV lines,
vocabularies, length filter, reproducible shuffle, length buckets and batches, id encoding, and
corpus BLEU of predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions import split_whitespace
from varietas.operators import vocab as V
from varietas.operators.rows import with_row_index


def split_pairs(lines: DataFrame, text_col: str = "text", key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(good, rejected) — lines with exactly two tab-separated fields become (key, source, target)."""
    parts = F.split(F.regexp_replace(F.col(text_col), "\n$", ""), "\t")
    t = lines.withColumn("_parts", parts)
    good = t.where(F.size("_parts") == 2).select(key, F.col("_parts")[0].alias("source"),
                                                 F.col("_parts")[1].alias("target"))
    bad = t.where(F.size("_parts") != 2).select(key, text_col)
    return good, bad


def filter_pair_length(pairs: DataFrame, max_source: int = 70, max_target: int = 70) -> DataFrame:
    """keep pairs with at most ``max_source`` / ``max_target`` whitespace tokens."""
    return pairs.where((F.size(split_whitespace(F.col("source"))) <= max_source) &
                       (F.size(split_whitespace(F.col("target"))) <= max_target))


def prepare_pairs(pairs: DataFrame, seed: int = 0, bucket_width: int = 5, batch_size: int = 64,
                  max_source: int = 70, max_target: int = 70, key: str = "pair_id") -> DataFrame:
    """Length filter, reproducible shuffle, buckets of source length (width 5), batches of 64.

    Returns (key, src_len, bucket, batch_id).  Positions inside a bucket come from one global
    row index over (bucket, shuffle key) minus the bucket's first index — no window per bucket,
    so a bucket holding most pairs is still spread over many tasks.
    """
    f = filter_pair_length(pairs, max_source, max_target)
    f = f.select(key, F.size(split_whitespace(F.col("source"))).alias("src_len"))
    f = f.withColumn("bucket", F.ceil(F.col("src_len") / F.lit(bucket_width)).cast("int"))
    f = f.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    idx = with_row_index(f, ["bucket", "_h", key], "_rn")
    first = idx.groupBy("bucket").agg(F.min("_rn").alias("_first"))
    out = idx.join(F.broadcast(first), "bucket")      # one row per bucket: at most max_source/width + 1
    return out.select(key, "src_len", "bucket",
                      ((F.col("_rn") - F.col("_first")) / F.lit(batch_size)).cast("long").alias("batch_id"))


def encode(pairs: DataFrame, vocab: DataFrame, col: str = "source", key: str = "pair_id") -> DataFrame:
    """Whitespace tokens → vocabulary ids; unknown tokens get the id one past the last entry."""
    long = pairs.select(key, F.posexplode(split_whitespace(F.col(col))).alias("pos", "token"))
    unk_id = vocab.select(F.max("id") + 1).scalar()
    j = long.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", unk_id))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_s"))
    out = pairs.select(key).join(g, key, "left")
    ids = F.coalesce(F.col("_s.id"), F.array().cast("array<long>"))
    return out.select(key, F.array_join(ids.cast("array<string>"), " ").alias("ids"))


def _ngrams(df: DataFrame, col: str, key: str, max_n: int) -> DataFrame:
    df = df.select(key, split_whitespace(F.col(col)).alias("_toks"))
    toks = F.col("_toks")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_n)), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(0))),
        lambda i: F.struct(n.alias("n"), F.array_join(F.slice(toks, i, n), " ").alias("g")))))
    # sequence(1, 0) would count down: positions only exist when the line has n tokens
    grams = F.filter(grams, lambda s: F.size(toks) >= s["n"])
    return df.select(key, F.inline(grams)).groupBy(key, "n", "g").agg(F.count(F.lit(1)).alias("c"))


def bleu(pairs: DataFrame, hyp: str = "target", ref: str = "source", key: str = "pair_id", max_n: int = 4) -> DataFrame:
    """Corpus BLEU with one reference (Papineni et al. 2002): clipped n-gram precisions 1..4,
    geometric mean, brevity penalty.  Returns one row (bleu, p1..p4, hyp_len, ref_len)."""
    h = _ngrams(pairs, hyp, key, max_n)
    r = _ngrams(pairs, ref, key, max_n).withColumnRenamed("c", "rc")
    clip = h.join(r, [key, "n", "g"], "left").select("n", "c", F.least("c", F.coalesce("rc", F.lit(0))).alias("m"))
    per_n = clip.groupBy("n").agg(F.sum("m").alias("match"), F.sum("c").alias("total"))
    lens = pairs.agg(F.sum(F.size(split_whitespace(F.col(hyp)))).alias("hyp_len"),
                     F.sum(F.size(split_whitespace(F.col(ref)))).alias("ref_len"))
    wide = per_n.agg(*[F.max(F.when(F.col("n") == n, F.col("match") / F.col("total"))).alias(f"p{n}")
                       for n in range(1, max_n + 1)])
    out = wide.withColumn("hyp_len", lens.select("hyp_len").scalar()) \
        .withColumn("ref_len", lens.select("ref_len").scalar())
    logs = [F.log(F.col(f"p{n}")) for n in range(1, max_n + 1)]
    all_pos = F.greatest(*[F.coalesce(F.col(f"p{n}"), F.lit(0.0)) for n in range(1, max_n + 1)]) > 0
    any_zero = F.least(*[F.coalesce(F.col(f"p{n}"), F.lit(0.0)) for n in range(1, max_n + 1)]) <= 0
    geo = F.exp(sum(logs) / F.lit(float(max_n)))
    bp = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    score = F.when(any_zero | ~all_pos, F.lit(0.0)).otherwise(bp * geo)
    return out.select(score.alias("bleu"), *[f"p{n}" for n in range(1, max_n + 1)], "hyp_len", "ref_len")
