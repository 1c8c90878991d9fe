"""Sentence paraphrasing by lattice decoding, and artificial word error rate.

``paraphrase`` builds, for every token of every sentence, a slot of alternatives — the token itself
(or ``<unk>`` when the LM does not know it) at cost 0 and, for replaceable tokens, their nearest
vector neighbours with similarity > 0.1 that the LM knows, at cost -ln(sim)/1000 — and decodes the
k best strings under the n-gram LM.  Neighbour search runs once per *distinct* word, decoding once
per *distinct* sentence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions import arc_cost, treebank_tokens
from varietas.operators import lm as L
from varietas.operators import neighbours as N
from varietas.operators import sampling as SMP
from varietas.operators.decode import nbest, rank_strings
from varietas.operators.ngrams import UNK
from varietas.operators.rows import with_row_index
from varietas.operators.vocab import restore_multiplicity
from varietas.session import checkpoint

# Words never replaced by a neighbour (besides tokens starting with an apostrophe).
STOP_WORDS = ('have', 'has', 'had', 'is', 'are', 'am', 'was', 'were', 'be', '.', ',', ':', '?',
              '!', '-', '--', 'of')
# Neighbours per word, minimum similarity, arc cost divisor is in arc_cost.
NUM_NEAR = 5
MIN_SIM = 0.1
# Part-of-speech prefixes that may be replaced (every word is tagged NN when no tagger runs).
REPLACEABLE_TAGS = ("NN", "JJ", "RB", "VB")


def is_replaceable(word: Column, tag: Column | None = None) -> Column:
    """not a stop word, no leading apostrophe, and (when tags are given) a replaceable tag."""
    ok = ~word.isin(*STOP_WORDS) & ~word.startswith("'")
    if tag is not None:
        ok = ok & F.greatest(*[tag.startswith(t) for t in REPLACEABLE_TAGS])
    return ok


def sentence_tokens(sentences: DataFrame, key: str = "sent_id", text_col: str = "text") -> DataFrame:
    return sentences.select(key, F.posexplode(treebank_tokens(F.col(text_col))).alias("pos", "word"))


def lattice(sentences: DataFrame, vectors: DataFrame, lm: L.LM, key: str = "sent_id", text_col: str = "text",
            num_near: int = NUM_NEAR, min_sim: float = MIN_SIM) -> DataFrame:
    """(key, pos, word, cost, orig): the slots of every sentence."""
    toks = sentence_tokens(sentences, key, text_col)
    vocab = lm.vocab.select(F.col("w").alias("_v"))
    orig = toks.join(vocab, toks.word == vocab._v, "left").select(
        key, "pos", F.coalesce(F.col("_v"), F.lit(UNK)).alias("word"), F.lit(0.0).alias("cost"),
        F.lit(True).alias("orig"))
    repl = toks.where(is_replaceable(F.col("word")))
    nb = N.near(repl.select("word"), vectors, num_near)
    nb = nb.where((F.col("sim") > F.lit(min_sim)) & (F.col("word") != F.col("query")))          # F2
    nb = nb.join(vocab, nb.word == vocab._v, "left_semi")                                        # J10
    alt = repl.join(nb.select(F.col("query").alias("word"), F.col("word").alias("alt"), "sim"), "word")
    alt = alt.select(key, "pos", F.col("alt").alias("word"), arc_cost(F.col("sim")).alias("cost"),
                     F.lit(False).alias("orig"))
    return orig.unionByName(alt)


def rescore(df: DataFrame, scorer: str | L.LM | Callable[[DataFrame], DataFrame] = "identity",
            key: str = "sent_id") -> DataFrame:
    """Attach ``new_score`` to scored strings (key, rank, sent, score).

    ``identity`` copies the decoding score; an :class:`LM` gives each string's perplexity under it;
    any other callable maps the frame to one with ``new_score`` (e.g. a model via ``mapInPandas``).
    """
    if scorer == "identity":
        return df.withColumn("new_score", F.col("score"))
    if isinstance(scorer, L.LM):
        df = checkpoint(df)        # read twice below: the scored strings are not decoded twice
        ids = df.withColumn("_rid", F.concat_ws("\u0001", F.col(key).cast("string"), F.col("rank").cast("string")))
        ppl = L.perplexity(L.score(ids.select("_rid", F.col("sent").alias("text")), scorer, key="_rid"), by=["_rid"])
        # rounded: a line and its own best string must not differ by the order of a sum
        return ids.join(ppl.select("_rid", F.round("ppl", 9).alias("new_score")), "_rid").drop("_rid")
    return scorer(df)


def cutoff_filter(df: DataFrame, cutoff: float | Column | None) -> DataFrame:
    """keep strings with new_score ≤ cutoff; ``None`` turns the filter off."""
    if cutoff is None:
        return df
    c = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    return df.where(c.isNull() | (F.col("new_score") <= c))


def paraphrase(sentences: DataFrame, vectors: DataFrame, lm: L.LM, k: int = 5, cutoff: float | Column | None = None,
               rescorer="identity", key: str = "sent_id", text_col: str = "text") -> DataFrame:
    """(key, rank, sent, score, new_score) — the k best paraphrases of each sentence."""
    slots = lattice(sentences, vectors, lm, key, text_col)
    best = nbest(slots.select(key, "pos", "word", "cost"), lm, k, key)
    best = rescore(best, rescorer, key)
    ranked = rank_strings(best.drop("rank"), key, k)
    return cutoff_filter(ranked, cutoff).select(key, "rank", "sent", "score", "new_score")


def paraphrase_corpus(lines: DataFrame, vectors: DataFrame, lm: L.LM, k: int = 5, conservative: bool = False,
                      rescorer="identity", text_col: str = "text") -> DataFrame:
    """Paraphrase each distinct line once (A4) and repeat its results per occurrence (U4).

    ``conservative``: the rescorer's score of the original line is its cutoff (J4) — only
    paraphrases at least as good as the original survive.
    Returns (line, copy, rank, sent, new_score).
    """
    uniq = (lines.select(F.regexp_replace(F.col(text_col), "[\n ]+$", "").alias("line"))
            .groupBy("line").agg(F.count(F.lit(1)).alias("num")))
    uniq = with_row_index(uniq, ["line"], "sid")        # short numeric keys: arcs do not carry the line
    cutoff = None
    if conservative:
        base = rescore(uniq.select(F.col("sid").alias("sent_id"), F.lit(1).alias("rank"), F.col("line").alias("sent"),
                                   F.lit(0.0).alias("score")), rescorer)
        uniq = uniq.join(base.select(F.col("sent_id").alias("sid"), F.col("new_score").alias("baseline")), "sid", "left")
        cutoff = F.col("baseline")
    para = paraphrase(uniq.select(F.col("sid").alias("sent_id"), F.col("line").alias("text")), vectors, lm, k,
                      None, rescorer)
    j = uniq.join(para.withColumnRenamed("sent_id", "sid"), "sid")
    if conservative:
        j = cutoff_filter(j, cutoff)
    return restore_multiplicity(j.select("line", "num", "rank", "sent", "new_score")).select("line", "copy", "rank", "sent", "new_score")


def training_sets_from_store(train: DataFrame, store: DataFrame, np_: int = 100, rn_col: str = "sent_id",
                             text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored paraphrases of every training line, tagged with the first prefix p holding it.

    Training set i is the rows with ``p <= i`` — all np sets in one pass.  Lines with no stored
    entry are returned in the second frame (the reference stops with a missing-key error).
    """
    from varietas.operators.rows import first_prefix, row_count
    t = train.select(rn_col, F.regexp_replace(F.col(text_col), "[\n ]+$", "").alias("line"))
    t = t.withColumn("p", first_prefix(F.col(rn_col), row_count(train), np_))
    found = t.join(store, "line")
    missing = t.join(store.select("line").distinct(), "line", "left_anti")
    return found, missing


# ------------------------------------------------------------------------------------------------
# Artificial word error rate
# ------------------------------------------------------------------------------------------------

def awer_lattice(dev: DataFrame, unigram_table: DataFrame, lm: L.LM, seed: int = 0, key: str = "sent_id",
                 text_col: str = "text") -> DataFrame:
    """(key, pos, word, cost, orig_word): per token the word (or <unk>) and one unigram draw."""
    toks = sentence_tokens(dev, key, text_col)
    vocab = lm.vocab.select(F.col("w").alias("_v"))
    orig = toks.join(vocab, toks.word == vocab._v, "left").select(
        key, "pos", F.coalesce(F.col("_v"), F.lit(UNK)).alias("lm_word"), F.col("word").alias("orig_word"))
    draws = toks.withColumn("k", SMP.draw60(seed, F.col(key), F.col("pos")))
    alt = SMP.draw_words(draws, SMP.cdf(unigram_table))
    alt = alt.join(vocab, alt.alt == vocab._v, "left_semi").where(F.col("alt") != F.col("word"))      # F8
    a = alt.select(key, "pos", F.col("alt").alias("word"), F.lit(0.0).alias("cost"), F.col("word").alias("orig_word"))
    o = orig.select(key, "pos", F.col("lm_word").alias("word"), F.lit(0.0).alias("cost"), "orig_word")
    return o.unionByName(a)


def awer(dev: DataFrame, unigram_table: DataFrame, lm: L.LM, seed: int = 0, key: str = "sent_id",
         text_col: str = "text") -> DataFrame:
    """One row (awer, n_lines): mean over dev lines of (changed positions / tokens) in the 1-best
    decoding of each line's lattice; an empty line counts 0 but stays in the denominator, and a line
    with no path under the model counts 1 (all its positions)."""
    slots = checkpoint(awer_lattice(dev, unigram_table, lm, seed, key, text_col))      # read for the search and for the words
    best = nbest(slots.select(key, "pos", "word", "cost"), lm, 1, key)
    toks = slots.select(key, "pos", "orig_word").distinct().groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("orig_word").alias("word")))).alias("_s"))
    j = dev.select(key).join(toks, key, "left").join(best.select(key, "sent"), key, "left")
    words = F.coalesce(F.col("_s.word"), F.array().cast("array<string>"))
    j = j.select(words.alias("_words"), "sent")
    return j.agg(F.avg(error_rate(F.col("_words"), F.col("sent"))).alias("awer"), F.count(F.lit(1)).alias("n_lines"))


def error_rate(words: Column, sent: Column) -> Column:
    """Share of positions whose decoded word differs; no words: 0, no path (null): 1."""
    out = F.split(F.coalesce(sent, F.lit("")), " ")
    n = F.size(words)
    same = F.size(F.filter(F.zip_with(words, out, lambda a, b: a == b), lambda x: x))
    return F.when(n > 0, (n - same) / n).otherwise(F.lit(0.0))
