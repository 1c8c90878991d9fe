"""Text-file readers and writers.

All readers are ``spark.read`` scans (parallel over files and splits); all writers are
``DataFrame.write`` (parallel, one file per task — never ``coalesce(1)``).  Line order, where a
format has one, is recovered from the file name, the split and the position inside the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varietas.functions import rstrip_line
from varietas.operators.rows import number_lines


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line with its file and 0-based position; large files are split."""
    return number_lines(_scan_lines(spark, path))


def _scan_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def read_sentences(spark: SparkSession, path: str, strip: str = "\n ") -> DataFrame:
    """(file, line_no, text), each line right-stripped of ``strip`` characters."""
    lines = _numbered_lines(spark, path)
    return lines.select("file", "line_no", rstrip_line(F.col("value"), strip).alias("text"))


def _observed(df: DataFrame, report: Observation | None, **metrics: Column) -> DataFrame:
    """``df`` whose scan also counts ``metrics`` into ``report`` (filled by the first action; read ``report.get``).

    What an action scans twice (a sort samples its input first) is counted twice: store the rows first."""
    return df.observe(report, *[m.alias(name) for name, m in metrics.items()]) if report is not None else df


def _where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def read_vectors(spark: SparkSession, path: str, maxtypes: int = 0, report: Observation | None = None) -> DataFrame:
    """word2vec text format → (rank, word, v array<float>); the header line (n dim) is skipped.
    Several part files count as one file in path order.

    The rank is the line position (most frequent first); ``maxtypes`` keeps the first ranks (W13).
    A word listed twice keeps its last vector (see ``normalize_vectors`` and :func:`drop_repeated_words`).
    ``report`` observes, in the same scan: ``header_n`` and ``header_dim`` as announced, ``rows``, ``malformed`` (no word or a
    number that is none), ``min_dim`` and ``max_dim`` of the rows.
    """
    lines = number_lines(_scan_lines(spark, path), across_files=True)
    fields = F.filter(F.split(F.trim("value"), " +"), lambda x: x != "")
    head, row = F.col("line_no") == 0, F.col("line_no") > 0
    numbers = F.filter(F.slice(fields, 2, 1 << 30), lambda x: x.try_cast("float").isNotNull())
    bad = row & ((F.substring("value", 1, 1).isin("", " ")) | (F.size(fields) < 2) | (F.size(numbers) < F.size(fields) - 1))
    lines = _observed(lines, report, header_n=F.max(F.when(head, F.get(fields, F.lit(0)).try_cast("long"))),
                      header_dim=F.max(F.when(head, F.get(fields, F.lit(1)).try_cast("int"))), rows=_where(row), malformed=_where(bad),
                      min_dim=F.min(F.when(row & ~bad, F.size(numbers))), max_dim=F.max(F.when(row & ~bad, F.size(numbers))))
    lines = lines.where(row & ~bad)
    first_space = F.instr("value", " ")
    body = lines.select((F.col("line_no") - 1).cast("int").alias("rank"),
                        F.substring("value", 1, first_space - 1).alias("word"),
                        F.expr("substr(value, instr(value, ' ') + 1)").alias("_rest"))
    body = body.where(F.col("word") != "")
    if maxtypes > 0:
        body = body.where(F.col("rank") < maxtypes)
    vec = F.transform(F.filter(F.split(F.trim("_rest"), " +"), lambda x: x != ""), lambda x: x.cast("float"))
    return body.select("rank", "word", vec.alias("v"))


def drop_repeated_words(vectors: DataFrame, report: Observation | None = None) -> DataFrame:
    """Vectors with one row per word, the last of its rows; ``report`` observes ``words`` and ``repeated`` (rows dropped)."""
    last = vectors.groupBy("word").agg(F.max_by(F.struct(*vectors.columns), "rank").alias("_v"), F.count(F.lit(1)).alias("_n"))
    last = _observed(last, report, words=F.count(F.lit(1)), repeated=F.sum(F.col("_n") - 1))
    return last.select("_v.*")


def write_vectors(vectors: DataFrame, path: str, vec_col: str = "v") -> None:
    """word2vec text format: header ``n dim``, then ``word f1 ... fd`` in rank order.

    The lines are range-partitioned by rank, so the part files in name order are the one ordered file.
    """
    body = vectors.select(F.col("rank").cast("long").alias("_r"),
                          F.concat_ws(" ", F.col("word"), F.array_join(F.col(vec_col).cast("array<string>"), " "))
                          .alias("value"))
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d"))
    header = stats.select(F.lit(-1).cast("long").alias("_r"),
                          F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("value"))
    header.unionByName(body).orderBy("_r").select("value").write.mode("overwrite").text(path)


def read_unigrams(spark: SparkSession, path: str, report: Observation | None = None) -> DataFrame:
    """S3: ``word p`` lines → (word, p).  Lines without a word and a number are dropped; ``report`` observes ``lines`` and
    ``malformed``."""
    t = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("f"))
    p = F.get("f", F.lit(1)).try_cast("double")
    bad = (F.size("f") < 2) | p.isNull()
    t = _observed(t, report, lines=F.count(F.lit(1)), malformed=_where(bad)).where(~bad)
    return t.select(F.col("f")[0].alias("word"), p.alias("p"))


def read_vocab(spark: SparkSession, path: str, report: Observation | None = None) -> DataFrame:
    """``symbol id`` lines → (token, id); lines with fewer than two fields are dropped; ``report`` observes ``lines`` and
    ``malformed``."""
    t = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("f"))
    bad = F.size("f") < 2
    t = _observed(t, report, lines=F.count(F.lit(1)), malformed=_where(bad)).where(~bad)
    return t.select(F.col("f")[0].alias("token"), F.col("f")[1].alias("id"))


def read_pairs(spark: SparkSession, path: str, report: Observation | None = None) -> DataFrame:
    """TSV pair lines → (pair_id, text) for :func:`varietas.plans.pairs.split_pairs`; ``report`` observes ``lines`` and
    ``malformed`` (not two fields)."""
    lines = _numbered_lines(spark, path)
    lines = _observed(lines, report, lines=F.count(F.lit(1)), malformed=_where(F.size(F.split("value", "\t")) != 2))
    return lines.select(F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("pair_id"),
                        F.col("value").alias("text"))


_CHUNK = "(?:/([0-9]+)\\.txt|/chunk_id=([0-9]+)/[^/]*)$"


def read_chunks(spark: SparkSession, directory: str, top_n: int | None = None) -> DataFrame:
    """Files ``000.txt``, ``001.txt`` ... ``1000.txt`` (any run of digits) → (chunk_id, line_no, text), chunks below ``top_n``.

    Folders ``chunk_id=N`` of text files, as :func:`write_chunks` makes them, are read alike.
    """
    lines = number_lines(_scan_lines(spark, directory).where(F.col("file").rlike(_CHUNK)))
    cid = F.coalesce(F.nullif(F.regexp_extract("file", _CHUNK, 1), F.lit("")), F.regexp_extract("file", _CHUNK, 2))
    lines = lines.withColumn("_chunk", cid).where(F.col("_chunk") != "")
    out = lines.select(F.col("_chunk").cast("int").alias("chunk_id"), "line_no", F.col("value").alias("text"))
    return out.where(F.col("chunk_id") < top_n) if top_n is not None else out


def write_lines(df: DataFrame, path: str, col: str = "text") -> None:
    """One line per row (parallel text output)."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_chunks(lines: DataFrame, path: str, order_col: str = "sent_id") -> None:
    """Chunk files: the lines (chunk_id, ``order_col``, text) of a chunk in order, as one text file in folder ``chunk_id=N``."""
    body = lines.select(F.col("chunk_id"), F.col(order_col).alias("_o"), F.col("text").alias("value"))
    body.repartition("chunk_id").sortWithinPartitions("chunk_id", "_o").select("chunk_id", "value") \
        .write.mode("overwrite").partitionBy("chunk_id").text(path)


def write_symbols(vocab: DataFrame, path: str) -> None:
    """S4's format: ``symbol id`` lines."""
    vocab.select(F.concat_ws(" ", "token", F.col("id").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_curve(spark: SparkSession, path: str, val_col: str = "ppl") -> DataFrame:
    """Read back the rows of :func:`write_curve`."""
    return spark.read.option("sep", "\t").schema(f"i long, {val_col} double").csv(path)


def write_unigrams(unigram_lines: DataFrame, path: str) -> None:
    """The ``word p`` lines of :func:`varietas.operators.vocab.unigram_lines`."""
    write_lines(unigram_lines, path, "line")


def write_curve(curve: DataFrame, path: str, i_col: str = "i", val_col: str = "ppl") -> None:
    """``i<TAB>value`` rows."""
    curve.select(i_col, val_col).write.mode("overwrite").option("sep", "\t").csv(path)


def save_paraphrases(store: DataFrame, path: str) -> None:
    """The paraphrase store as Parquet (the reference pickles a dict)."""
    store.write.mode("overwrite").parquet(path)


def load_paraphrases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Aligned source/target as one table (alignment by key, not by line position)."""
    pairs.select("pair_id", "source", "target").write.mode("overwrite").parquet(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Vocabulary rows (id, token, freq); ids carry the order, specials first."""
    vocab.write.mode("overwrite").parquet(path)


def save_lm(lm, path: str, stage: str = "lm", counts: DataFrame | None = None) -> None:
    """Save a stage — ``counts``, ``lm`` or ``pruned_lm`` — partitioned by order."""
    if stage == "counts":
        (counts if counts is not None else lm).write.mode("overwrite").partitionBy("ord").parquet(path)
        return
    lm.probs.write.mode("overwrite").partitionBy("ord").parquet(f"{path}/probs")
    lm.gammas.write.mode("overwrite").partitionBy("ord").parquet(f"{path}/gammas")
    lm.vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def load_lm(spark: SparkSession, path: str, order: int, method: str = "witten_bell"):
    """Re-enter the pipeline at the ``lm`` stage."""
    from varietas.operators.lm import LM
    return LM(order, method, spark.read.parquet(f"{path}/probs"), spark.read.parquet(f"{path}/gammas"),
              spark.read.parquet(f"{path}/vocab"))
