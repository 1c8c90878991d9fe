"""Line-at-a-time services as Structured Streaming jobs (ST1–ST3).

The reference reads stdin in a loop; here a directory of text files is the source, each new file
is one micro-batch (``maxFilesPerTrigger``), and ``foreachBatch`` runs the batch operator of the
service against the static tables (vectors, LM).  Ranking windows are not allowed on streaming
frames, which is why the work happens inside ``foreachBatch`` on an ordinary DataFrame.

Each micro-batch is written to ``<sink>/epoch=<id>`` with ``overwrite``: a batch that is retried
after a failure replaces its own output, so the sink holds every batch exactly once.  The
checkpoint location lives under the session's reliable checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.functions import treebank_tokens
from varietas.operators import neighbours as N
from varietas.operators.rows import number_lines, with_row_index
from varietas.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def line_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming (file, _block, text) lines of text files, one file per micro-batch by default; large files are split."""
    lines = (spark.readStream.format("text").option("lineSep", "\n")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.col("value").alias("text"))


def run_service(spark: SparkSession, source_dir: str, service: Callable[[DataFrame], DataFrame], sink_dir: str,
                checkpoint_location: str | None = None, available_now: bool = True, max_files_per_trigger: int = 1):
    """Start the stream: every micro-batch of lines (file, line_no, text) goes through ``service``; output by epoch."""
    ckpt = checkpoint_location or scratch_dir(spark, "stream-ckpt")

    def batch(df: DataFrame, epoch_id: int) -> None:
        service(number_lines(df)).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}")

    writer = (line_stream(spark, source_dir, max_files_per_trigger).writeStream
              .foreachBatch(batch).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def word_query_service(vectors: DataFrame, mode: str = "nearest", k: int = 10) -> Callable[[DataFrame], DataFrame]:
    """ST3: each line is a word (right-stripped of ``\\n``); nearest words or the vector line (P6), for every line."""
    key = "query" if mode == "nearest" else "word"

    def svc(lines: DataFrame) -> DataFrame:
        words = lines.select("file", "line_no", F.regexp_replace("text", "[\n ]+$", "").alias(key)).where(F.col(key) != "")
        return words.join(N.word_queries(words.select(F.col(key).alias("word")), vectors, mode, k), key)
    return svc


def lex_alternatives_service(vectors: DataFrame, dist_flag: bool = True, num_alts: int = 10) -> Callable[[DataFrame], DataFrame]:
    """ST1: each line = target word + context words (Treebank tokens) (P5); a repeated line is searched
    once per batch and answered every time: (file, line_no, text, rn, word, score)."""
    def svc(lines: DataFrame) -> DataFrame:
        ids = with_row_index(lines.select("text").distinct(), ["text"], "qid")
        t = ids.select("qid", treebank_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
        q = t.select("qid", F.col("t")[0].alias("target"), F.slice("t", 2, 1 << 30).alias("context"))
        found = N.lex_alternatives(q, vectors, dist_flag=dist_flag, num_alts=num_alts)
        return lines.join(ids, "text").join(found, "qid").select("file", "line_no", "text", "rn", "word", "score")
    return svc


def paraphrase_service(vectors: DataFrame, lm, k: int = 100) -> Callable[[DataFrame], DataFrame]:
    """ST2: each non-blank line is paraphrased (P1); a repeated line is decoded once per batch and
    answered every time: (file, line_no, text, rank, sent, score, new_score)."""
    from varietas.plans.paraphrase import paraphrase

    def svc(lines: DataFrame) -> DataFrame:
        some = lines.where(F.length(F.regexp_replace("text", "[\n ]+$", "")) > 0)
        ids = with_row_index(some.select("text").distinct(), ["text"], "sent_id")
        return some.join(ids, "text").join(paraphrase(ids, vectors, lm, k=k), "sent_id").drop("sent_id")
    return svc


def serve_lines(spark: SparkSession, lines: DataFrame, service: Callable[[DataFrame], DataFrame],
                files: int = 4, text_col: str = "text") -> DataFrame:
    """Write ``lines`` as ``files`` text files, stream them through ``service`` and read the results.

    ``files`` is the number of micro-batches; a large file is read in many splits.
    Used by the registered streaming queries: the input comes from the driver tables, the output is
    everything the stream produced.
    """
    src = scratch_dir(spark, "stream-src")
    sink = scratch_dir(spark, "stream-out")
    lines.select(text_col).repartition(files).write.text(src)
    q = run_service(spark, src, service, sink)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("epoch")
