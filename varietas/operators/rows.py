"""Line order and prefixes (H1, W10–W14): global row numbers without a one-partition window.

A text corpus is an *ordered* list of lines; Spark rows have no order.  :func:`with_row_index`
sorts by the given key (range partitioning, so a hot key range is split across tasks), tags rows
with ``monotonically_increasing_id`` (partition id in the upper bits, position below), checkpoints
that into the reliable checkpoint folder so a recomputation cannot move a row to another partition,
and turns the tag into a dense 1-based index with per-partition offsets.  The offset table has one
row per partition, so broadcasting it is bounded by ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.session import checkpoint


def with_row_index(df: DataFrame, order_by: list[str | Column], name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order ``order_by``."""
    tagged = checkpoint(df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    per_part = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"),
                                                     F.min("_mid").alias("_base"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", "_base",
                              F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
    return out.select(*df.columns, (F.col("_off") + F.col("_mid") - F.col("_base") + 1).alias(name))


def number_lines(lines: DataFrame, across_files: bool = False) -> DataFrame:
    """(file, _block, ...) lines as scanned → (file, line_no, ...) with the 0-based position in the file.

    A file may be cut into many splits.  A split's lines stay together and in order in one task, so a
    line's position is its place in the split plus the lines of the file's earlier splits; the table of
    splits has one row per split.  The tagged scan is checkpointed, so that a recomputation cannot deal
    the splits anew.  ``across_files`` counts on over the files in path order.
    """
    tagged = checkpoint(lines.withColumn("_mid", F.monotonically_increasing_id()))
    splits = tagged.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    order = Window.orderBy("file", "_block") if across_files else Window.partitionBy("file").orderBy("_block")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_off", F.coalesce(before, F.lit(0))).drop("_n")
    rest = [c for c in lines.columns if c not in ("file", "_block")]
    return tagged.join(splits, ["file", "_block"]).select(
        "file", (F.col("_off") + F.col("_mid") - F.col("_base")).alias("line_no"), *rest)


def div(a: Column, b: Column) -> Column:
    """Integer quotient of longs (exact, unlike a division of doubles)."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def running_totals(df: DataFrame, i_col: str, cols: list[str], block: int = 4096) -> DataFrame:
    """(i, cols): running sums over ``i`` of a table with one row per i, in two levels: inside blocks of ``block``
    consecutive values, and over the blocks' totals."""
    b = div(F.col(i_col), F.lit(block))
    rows = df.select(i_col, *cols, b.alias("_b"))
    totals = rows.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)       # one row per block
    carried = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in cols])
    inside = Window.partitionBy("_b").orderBy(i_col)
    out = rows.select("_b", i_col, *[F.sum(c).over(inside).alias(c) for c in cols]).join(carried, "_b")
    return out.select(i_col, *[(F.col(c) + F.col(f"_t_{c}")).alias(c) for c in cols])


def row_count(df: DataFrame) -> Column:
    """Number of rows of ``df`` as a scalar-subquery column (no action, no join)."""
    return df.select(F.count(F.lit(1))).scalar()


def first_prefix(rn: Column, n: Column, np_: int) -> Column:
    """First nested prefix that contains line ``rn`` when prefix i holds ``int(n*i/np)`` lines.

    Line rn (1-based) is in prefix i iff rn <= floor(n*i/np) iff i >= ceil(rn*np/n).
    """
    return div(rn * F.lit(np_) + n - 1, n)   # integer ceil(rn*np/n)


def prefix_partitions(lines: DataFrame, np_: int = 100, max_p: int = 100, rn_col: str = "rn") -> DataFrame:
    """Tag each line with ``p`` = first prefix containing it; lines of no prefix ≤ max_p are dropped.

    ``lines`` must carry the 1-based order column ``rn_col``.  Prefix i (1..max_p) is the set of lines
    with ``p <= i`` — nested, computed in one pass instead of max_p copies (C1).
    """
    tagged = lines.withColumn("p", first_prefix(F.col(rn_col), row_count(lines), np_))
    return tagged.where(F.col("p") <= F.lit(min(max_p, np_)))


def tail_split(lines: DataFrame, ratio: float = 0.1, rn_col: str = "rn") -> tuple[DataFrame, DataFrame]:
    """(train, dev): the last ``int(ratio*n)`` lines are dev (W12).  A count of 0 gives an empty dev."""
    n = row_count(lines)
    n_dev = F.floor(F.lit(float(ratio)) * n)
    is_dev = F.col(rn_col) > n - n_dev
    return lines.where(~is_dev), lines.where(is_dev)


def chunk_ids(lines: DataFrame, chunk_size: int = 64, rn_col: str = "rn") -> DataFrame:
    """Chunk number of each line, ``(rn-1) div chunk_size`` (S6 stand-in: files 000.txt, 001.txt ...)."""
    return lines.withColumn("chunk_id", div(F.col(rn_col) - 1, F.lit(chunk_size)))


def prefix_lines(lines: DataFrame, m: int | Column, rn_col: str = "rn") -> DataFrame:
    """First m lines (W10, ``head -m``)."""
    m_col = m if isinstance(m, Column) else F.lit(m)
    return lines.where(F.col(rn_col) <= m_col)


def shuffle(lines: DataFrame, seed: int | str = 0, key: str = "sent_id", name: str = "shuffled_rank") -> DataFrame:
    """A reproducible permutation — position by ``md5(seed:key)`` (ties by key), 1-based."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return with_row_index(lines.withColumn("_h", h), ["_h", key], name).drop("_h")
