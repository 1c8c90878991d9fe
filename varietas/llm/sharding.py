"""Sharding by extendible hashing: a directory of hash prefixes, split only where a bucket is too big.

A document's hash is 60 bits of md5 of its id; a bucket is a prefix of those bits.  A bucket over the
byte limit splits on its next bit, others stay, so a shard is the shortest prefix whose documents fit.
Splitting works on sums, not documents: each pass takes the open buckets, sums bytes of their
documents by the next ``STEP`` bits (partial aggregation, at most 2**STEP sums per open bucket), and
closes every prefix that fits.  Passes end when no bucket is open, about log2(bytes / limit) / STEP.

Documents that share all 60 bits (repeated rows of one id) cannot be parted by bits: they go to
numbered overflow pages of their bucket.  One document above the limit is a
page, or a bucket, of its own.  A null text has 0 bytes; a null id hashes as the text "null"; an
empty table gives no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import small, store
from varietas.operators.rows import with_row_index

LIMIT_BYTES = 32 << 20
BITS = 60
STEP = 8


def hash_bits(c: Column) -> Column:
    """60 bits of md5 of the id's text as a non-negative long."""
    text = F.coalesce(c.cast("string"), F.lit("null")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")



def directory(sizes: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(depth, prefix, bytes, n_docs, overflow) of every bucket from (h, bytes).

    Buckets are disjoint prefixes covering all rows; ``overflow`` marks a full-depth bucket whose rows
    do not fit together.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n_docs")).select(
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "bytes", "n_docs").where("n_docs > 0")
    level = store(total)
    closed = [level.where(F.col("bytes") <= limit)]
    open_ = level.where(F.col("bytes") > limit)
    depth = 0
    while depth < BITS and open_.limit(1).count():
        deeper = min(depth + STEP, BITS)
        at = sizes.withColumn("prefix", F.shiftright("h", BITS - depth)) if depth else sizes.withColumn("prefix", F.lit(0).cast("long"))
        cells = (at.join(small(open_.select("prefix")), "prefix", "left_semi")
                 .groupBy(F.shiftright("h", BITS - deeper).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_docs")))
        cells = store(cells)
        # sums at each of the next bits; a prefix is a bucket if it fits and its parent did not
        ladder = cells.select(F.explode(F.sequence(F.lit(depth + 1), F.lit(deeper))).alias("depth"), "cell", "bytes", "n_docs")
        sums = ladder.groupBy("depth", F.expr(f"cell div cast(power(2, {deeper} - depth) as bigint)").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.sum("n_docs").alias("n_docs"))
        sums = store(sums)
        parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), (F.col("bytes") > limit).alias("split"))
        joined = sums.withColumn("parent", F.shiftright("prefix", 1)).join(parent, ["depth", "parent"], "left")
        reached = store(joined.where(F.coalesce("split", F.col("depth") == depth + 1)).select("depth", "prefix", "bytes", "n_docs"))
        closed.append(reached.where(F.col("bytes") <= limit))
        depth = deeper
        open_ = reached.where((F.col("bytes") > limit) & (F.col("depth") == depth))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return store(out.withColumn("overflow", F.lit(False)).unionByName(open_.withColumn("overflow", F.lit(True))))


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` + ``shard`` (depth:prefix:page), ``shard_depth``, ``doc_bytes``, ``shard_bytes``, ``shard_docs``.

    Columns of ``docs`` with these names are replaced.
    """
    names = ["shard", "shard_depth", "doc_bytes", "shard_bytes", "shard_docs"]
    d = docs.drop(*names).withColumns({"__sh_h": hash_bits(F.col(f"`{id_col}`")),
                                       "__sh_bytes": F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long")})
    sizes = store(d.select(F.col("__sh_h").alias("h"), F.col("__sh_bytes").alias("bytes")))
    buckets = directory(sizes, limit)
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]      # at most 61 numbers
    d = d.withColumn("__sh_at", F.explode(F.array(*[
        F.struct(F.lit(k).alias("depth"), (F.shiftright("__sh_h", BITS - k) if k else F.lit(0).cast("long")).alias("prefix")) for k in sorted(depths)])
        if depths else F.expr("cast(array() as array<struct<depth:int,prefix:bigint>>)")))
    b = small(buckets.select(F.struct("depth", "prefix").alias("__sh_at"), "bytes", "n_docs", "overflow"))
    d = d.join(b.withColumnsRenamed({"bytes": "__sh_b", "n_docs": "__sh_n", "overflow": "__sh_o"}), "__sh_at")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    name = F.concat_ws(":", F.col("__sh_at.depth").cast("string"), F.lpad(F.conv(F.col("__sh_at.prefix").cast("string"), 10, 16), 15, "0"))

    def shaped(df: DataFrame, page, b, n) -> DataFrame:
        return df.select(*keep, F.concat_ws(":", name, page.cast("string")).alias("shard"), F.col("__sh_at.depth").alias("shard_depth"),
                         F.col("__sh_bytes").alias("doc_bytes"), b.alias("shard_bytes"), n.alias("shard_docs"))

    plain = shaped(d.where("not __sh_o"), F.lit(0), F.col("__sh_b"), F.col("__sh_n"))
    if not buckets.where("overflow").limit(1).count():
        return plain
    # rows of one hash: pages of as many rows as fit if each had the largest row's bytes
    o = d.where("__sh_o")
    o = with_row_index(o, ["__sh_h", "__sh_bytes"], "__sh_rn")
    groups = small(o.groupBy("__sh_h").agg(F.min("__sh_rn").alias("__sh_first"), F.max("__sh_bytes").alias("__sh_max")))
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest("__sh_max", F.lit(1))), F.lit(1))
    o = o.join(groups, "__sh_h").withColumn("__sh_page", F.floor((F.col("__sh_rn") - F.col("__sh_first")) / per_page).cast("long"))
    pages = o.groupBy("__sh_h", "__sh_page").agg(F.sum("__sh_bytes").alias("__sh_pb"), F.count(F.lit(1)).alias("__sh_pn"))
    o = o.join(small(pages), ["__sh_h", "__sh_page"])
    return plain.unionByName(shaped(o, F.col("__sh_page"), F.col("__sh_pb"), F.col("__sh_pn")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, **options) -> None:
    """Write every shard into its own folder below ``path``; a shard is one task's file (it fits the limit)."""
    assign_shards(docs, limit, **options).repartition("shard").write.partitionBy("shard").parquet(path)
