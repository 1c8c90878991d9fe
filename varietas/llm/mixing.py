"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

1. *Targets.*  Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share 100 % of
   all words; a target stops at three times its source's size and the excess goes to the others by
   weight until none is above.  That fixed point is the water level of the capped shares and is
   computed with prefix sums over the (small) source table.
2. *Quotas.*  A source's target is whole epochs over its documents plus a remainder.  Documents fall
   into ``BLOCKS`` hash blocks per source; the remainder takes the blocks of a seeded permutation
   until its words are reached, and of the last block only the first documents of a seeded order.
   So nothing is taken more often than three times, and the words taken miss the target by less
   than one document.
3. *Splitting tree.*  The block draws of all sources are dealt to output shards: at every node of a
   binary tree over the shards, each source's count for the left half is a hypergeometric draw given
   what earlier sources already put there (the multivariate hypergeometric law), by inversion from a
   seeded uniform.  A leaf holds exact per-source counts that sum to its capacity.
4. *Drawing.*  A source's draws in a seeded order are cut at the leaves' cumulative counts, so the
   shards get disjoint blocks; rows get a seeded order key inside their shard (the local shuffle).

All of it is DataFrame functions.  The tree has one row per node and works on counts only; documents
are touched by one partial aggregation (words per source and block) and one join with that block
table, whose rows are bounded by sources x ``BLOCKS`` x 3.  Seeds are hashed with md5, so reruns
agree.  A null text has size 0; a null source is a source of its own; a document of size 0 is taken
as often as its block.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import small, store, unit_hash, word_count

BLOCKS = 256
SHARDS = 16
CAP = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = (sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
         .withColumn("cap", (CAP * F.col("source_size")).cast("double")))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)))
    # the first source (by cap/weight) whose share stays below its cap sets the level of all after it
    first = F.struct(F.row_number().over(by_level).alias("rank"), "level")
    s = s.withColumn("first", F.when(F.col("level") * F.col("weight") <= F.col("cap"), first))
    s = s.withColumn("water", F.min("first").over(everything)["level"])
    return s.select("source", "source_size",
                    F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def _source_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("null"))


def plan_draws(docs: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sources with targets, block table).

    Block table: (source, block, epoch, part) with ``part`` null for a whole block, or the words to
    take of the one block per source that is taken in part.
    """
    per_block = store(docs.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    targets = store(source_targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size"))))
    b = per_block.join(targets, per_block["source"].eqNullSafe(targets["source"])).select(
        per_block["source"], "block", "words", "source_size", "target")
    key = _source_key(F.col("source"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    b = (b.withColumn("epochs", epochs)
         .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
         .withColumn("u", unit_hash(seed, "permute", key, F.col("block"))))
    run = Window.partitionBy("source").orderBy("u", "block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    whole = b.where("epochs >= 1").select("source", "block", F.explode(F.expr("sequence(1, epochs)")).alias("epoch"),
                                          F.lit(None).cast("double").alias("part"))
    rest = b.where(F.col("before") < F.col("rest")).select(
        "source", "block", (F.col("epochs") + 1).alias("epoch"),
        F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before")).alias("part"))
    return targets, whole.unionByName(rest)


# One hypergeometric draw as SQL: ``n`` draws from ``total`` of which ``good`` are good, by walking
# the support from its mode upwards, then downwards, until the mass reaches ``u`` of the whole.
_HYPER = """
aggregate(array(struct(cast({good} as double) as g, cast({n} as double) as n, cast({total} as double) as t, {u} as u)), 0L, (z, p) ->
  aggregate(array(greatest(greatest(0D, p.n + p.g - p.t), least(least(p.g, p.n), floor((p.n + 1) * (p.g + 1) / (p.t + 2))))), 0L, (z2, mode) ->
    aggregate(array(
      aggregate(sequence(0L, cast(least(p.g, p.n) - mode as bigint)), struct(1D as w, 0D as s),
        (a, i) -> struct(a.w * (p.g - mode - i) * (p.n - mode - i) / ((mode + i + 1) * (p.t - p.g - p.n + mode + i + 1)) as w, a.s + a.w as s), a -> a.s)
      + aggregate(sequence(0L, cast(mode - greatest(0D, p.n + p.g - p.t) as bigint)), struct(1D as w, 0D as s),
        (a, i) -> struct(a.w * (mode - i) * (p.t - p.g - p.n + mode - i) / ((p.g - mode + i + 1) * (p.n - mode + i + 1)) as w, a.s + a.w as s), a -> a.s) - 1D), 0L, (z3, mass) ->
      aggregate(array(aggregate(sequence(0L, cast(least(p.g, p.n) - mode as bigint)), struct(1D as w, 0D as s, -1L as r),
        (a, i) -> struct(a.w * (p.g - mode - i) * (p.n - mode - i) / ((mode + i + 1) * (p.t - p.g - p.n + mode + i + 1)) as w, a.s + a.w as s,
                         if(a.r < 0 and a.s + a.w >= p.u * mass, cast(mode as bigint) + i, a.r) as r))), 0L, (z4, up) ->
        if(up.r >= 0, up.r,
          aggregate(sequence(0L, cast(mode - greatest(0D, p.n + p.g - p.t) as bigint)), struct(1D as w, up.s - 1D as s, -1L as r),
            (a, i) -> struct(a.w * (mode - i) * (p.t - p.g - p.n + mode - i) / ((p.g - mode + i + 1) * (p.n - mode + i + 1)) as w, a.s + a.w as s,
                             if(a.r < 0 and a.s + a.w >= p.u * mass, cast(mode as bigint) - i, a.r) as r),
            a -> if(a.r < 0, cast(greatest(0D, p.n + p.g - p.t) as bigint), a.r)))))))
"""


def hypergeometric(n: str, good: str, total: str, u: str) -> str:
    """SQL of the number of good ones among ``n`` drawn from ``total`` holding ``good`` good ones."""
    return _HYPER.format(n=n, good=good, total=total, u=u)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """(source, shard, count) from (source, quota): exact quotas dealt over ``shards`` equal shards.

    The node table holds one row per tree node with the counts of all sources as an array; a level
    is one projection.  Every source's counts over the shards sum to its quota; shard totals differ
    by at most one.
    """
    ordered = quotas.agg(F.array_sort(F.collect_list(F.struct(_source_key(F.col("source")).alias("k"), F.col("quota").cast("long").alias("q")))).alias("s"))
    nodes = ordered.where("size(s) > 0").select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("s", lambda x: x["k"]).alias("keys"),
                           F.transform("s", lambda x: x["q"]).alias("q"))
    left_share = "aggregate(q, 0L, (a, x) -> a + x)"
    draw = hypergeometric("a.room", "element_at(q, i)", "a.all", "element_at(us, i)")
    for _ in range(max(shards - 1, 0).bit_length()):
        split = nodes.where("hi - lo > 1").selectExpr("*", "cast((lo + hi) div 2 as int) as mid", f"{left_share} as n")
        # shard i of [lo, hi) gets floor((i+1) n / w) - floor(i n / w): capacities differ by one at most
        split = split.selectExpr("*", "n * (mid - lo) div (hi - lo) as room")
        split = split.withColumn("us", F.transform("keys", lambda k: unit_hash(seed, "tree", F.col("lo"), F.col("hi"), k)))
        split = split.withColumn("got", F.expr(
            "aggregate(sequence(1, size(q)), struct(room as room, n as all, cast(array() as array<bigint>) as out), (a, i) -> "
            f"aggregate(array({draw}), a, (b, d) -> struct(b.room - d as room, b.all - element_at(q, i) as all, concat(b.out, array(d)) as out)), a -> a.out)"))
        halves = split.select("keys", F.explode(F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("got").alias("q")),
            F.struct(F.col("mid").alias("lo"), "hi", F.expr("zip_with(q, got, (x, y) -> x - y)").alias("q")))).alias("n")).select("n.lo", "n.hi", "keys", "n.q")
        nodes = store(nodes.where("hi - lo = 1").select("lo", "hi", "keys", "q").unionByName(halves))
    return nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip(F.col("keys").alias("k"), F.col("q").alias("c"))).alias("x")).select(
        "shard", F.col("x.k").alias("source_key"), F.col("x.c").alias("count"))


def assign_copies(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 1,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(docs + ``__mix_size`` + ``__mix_copies``, sources with targets).

    ``__mix_copies`` lists the copies the mix takes of a row as (epoch, shard, order); it is empty for
    a row left out.  Rows that repeat an id get the same copies each.
    """
    d = docs.withColumns({
        "__mix_size": word_count(F.col(f"`{text_col}`")), "__mix_source": F.col(f"`{source_col}`"), "__mix_id": F.col(f"`{id_col}`"),
        "__mix_block": F.floor(unit_hash(seed, "block", F.col(f"`{id_col}`")) * blocks).cast("int"),
        "__mix_u": unit_hash(seed, "document", F.col(f"`{id_col}`"))})
    slim = store(d.select(*[F.col(f"__mix_{c}").alias(c) for c in ("source", "id", "size", "block", "u")]))
    targets, draws = plan_draws(slim, seed)
    draws = store(draws)
    key = _source_key(F.col("source"))
    # the block taken in part: documents in a seeded order until its words are reached (to the nearest)
    part = draws.where("part is not null").select(key.alias("part_key"), F.col("block").alias("part_block"), "part")
    p = slim.join(small(part), (key == F.col("part_key")) & (F.col("block") == F.col("part_block")))
    run = Window.partitionBy("part_key").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    stops = p.where(2 * F.col("before") + F.col("size") > 2 * F.col("part")).groupBy("part_key").agg(F.min(F.struct("u", "id")).alias("stop"))
    # a source's draws in a seeded order, cut at the shards' cumulative counts
    in_source = Window.partitionBy("source_key").orderBy("draw", "epoch", "block")
    ranked = (draws.withColumn("source_key", key).withColumn("draw", unit_hash(seed, "draw", key, F.col("block"), F.col("epoch")))
              .withColumn("rank", F.row_number().over(in_source)))
    leaves = splitting_tree(draws.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    to_here = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (leaves.withColumn("last", F.sum("count").over(to_here)).where("count > 0")
            .groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("cuts")))
    placed = (ranked.join(cuts, "source_key").join(stops, F.col("source_key") == F.col("part_key"), "left")
              .withColumn("shard", F.expr("filter(cuts, c -> c.last >= rank)[0].shard")))
    table = store(placed.groupBy("source_key", F.col("block").alias("mix_block")).agg(F.collect_list(F.struct(
        "epoch", "shard", F.when(F.col("part").isNotNull(), F.col("stop")).alias("stop"))).alias("draws")))
    out = d.withColumn("__mix_key", _source_key(F.col("__mix_source"))).join(
        small(table.select(F.col("source_key").alias("__mix_key"), F.col("mix_block").alias("__mix_block"), F.col("draws").alias("__mix_draws"))),
        ["__mix_key", "__mix_block"], "left")
    here = F.struct(F.col("__mix_u").alias("u"), F.col("__mix_id").alias("id"))
    taken = F.filter(F.coalesce("__mix_draws", F.array().cast(table.schema["draws"].dataType)), lambda c: c["stop"].isNull() | (here < c["stop"]))
    copies = F.transform(taken, lambda c: F.struct(c["epoch"].alias("epoch"), c["shard"].alias("shard"),
                                                   unit_hash(seed, "order", c["shard"], F.col("__mix_id"), c["epoch"]).alias("order")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__mix_size", copies.alias("__mix_copies")), targets


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: columns of ``docs``, a row per copy taken (a row may come up to three times)."""
    out, _ = assign_copies(docs, **options)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__mix_copies").alias("__mix_copy")).drop("__mix_copy")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the mix as Parquet, one folder per output shard, rows in the seeded order of their shard."""
    out, _ = assign_copies(docs, **options)
    rows = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__mix_copies").alias("c"))
    rows = rows.withColumns({"mix_shard": F.col("c.shard"), "mix_order": F.col("c.order"), "mix_epoch": F.col("c.epoch")}).drop("c")
    # a third key part spreads one shard over tasks; files of a shard are ordered runs
    rows.repartition("mix_shard", F.floor(F.col("mix_order") * 8)).sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
