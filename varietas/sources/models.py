"""Model store: language models of many ids in tables partitioned by (model_id, ord).

A store is a folder with one table per stage: ``counts`` (h, w, c), ``probs`` (h, w, p) and ``gammas`` (h, g), partitioned by
(model_id, ord), ``vocab`` (w) partitioned by model_id, and ``models`` (ord, method, stage), a row per model and
stage.  Writing replaces just the partitions of the ids that are written (dynamic overwrite); reading one id or
one order touches just its folders (partition pruning).  Rows are rebalanced before the write, so a model that
holds most rows is written by many tasks and a small one as one file.

A folder per model does not suit very many small ones.  With ``grouped`` (given alike to every function) the tables lie in ``grouped/`` under
the root, partitioned by (bucket of the id, ord) in ``GROUPS`` buckets whose rows are sorted by id: as many files for any number of models.
Writing ids then replaces their rows in their buckets; the buckets' other rows are kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.operators.lm import LM
from varietas.session import store

# Fixed value: buckets of ids of a grouped store.
GROUPS = 16

SCHEMAS = {"counts": "h string, w string, c double, model_id string, ord int", "probs": "h string, w string, p double, model_id string, ord int",
           "gammas": "h string, g double, model_id string, ord int", "vocab": "w string, model_id string",
           "models": "ord int, method string, model_id string, stage string"}


def _names(table: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[table].split(", ")]


def _write(df: DataFrame, root: str, table: str, parts: list[str], grouped: bool = False) -> None:
    names = _names(table)
    typed = df.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMAS[table].split(", ")])
    path = f"{root.rstrip('/')}/{table}"
    if grouped:
        parts, names, path = ["_group", *[p for p in parts if p != "model_id"]], ["_group", *names], _grouped_path(root, table)
        typed = typed.withColumn("_group", F.pmod(F.xxhash64("model_id"), F.lit(GROUPS)).cast("int"))
        old = _stored_groups(df.sparkSession, root, table)
        if old is not None:
            typed = store(typed)                                   # read before its buckets are replaced
            own = ["model_id", *[p for p in parts if p not in ("_group", "ord")]]
            kept = old.join(typed.select("_group").distinct(), "_group", "left_semi").join(typed.select(*own).distinct(), own, "left_anti")
            typed = store(typed.unionByName(kept.select(*typed.columns)))
    typed = typed.hint("rebalance", *parts)
    if grouped:
        typed = typed.sortWithinPartitions(*parts, "model_id")
    typed.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _grouped_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/grouped/{table}"


def _stored_groups(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table of a grouped store with its buckets, if it has been written."""
    try:
        return spark.read.schema(SCHEMAS[table] + ", _group int").parquet(_grouped_path(root, table))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _keyed(df: DataFrame, model_id: str | None) -> DataFrame:
    return df if model_id is None else df.withColumn("model_id", F.lit(str(model_id)))


def _register(ids: DataFrame, root: str, order: int, method: str, stage: str, grouped: bool = False) -> None:
    _write(ids.select("model_id").distinct().select(F.lit(order).alias("ord"), F.lit(method).alias("method"), "model_id", F.lit(stage).alias("stage")),
           root, "models", ["model_id", "stage"], grouped)


def save_counts(counts: DataFrame, root: str, order: int, model_id: str | None = None, grouped: bool = False) -> None:
    """Store n-gram counts (ord, h, w, c) as model ``model_id``, or of every id of their column ``model_id``."""
    counts = _keyed(counts, model_id)
    _write(counts, root, "counts", ["model_id", "ord"], grouped)
    _register(counts, root, order, "", "counts", grouped)


def save_models(lm: LM, root: str, model_id: str | None = None, stage: str = "lm", grouped: bool = False) -> None:
    """Store a model (stage ``lm`` or ``pruned_lm``), or the models of every ``model_id`` of its tables (built with ``by``)."""
    ids = _keyed(lm.gammas, model_id).select("model_id").distinct()
    vocab = _keyed(lm.vocab, model_id)
    if "model_id" not in vocab.columns:                     # one vocabulary for all models: stored once
        vocab = vocab.withColumn("model_id", F.lit("*"))
    _write(_keyed(lm.probs, model_id), root, "probs", ["model_id", "ord"], grouped)
    _write(_keyed(lm.gammas, model_id), root, "gammas", ["model_id", "ord"], grouped)
    _write(vocab, root, "vocab", ["model_id"], grouped)
    _register(ids, root, lm.order, lm.method, stage, grouped)


def read_table(spark: SparkSession, root: str, table: str, grouped: bool = False) -> DataFrame:
    if grouped:
        return spark.read.schema(SCHEMAS[table] + ", _group int").parquet(_grouped_path(root, table)).drop("_group")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{root.rstrip('/')}/{table}")


def list_models(spark: SparkSession, root: str, pattern: str | None = None, stage: str | None = None, grouped: bool = False) -> DataFrame:
    """(model_id, stage, ord, method) of the stored models, optionally those whose id matches a regular expression."""
    found = read_table(spark, root, "models", grouped)
    if pattern is not None:
        found = found.where(F.col("model_id").rlike(pattern))
    if stage is not None:
        found = found.where(F.col("stage") == stage)
    return found.select("model_id", "stage", "ord", "method").distinct()


def load_counts(spark: SparkSession, root: str, model_id: str | None = None, grouped: bool = False) -> DataFrame:
    """(ord, h, w, c) of one model, or (model_id, ord, h, w, c) of all: re-entry at the ``counts`` stage."""
    counts = read_table(spark, root, "counts", grouped)
    if model_id is None:
        return counts.select("model_id", "ord", "h", "w", "c")
    return counts.where(F.col("model_id") == str(model_id)).select("ord", "h", "w", "c")


def load_model(spark: SparkSession, root: str, model_id: str, grouped: bool = False) -> LM:
    """One stored model: re-entry at the ``lm`` stage."""
    row = list_models(spark, root, grouped=grouped).where((F.col("model_id") == str(model_id)) & (F.col("stage") != "counts")).first()
    if row is None:
        raise ValueError(f"no model {model_id!r} in {root}")
    own = lambda table: read_table(spark, root, table, grouped).where(F.col("model_id") == str(model_id)).drop("model_id")
    vocab = read_table(spark, root, "vocab", grouped).where(F.col("model_id").isin(str(model_id), "*")).select("w").distinct()
    return LM(row.ord, row.method, own("probs"), own("gammas"), vocab)


def load_models(spark: SparkSession, root: str, pattern: str | None = None, grouped: bool = False) -> LM:
    """All stored models whose id matches, as one keyed model (tables with ``model_id``), for :func:`score_models`."""
    found = list_models(spark, root, pattern, grouped=grouped).where("stage <> 'counts'")
    first = found.first()
    if first is None:
        raise ValueError(f"no model like {pattern!r} in {root}")
    match = (lambda df: df.where(F.col("model_id").rlike(pattern))) if pattern is not None else (lambda df: df)
    vocab = read_table(spark, root, "vocab", grouped)
    shared = vocab.where("model_id = '*'").select("w")
    own = match(vocab.where("model_id <> '*'"))
    return LM(first.ord, first.method, match(read_table(spark, root, "probs", grouped)), match(read_table(spark, root, "gammas", grouped)),
              shared if own.isEmpty() else own)
