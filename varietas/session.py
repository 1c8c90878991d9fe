"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by ``spark.checkpoint.dir``.  Only when that
setting is absent and the master is local (tests, the benchmark) does :func:`ensure_checkpoint_dir`
pick a fresh temporary folder; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RELEASE_S = 5
_released = time.monotonic()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "varietas",
                  driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="varietas-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder and cut its lineage.

    Used where a later step needs the *same* rows as an earlier job saw (row indices derived from
    partition ids), so a re-computation after a lost executor cannot shift them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df                      # its plan holds the shuffle files
    release(spark)
    return out


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the reliable checkpoint folder and read it back.

    As :func:`checkpoint`, but the rows lie compressed by column (a checkpoint writes them one by one, uncompressed) and an order or
    a few columns can be read alone.  Partitions and their order are not kept.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so when the driver's garbage is collected, which a driver
    with little to do puts off.  At most once in ``RELEASE_S`` seconds.
    """
    global _released
    if time.monotonic() - _released >= RELEASE_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()
