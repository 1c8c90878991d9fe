"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_label: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """(texts, labels) of at most ``per_label`` documents of label 0 and of label 1, chosen by a hash of the id.

    Ids are chosen on the narrow label table, so only the chosen texts reach the driver.  Labels that
    are null, texts that are null and texts above ``max_chars`` characters (to bound the sample's
    bytes) teach nothing; an id labelled twice counts once, with its larger label.
    """
    l = labels.where(learnable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))  # noqa: E741
    spread = F.struct(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    chosen = None
    for y in (0, 1):
        part = l.where(F.col("label") == y).orderBy(spread).limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    d = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    out = d.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    return out["text"].to_pylist(), out["label"].to_numpy()
