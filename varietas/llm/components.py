"""Connected components of a link table by union-find inside tasks and star contraction between them.

The edges of each partition are first contracted with a local union-find, which leaves at most one
edge per node and partition.  A forest of at most ``ONE_TASK`` edges (counted) is finished by one task
(8 MB of numbers); a larger one by rounds in which every node's neighbours are joined to the smallest
of them.  The table never grows, a hot node is a partial minimum per task and a skewed equi-join, and
rounds end when an edge table repeats itself (about the logarithm of the longest path).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import store


ONE_TASK = 500_000


def _contract(batches):
    """Local union-find over a partition's edges: (node, root) with root < node."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for df in batches:
        for u, v in zip(df["u"].tolist(), df["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in list(parent) if find(x) != x]
    yield pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}, columns=["u", "v"]).astype("int64")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v longs) but the smallest ones."""
    e = store(edges.select("u", "v").where("u <> v").mapInPandas(_contract, "u long, v long"))
    if e.count() <= one_task:
        return e.coalesce(1).mapInPandas(_contract, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = None
    while True:
        # u > v throughout; every node points its larger neighbours and itself at its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").mapInPandas(_contract, "u long, v long").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = store(small_star.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        state = (now["n"], now["h"])
