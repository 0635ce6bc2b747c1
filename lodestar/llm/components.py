"""Connected components by alternating large-star and small-star rewriting of an edge table.

Every round is two aggregations with map-side combine and two joins of staged tables. Both join sides are read from tables, so
that adaptive execution may split the partition of a vertex with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _stars(pairs: DataFrame, up: bool) -> DataFrame:
    """For each u with neighbours v: links to the smallest of them and u. ``up``: only from v > u (large star), else from v < u."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = pairs.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
    if up:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node on an edge; ``component`` is the smallest node reachable.

    ``edges`` has two long columns u and v. Self-loops and nulls are ignored; repeated edges are harmless.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stage(e, "edges")
    mark = None
    while True:
        both = stage(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = stage(_stars(both, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        e = stage(_stars(large, False), "small")
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stage(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
