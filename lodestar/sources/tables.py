"""The property graph that the relational test tables stand for: nodes and directed, parallel edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, file_type, source_file, community``."""

    def part(name, prefix, k, label, kind, source, community):
        return table(spark, sf_dir, name).select(key(prefix, k).alias("id"), label.alias("label"), F.lit(kind).alias("file_type"), source.alias("source_file"), community.cast("long").alias("community"))

    def tbl(folder, c):
        return F.concat(F.lit(f"{folder}/"), F.col(c), F.lit(".tbl"))

    parts = [
        part("region", "r", "r_regionkey", F.col("r_name"), "code", F.lit("region.tbl"), F.lit(None)),
        part("nation", "n", "n_nationkey", F.col("n_name"), "code", F.lit("nation/"), F.col("n_nationkey")),
        part("customer", "c", "c_custkey", F.col("c_name"), "code", tbl("customer", "c_mktsegment"), F.col("c_nationkey")),
        part("supplier", "s", "s_suppkey", F.col("s_name"), "code", F.lit("supplier.tbl"), F.col("s_nationkey")),
        part("part", "p", "p_partkey", F.col("p_name"), "document", tbl("part", "p_brand"), F.col("p_size") % 25),
        part("orders", "o", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), "code", tbl("orders", "o_orderpriority"), F.col("o_custkey") % 25),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, relation, confidence, confidence_score, weight, context``; parallel edges stay."""

    def part(name, src, dst, relation, confidence, weight=None, context=None):
        one = F.lit(1.0) if weight is None else F.col(weight)
        word = F.lit(None).cast("string") if context is None else F.col(context)
        return table(spark, sf_dir, name).select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), confidence.alias("confidence"), one.alias("weight"), word.alias("context"))

    extracted = F.lit("EXTRACTED")
    status = F.when(F.col("o_orderstatus") == "F", "EXTRACTED").when(F.col("o_orderstatus") == "O", "INFERRED").otherwise("AMBIGUOUS")
    flag = F.when(F.col("l_returnflag") == "A", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    parts = [
        part("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), "in_region", extracted),
        part("customer", key("c", "c_custkey"), key("n", "c_nationkey"), "located_in", extracted),
        part("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), "located_in", extracted),
        part("orders", key("o", "o_orderkey"), key("c", "o_custkey"), "placed_by", status),
        part("lineitem", key("o", "l_orderkey"), key("p", "l_partkey"), "contains", flag, "l_quantity"),
        part("lineitem", key("p", "l_partkey"), key("s", "l_suppkey"), "supplied_by", extracted, "l_quantity", "l_linestatus"),
    ]
    both = reduce(DataFrame.unionByName, parts)
    score = F.when(F.col("confidence") == "EXTRACTED", 1.0).when(F.col("confidence") == "INFERRED", 0.5).otherwise(0.2)
    return both.withColumn("confidence_score", score)
