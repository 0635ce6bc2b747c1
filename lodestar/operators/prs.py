"""Pull requests against a graph: what they touch, where they meet, what state they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import pr_status
from .question import matched_files

#: States that nothing is to be done about.
QUIET = ("WRONG-BASE", "DRAFT", "STALE")


def impact(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``number, n_nodes, communities`` of changed files (``number, path``): each file of the graph counts once for a request, whichever way its path is written."""
    hit = matched_files(files.select("path"), nodes.select(F.col("source_file").alias("path")))
    touched = files.join(hit, F.col("path") == F.col("wanted")).select("number", F.col("known").alias("source_file")).distinct()
    return touched.join(nodes.select("source_file", "community"), "source_file").groupBy("number").agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_set("community")).alias("communities"))


def conflicts(found: DataFrame) -> DataFrame:
    """``community, numbers, n``: communities that several requests touch."""
    each = found.select("number", F.explode("communities").alias("community"))
    return each.groupBy("community").agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.countDistinct("number").alias("n")).where("n > 1")


def dashboard(requests: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``number, status, n_nodes, communities``: requests with their state and reach, those that wait for something first."""
    told = pr_status(requests).join(impact(files, nodes), "number", "left")
    return told.select("number", "status", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), "communities").orderBy(F.col("status").isin(*QUIET), F.desc("n_nodes"), "number")
