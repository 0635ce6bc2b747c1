"""Staged graph publishing, federation and the checks around answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a read-only graph query may not contain.
WRITES = ("create", "merge", "delete", "detach", "set", "remove", "drop", "call", "load", "foreach")


def guard(query: str) -> str | None:
    """Why a graph query is refused; None if it only reads, stays in its workspace and is limited."""
    text = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", query)
    if ";" in text.strip().rstrip(";"):
        return "several statements"
    words = {w.lower() for w in re.findall(r"[A-Za-z_]+", text)}
    if found := sorted(words & set(WRITES)):
        return f"not read-only: {found[0]}"
    if "$workspace_id" not in text:
        return "no workspace"
    return None if re.search(r"(?i)\blimit\s+\$limit\b", text) else "no limit"


def reconcile(published: DataFrame, incoming: DataFrame) -> DataFrame:
    """``source_id, action`` of (source_id, content_hash) tables: keep, replace, add or remove."""
    a, b = published.select("source_id", F.col("content_hash").alias("a")), incoming.select("source_id", F.col("content_hash").alias("b"))
    action = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").when(F.col("a") == F.col("b"), "keep").otherwise("replace")
    return a.join(b, "source_id", "full").select("source_id", action.alias("action"))


def publish(active: DataFrame, staged: DataFrame, key: str = "source_id") -> DataFrame:
    """The rows of ``active`` with those of every staged source replaced by its staged version."""
    return active.join(staged.select(key).distinct(), key, "left_anti").select(active.columns).unionByName(staged.select(active.columns))


def verified(staged: DataFrame, expected: DataFrame) -> DataFrame:
    """``source_id, n, expected, ok``: staged rows against the counts that the envelope promised."""
    got = staged.groupBy("source_id").agg(F.count("*").alias("n"))
    return expected.join(got, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok"))


def unresolved_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answer_id, unresolved``: an answer with any unresolved citation is void."""
    known = evidence.select(F.col("id").alias("known")).distinct()
    j = citations.join(known, F.col("cited") == F.col("known"), "left")
    return j.groupBy("answer_id").agg(F.count_if(F.col("known").isNull()).alias("unresolved")).where("unresolved > 0")


def retag(nodes: DataFrame, tag: str) -> DataFrame:
    """Ids become ``tag::id``, for the union of graphs of several repos."""
    return nodes.withColumn("id", F.concat(F.lit(f"{tag}::"), F.col("id"))).withColumn("repo", F.lit(tag))


def collapse_externals(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without a source that share a label become the one of smallest id; edges follow, without new self-loops."""
    outside = nodes.where("coalesce(source_file, '') = ''")
    keep = outside.groupBy("label").agg(F.min("id").alias("to"))
    to = outside.join(keep, "label").where("id <> to").select(F.col("id").alias("old"), "to")
    left = nodes.join(to, F.col("id") == F.col("old"), "left_anti")
    for end in ("src", "dst"):
        edges = edges.withColumn("was_loop", F.col("src") == F.col("dst")) if end == "src" else edges
        edges = edges.join(to, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("to", end)).drop("old", "to")
    return left, edges.where("was_loop or src <> dst").drop("was_loop")


def sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, relation, n``: edges by the sections (communities) of their ends; null for an end without one."""
    s = nodes.select(F.col("id").alias("src"), F.col("community").alias("a"))
    d = nodes.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    return edges.join(s, "src", "left").join(d, "dst", "left").groupBy("a", "b", "relation").agg(F.count("*").alias("n"))


def match_communities(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old, new, overlap``: best old id for each new community and the reverse, where both agree (greedy 1-1 in one round)."""
    both = old.select("id", F.col("community").alias("old")).join(new.select("id", F.col("community").alias("new")), "id").groupBy("old", "new").agg(F.count("*").alias("overlap"))
    rank = F.struct((-F.col("overlap")).alias("o"), "old", "new")
    a = both.groupBy("old").agg(F.min(rank).alias("x")).select("x.old", "x.new")
    b = both.groupBy("new").agg(F.min(rank).alias("x")).select("x.old", "x.new")
    return both.join(a.intersect(b), ["old", "new"])
