"""Documents and answers as sources: files, web pages, graphs given as text, results of questions, prompts from what a graph is about."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.graph import god_nodes
from .corpus import url_kind

#: Suffixes of documents that can be read as text, and what a question's answer can turn out to be.
READABLE = ("md", "txt", "rst", "markdown")
OUTCOMES = ("useful", "dead_end", "corrected")
RESULT = "type string, date timestamp, question string, answer string, outcome string, correction string, source_nodes array<string>"


def save_result(spark: SparkSession, path: str, question: str, answer: str, kind: str = "query", nodes: list[str] | None = None, outcome: str | None = None, correction: str | None = None) -> None:
    """Appends the answer to a question to the table of work memory."""
    if outcome is not None and outcome not in OUTCOMES:
        raise ValueError(f"outcome must be one of {', '.join(OUTCOMES)}")
    row = [(kind, None, question, answer, outcome, correction, list(nodes or ()))]
    spark.createDataFrame(row, RESULT).withColumn("date", F.current_timestamp()).write.mode("append").parquet(path)


def load_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``uri, title, text`` of text files in order of path; a file of another kind is refused."""
    if wrong := sorted(p for p in paths if p.rsplit(".", 1)[-1].lower() not in READABLE):
        raise ValueError(f"unsupported document: {wrong[0]}")
    files = spark.read.text(sorted(paths), wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))
    return files.select("uri", F.regexp_extract("uri", r"([^/]*)\.[^./]*$", 1).alias("title"), "text").orderBy("uri")


def load_graph(spark: SparkSession, graph: Mapping | str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, label, kind, description``) and edges (``src, dst, relation``) of a graph given as a mapping or as JSON text."""
    doc = graph if isinstance(graph, Mapping) else json.loads(graph)
    said = lambda x, *names: next((str(x[n]) for n in names if x.get(n) is not None), None)
    nodes = [(said(x, "id"), said(x, "label", "name"), said(x, "kind", "type", "file_type"), said(x, "description", "doc")) for x in doc.get("nodes") or () if isinstance(x, Mapping)]
    links = doc.get("links") if doc.get("links") is not None else doc.get("edges") or ()
    edges = [(said(x, "source", "from"), said(x, "target", "to"), said(x, "relation", "kind", "type")) for x in links if isinstance(x, Mapping)]
    return spark.createDataFrame(nodes, "id string, label string, kind string, description string"), spark.createDataFrame(edges, "src string, dst string, relation string")


def page_documents(pages: DataFrame) -> DataFrame:
    """``page_id, kind, text``: web pages (``page_id, url, html``) as Markdown with a head."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    kind = url_kind(F.col("url"))
    return pages.select("page_id", kind.alias("kind"), X.front_matter(F.col("url"), title, kind, X.html_to_markdown(F.col("html"))).alias("text"))


def domain_prompt(nodes: DataFrame, edges: DataFrame, k: int = 20) -> str:
    """A hint for speech recognition: the names that matter most in the graph."""
    return "Technical discussion. Names: " + ", ".join(r.label for r in god_nodes(nodes, edges, k).collect()) + "."
