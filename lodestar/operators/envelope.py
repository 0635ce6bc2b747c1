"""From documents and graphs to what retrieval stands on: validated envelopes, chunks with citations, entity extraction, indexes, limits and answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents
from .vectors import embed

#: Longest field, largest row, dimensions of an index.
FIELD, ROW, DIMENSIONS = 2000, 262_144, 4096


def relationship_rejects(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """``ord, reason`` of relationships (``ord, src, dst, type, description``): the first rule that is broken, null if none.

    ``accepted``: ``id`` of the nodes that were accepted.
    """
    ids = accepted.select("id").distinct()
    j = rows.join(ids.select(F.col("id").alias("a")), F.col("src") == F.col("a"), "left").join(ids.select(F.col("id").alias("b")), F.col("dst") == F.col("b"), "left")
    first = rows.groupBy("src", "dst", "type", "description").agg(F.min("ord").alias("first")).select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("type").alias("t"), F.col("description").alias("e"), "first")
    j = j.join(first, F.col("src").eqNullSafe(F.col("s")) & F.col("dst").eqNullSafe(F.col("d")) & F.col("type").eqNullSafe(F.col("t")) & F.col("description").eqNullSafe(F.col("e")))
    reason = (
        F.when(F.length("type") > FIELD, "field_too_long")
        .when(F.coalesce("src", F.lit("")).eqNullSafe("") | F.coalesce("dst", F.lit("")).eqNullSafe(""), "endpoint_missing")
        .when(F.col("a").isNull() | F.col("b").isNull(), "endpoint_not_accepted")
        .when(F.octet_length(F.to_json(F.struct("src", "dst", "type", "description"))) > ROW, "too_big")
        .when(F.col("ord") > F.col("first"), "duplicate")
    )
    return j.select("ord", reason.alias("reason"))


def type_token(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def envelope(nodes: DataFrame, edges: DataFrame, workspace: str, source: str) -> dict[str, DataFrame]:
    """Tables nodes, relationships, chunks and citations of a graph under stable ids.

    ``nodes``: id, label, kind, signature, doc, description, source_location. ``edges``: src, dst, relation. A node's text is its distinct
    signature, doc and description, joined by blank lines; a node with a text has one chunk with one citation.
    """

    def stable(*parts: Column) -> Column:
        return F.substring(F.sha2(F.concat_ws("\0", F.lit(workspace), F.lit(source), *parts), 256), 1, 32)

    said = F.filter(F.array_distinct(F.transform(F.array("signature", "doc", "description"), lambda x: F.trim(F.coalesce(x, F.lit(""))))), lambda x: x != "")
    own = nodes.select(stable(F.col("id")).alias("node_id"), F.col("id").alias("external_id"), F.col("label"), type_token(F.col("kind")).alias("type"), F.array_join(said, "\n\n").alias("text"), "source_location")
    rel = edges.select(stable(F.col("src")).alias("src"), stable(F.col("dst")).alias("dst"), type_token(F.col("relation")).alias("type")).distinct().withColumn("relationship_id", stable(F.col("src"), F.col("dst"), F.col("type")))
    chunks = own.where("text <> ''").select(stable(F.col("node_id"), F.lit("chunk")).alias("chunk_id"), "node_id", "text")
    citations = own.where("text <> ''").select(stable(F.col("node_id"), F.lit("citation")).alias("citation_id"), stable(F.col("node_id"), F.lit("chunk")).alias("chunk_id"), F.lit(source).alias("source_id"), "source_location")
    return {"nodes": own, "relationships": rel, "chunks": chunks, "citations": citations}


def content_hash(tables: dict[str, DataFrame]) -> str:
    """A hash of all rows of an envelope that does not depend on their order."""
    total = 0
    for name, df in sorted(tables.items()):
        row = df.select(F.xxhash64(F.lit(name), F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("h"), F.count("*").alias("n")).first()
        total = (total * 31 + int(row.h or 0) + row.n) % (1 << 64)
    return f"{total:016x}"


def ingest(docs: DataFrame, extractor: Callable[[str], tuple[list, list]], size: int = 2000, overlap: int = 200) -> dict[str, DataFrame]:
    """Chunks, entities, mentions and relations of documents (``doc_id, text``).

    ``extractor`` maps a chunk's text to entities (name, type) and relations (source, target, type, description); it runs in the workers.
    Relations of equal ends, type and description are one.
    """
    chunks = documents.chunk(docs, size, overlap).withColumn("chunk_id", F.concat(F.lit("document:"), F.col("doc_id").cast("string"), F.lit(":chunk:"), F.col("seq").cast("string")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for chunk_id, text in zip(pdf["chunk_id"], pdf["chunk"], strict=True):
                entities, relations = extractor(text)
                rows += [(chunk_id, "entity", n, None, t, None) for n, t in entities] + [(chunk_id, "relation", a, b, t, d) for a, b, t, d in relations]
            yield pd.DataFrame(rows, columns=["chunk_id", "row", "a", "b", "type", "description"])

    found = chunks.select("chunk_id", "chunk").mapInPandas(run, "chunk_id string, row string, a string, b string, type string, description string")
    entities = found.where("row = 'entity'")
    named = entities.groupBy(F.lower("a").alias("entity_id")).agg(F.min("a").alias("name"), F.min("type").alias("type"))
    mentions = entities.select("chunk_id", F.lower("a").alias("entity_id")).distinct()
    relations = found.where("row = 'relation'").select(F.lower("a").alias("src"), F.lower("b").alias("dst"), "type", "description").distinct()
    known = named.select("entity_id")
    relations = relations.join(known.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(known.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return {"chunks": chunks, "entities": named, "mentions": mentions, "relations": relations}


def capitalised(text: str) -> tuple[list, list]:
    """A plain extractor that needs no model: capitalised phrases are entities, two in one sentence are related."""
    entities, relations = {}, []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w]+(?:\s+[A-Z][\w]+)*", sentence)))
        entities |= dict.fromkeys(names, "TERM")
        relations += [(a, b, "RELATED_TO", "") for a, b in zip(names, names[1:], strict=False)]
    return list(entities.items()), relations


def parse_json(raw: str) -> dict:
    """The object in a model's answer: fences are stripped, text around it is ignored, what can't be read is empty."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw or "")
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            got = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {}


#: Models by name: functions of a prompt and the most tokens of the answer.
BACKENDS: dict[str, Callable[[str, int], str]] = {}


def ask_model(prompt: str, backend: str, most_tokens: int = 200) -> str:
    """The answer of the backend of that name; callers register theirs in ``BACKENDS``."""
    if backend not in BACKENDS:
        raise ValueError(f"no backend {backend!r}; there are {', '.join(sorted(BACKENDS)) or 'none'}")
    return BACKENDS[backend](prompt, most_tokens)


def extract_corpus(packs: DataFrame, ask: Callable[[str], str], deepest: int = 3) -> DataFrame:
    """``pack, kind, payload`` (JSON) from a model asked about each pack's text (``pack, text``); an answer that was cut off makes it ask about halves.

    ``ask`` runs in the workers; tests pass a function, nothing is called by default.
    """

    def answers(text: str, depth: int) -> Iterator[dict]:
        raw = ask(text)
        got = parse_json(raw)
        if not got and raw.strip() and depth < deepest and len(text) > 1:
            yield from answers(text[: len(text) // 2], depth + 1)
            yield from answers(text[len(text) // 2 :], depth + 1)
        else:
            yield got

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, kind, json.dumps(x, sort_keys=True)) for p, t in zip(pdf["pack"], pdf["text"], strict=True) for got in answers(t or "", 0) for kind in ("nodes", "edges") for x in got.get(kind) or ()]
            yield pd.DataFrame(rows, columns=["pack", "kind", "payload"])

    return packs.select("pack", "text").mapInPandas(run, "pack string, kind string, payload string")


def index(chunks: DataFrame, nodes: DataFrame, version: str, dim: int = 512) -> DataFrame:
    """``id, kind, version, dim, embedding`` of chunk texts and of nodes' labels and texts."""
    if not 1 <= dim <= DIMENSIONS:
        raise ValueError(f"an index has 1 to {DIMENSIONS} dimensions")
    both = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), "text").unionByName(nodes.select(F.col("node_id").alias("id"), F.lit("node").alias("kind"), F.concat_ws("\n", "label", "text").alias("text")))
    return both.join(embed(both, "id", "text", dim), "id").select("id", "kind", F.lit(version).alias("version"), F.lit(dim).alias("dim"), "embedding")


def is_current(index_rows: DataFrame, version: str, dim: int) -> bool:
    """Whether an index is of this version and dimension; else it must be built anew."""
    row = index_rows.agg(F.count_if((F.col("version") != version) | (F.col("dim") != dim)).alias("other"), F.count("*").alias("n")).first()
    return row.n > 0 and not row.other


@dataclass(frozen=True)
class Limits:
    """What an answer may use: what is asked for, but no more than the server allows."""

    k: int = 5
    rows: int = 50

    @classmethod
    def resolve(cls, most_k: int = 20, most_rows: int = 200, k: int | None = None, rows: int | None = None) -> "Limits":
        least = lambda asked, most, usual: min(asked if asked and asked > 0 else usual, most)
        return cls(least(k, most_k, cls.k), least(rows, most_rows, cls.rows))


def scope(known: DataFrame, wanted: list[str], query: str) -> tuple[list[str], list[str]]:
    """(sources to use, problems): unknown sources are refused, an empty query is flagged; no wish means all sources."""
    problems = [] if query.strip() else ["empty_query"]
    found = sorted(r.source_id for r in known.where(F.col("source_id").isin(wanted)).select("source_id").distinct().collect()) if wanted else []
    problems += [f"unknown_source:{s}" for s in sorted(set(wanted) - set(found))]
    return found, problems


def synthesize(question: str, evidence: list[dict], model: Callable[[str, list[dict]], str] | None = None, tries: int = 2) -> str:
    """The model's answer, asked again after a failure; without one the evidence itself, first things first."""
    for _ in range(tries if model else 0):
        try:
            if answer := model(question, evidence):
                return answer
        except Exception:  # noqa: BLE001  the fallback answers
            continue
    if not evidence:
        return "No evidence was found."
    return "\n".join(f"[{k}] {e.get('text', '')[:200]}" for k, e in enumerate(evidence, 1))


def explain(evidence: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of the graph that an answer's evidence (``id``) names, and the edges among it."""
    ids = evidence.select("id").distinct()
    inner = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inner


def source_map(answer_citations: DataFrame, citations: DataFrame) -> DataFrame:
    """``citation_id, source_id, source_location`` of what an answer cites."""
    return answer_citations.select("citation_id").distinct().join(citations.select("citation_id", "source_id", "source_location"), "citation_id")


#: The states of a run and those that may follow each.
RUNS = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled"), "succeeded": (), "failed": ("queued",), "cancelled": ("queued",)}


class Workspaces:
    """Workspaces, their sources and runs: a small table in a JSON file of the driver."""

    def __init__(self, path: str):
        self.path = path

    def _read(self) -> dict:
        try:
            with open(self.path) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"workspaces": {}, "runs": {}}

    def _write(self, state: dict) -> None:
        import os

        with open(f"{self.path}.new", "w") as f:
            json.dump(state, f, indent=1, sort_keys=True)
        os.replace(f"{self.path}.new", self.path)

    def create(self, workspace: str, sources: list[str]) -> None:
        state = self._read()
        if workspace in state["workspaces"]:
            raise ValueError(f"workspace {workspace!r} exists")
        state["workspaces"][workspace] = {"sources": sorted(set(sources))}
        self._write(state)

    def start(self, workspace: str, source: str) -> str:
        state = self._read()
        if source not in state["workspaces"].get(workspace, {}).get("sources", ()):
            raise ValueError(f"no source {source!r} in workspace {workspace!r}")
        run = f"run-{len(state['runs']) + 1}"
        state["runs"][run] = {"workspace": workspace, "source": source, "state": "queued"}
        self._write(state)
        return run

    def move(self, run: str, to: str) -> None:
        state = self._read()
        now = state["runs"][run]["state"]
        if to not in RUNS[now]:
            raise ValueError(f"a run that is {now} can't become {to}")
        state["runs"][run]["state"] = to
        self._write(state)

    def runs(self, spark: SparkSession) -> DataFrame:
        rows = [(k, r["workspace"], r["source"], r["state"]) for k, r in sorted(self._read()["runs"].items())]
        return spark.createDataFrame(rows, "run string, workspace string, source string, state string")
