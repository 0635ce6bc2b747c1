"""Graphs of several sources as one: fragments, chunks, promotion to parallel edges, a shared graph of repos, declared links between repos."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import versions
from ..functions.store import settle
from .graph import dedupe_edges, dedupe_nodes, prune_dangling
from .question import path_match
from .rag import retag

#: What a fragment may hold, and the relation of each kind of declared link.
LIMITS = {"nodes": 10_000, "edges": 100_000, "hyperedges": 10_000, "members": 256, "id": 256}
RESOURCE = "resource"
LINKS = {"api_call": "calls_api", "mirrored_file": "mirrors", "depends_on": "depends_on", "references": "references", "shared_resource": "uses"}


def concat(fragments: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all fragments, deduplicated, without dangling edges: the last row of a node, the first of an edge."""

    def numbered(frames: list[DataFrame]) -> DataFrame:
        parts = [f.withColumn("ord", F.struct(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("row"))) for k, f in enumerate(frames)]
        return settle(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))

    nodes = dedupe_nodes(numbered([f[0] for f in fragments]), "ord").drop("position")
    edges = dedupe_edges(numbered([f[1] for f in fragments]), "ord")
    return nodes, prune_dangling(nodes, edges)


def merge_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Nodes of several chunks of one extraction; of equal ids the row of the first chunk stays."""
    parts = [c.withColumn("chunk", F.lit(k)) for k, c in enumerate(chunks)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    other = [c for c in both.columns if c not in ("id", "chunk")]
    rank = F.struct("chunk", F.xxhash64(*other))
    return both.groupBy("id").agg(F.min_by(F.struct(*other), rank).alias("x")).select("id", *[F.col("x")[c].alias(c) for c in other])


def promote(edges: DataFrame) -> DataFrame:
    """Edges with a key of their own: equal rows are one, rows that differ in anything stay parallel. ``true_src`` and ``true_dst``, where there, give the direction."""
    oriented = edges
    if {"true_src", "true_dst"} <= set(edges.columns):
        oriented = edges.withColumns({"src": F.coalesce("true_src", "src"), "dst": F.coalesce("true_dst", "dst")}).drop("true_src", "true_dst")
    rest = sorted(c for c in oriented.columns if c not in ("src", "dst"))
    key = F.sha2(F.to_json(F.struct("src", "dst", *rest), {"ignoreNullFields": "false"}), 256)
    return oriented.distinct().withColumn("edge_key", F.substring(key, 1, 16))


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, n`` of a fragment: too many rows, ids that are missing or too long, ends without a node."""
    n = nodes.agg(F.count("*").alias("n"), F.count_if(F.coalesce("id", F.lit("")) == "").alias("missing"), F.count_if(F.length("id") > LIMITS["id"]).alias("long"))
    e = edges.agg(F.count("*").alias("e"))
    loose = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").agg(F.count("*").alias("loose_src"))
    end = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("loose_dst"))
    row = n.crossJoin(e).crossJoin(loose).crossJoin(end)  # one row each
    found = [("too_many_nodes", F.greatest(F.col("n") - LIMITS["nodes"], F.lit(0))), ("too_many_edges", F.greatest(F.col("e") - LIMITS["edges"], F.lit(0))), ("missing_id", F.col("missing")), ("long_id", F.col("long")), ("unknown_source", F.col("loose_src")), ("unknown_target", F.col("loose_dst"))]
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), v.cast("long").alias("n")) for k, v in found])).alias("x")).select("x.problem", "x.n").where("n > 0")


def fold_rationales(nodes: DataFrame, edges: DataFrame, words: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label is a sentence (``words`` words or more) and that only give a reason become the attribute ``rationale`` of what they explain."""
    said = nodes.where((F.col("file_type") == "rationale") & (F.size(F.split(F.trim("label"), r"\s+")) >= words)).select(F.col("id").alias("src"), F.col("label").alias("reason"))
    told = edges.where("relation = 'rationale_for'").join(said, "src")
    reasons = told.groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("reason")), "\n").alias("rationale"))
    gone = told.select(F.col("src").alias("id")).distinct()
    left = nodes.join(gone, "id", "left_anti").join(reasons, "id", "left")
    return left, edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def rekey(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that nodes of several source files share get their file as an ending; edges follow within the file they come from."""
    shared = nodes.groupBy("id").agg(F.countDistinct("source_file").alias("n")).where("n > 1").select("id")
    ending = F.regexp_replace(F.lower(F.coalesce("source_file", F.lit(""))), r"[^\w]+", "_")
    own = nodes.join(shared, "id", "left_semi").select("id", "source_file", F.concat("id", F.lit("__"), ending).alias("new")).distinct()
    moved = nodes.join(own, ["id", "source_file"], "left").withColumn("id", F.coalesce("new", "id")).drop("new")
    for end in ("src", "dst"):
        to = own.select(F.col("id").alias(end), "source_file", "new")
        edges = edges.join(to, [end, "source_file"], "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return moved, edges


# --- a shared graph of repos


def _tagged(rows: DataFrame, tag: str) -> DataFrame:
    """Nodes or edges of a repo under its tag."""
    if "id" in rows.columns:
        return retag(rows, tag)
    return rows.withColumns({"src": F.concat(F.lit(f"{tag}::"), "src"), "dst": F.concat(F.lit(f"{tag}::"), "dst"), "repo": F.lit(tag)})


def replace_repo(shared: DataFrame | None, fresh: DataFrame, tag: str) -> DataFrame:
    """The shared table with the rows of repo ``tag`` replaced."""
    mine = _tagged(fresh, tag)
    return mine if shared is None else shared.where(F.col("repo") != tag).unionByName(mine, allowMissingColumns=True)


def _content(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order."""
    row = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return f"{row.n}:{row.h}"


def put_repo(nodes: DataFrame, edges: DataFrame, root: str, tag: str) -> bool:
    """Publishes a repo's graph in the shared one at ``root``; whether anything was written. A repo whose rows are unchanged is left as it is.

    Each repo lies in a segment of its own, and the published table of repos says in which: other repos' files aren't touched.
    """
    spark, content = nodes.sparkSession, f"{_content(nodes)}/{_content(edges)}"
    at = versions.current(spark, root)
    old = versions.table(spark, at, "repos") if at else None
    if old is not None and not old.where((F.col("repo") == tag) & (F.col("content") == content)).isEmpty():
        return False
    segment = f"s{uuid.uuid4().hex}"
    for name, rows in (("nodes", nodes), ("edges", edges)):
        _tagged(rows, tag).write.parquet(f"{root}/{name}/segment={segment}")
    mine = spark.createDataFrame([(tag, content, segment)], "repo string, content string, segment string")
    repos = mine if old is None else old.where(F.col("repo") != tag).unionByName(mine)
    with versions.publish(spark, root) as folder:
        repos.write.parquet(f"{folder}/repos")
    return True


def drop_repo(spark: SparkSession, root: str, tag: str) -> None:
    """The repo leaves the shared graph."""
    repos = versions.table(spark, versions.current(spark, root), "repos").where(F.col("repo") != tag)
    with versions.publish(spark, root) as folder:
        repos.write.parquet(f"{folder}/repos")


def shared_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of all repos as published now; what is read stays that version, whatever is published meanwhile."""
    at = versions.current(spark, root)
    if at is None:
        return None
    held = [r.segment for r in versions.table(spark, at, "repos").select("segment").collect()]  # a row per repo
    nodes, edges = (spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}").where(F.col("segment").isin(held)).drop("segment") for name in ("nodes", "edges"))
    return nodes, edges


def list_repos(shared: DataFrame) -> DataFrame:
    return shared.groupBy("repo").agg(F.count("*").alias("n"))


def merge_graphs(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs under distinct tags: ids become ``tag::id`` in both; communities are moved on so that they don't meet."""
    tags: list[str] = []
    nodes, edges, offset = [], [], 0
    for tag, n, e in graphs:
        while tag in tags:
            tag += "-2"
        tags.append(tag)
        own = retag(n, tag)
        if "community" in n.columns:
            own = own.withColumn("community", F.col("community") + offset)
            offset += (n.agg(F.max("community")).first()[0] or 0) + 1
        nodes.append(own)
        edges.append(e.withColumns({"src": F.concat(F.lit(f"{tag}::"), "src"), "dst": F.concat(F.lit(f"{tag}::"), "dst")}))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union(nodes), union(edges)


# --- declared links


def _ends(link: dict) -> list[tuple[str, dict]]:
    """Names and selectors of what a link joins: two ends, or the referents of a shared resource."""
    if link.get("type") == "shared_resource":
        return [(f"referents[{k}]", r) for k, r in enumerate(link.get("referents") or [])]
    return [(end, link.get(end)) for end in ("from", "to")]


def check_spec(spec: dict) -> list[str]:
    """What is wrong with the declaration of a group of repos; empty if nothing."""
    out = []
    members = spec.get("members")
    if not isinstance(members, list) or not members:
        return ["members: a list with at least one entry is needed"]
    tags = [m.get("tag") if isinstance(m, dict) else None for m in members]
    out += [f"members[{k}]: tag is missing" for k, t in enumerate(tags) if not t]
    out += [f"members: tag {t!r} is used twice" for t in sorted({t for t in tags if t and tags.count(t) > 1})]
    for k, link in enumerate(spec.get("links") or []):
        if not isinstance(link, dict) or link.get("type") not in LINKS:
            out.append(f"links[{k}]: type must be one of {', '.join(sorted(LINKS))}")
            continue
        if link["type"] == "shared_resource" and not (link.get("name") and link.get("referents")):
            out.append(f"links[{k}]: a shared resource needs a name and referents")
        for end, s in _ends(link):
            if not isinstance(s, dict) or s.get("member") not in tags:
                out.append(f"links[{k}].{end}: member is unknown")
            elif not any(s.get(c) for c in ("id", "file", "label")):
                out.append(f"links[{k}].{end}: one of id, file, label is needed")
    return out


def _hub(link: dict) -> str:
    return f"{RESOURCE}::{link.get('kind') or 'resource'}:{link['name']}"


def resources(spark: SparkSession, spec: dict) -> DataFrame:
    """``id, label, file_type, repo``: a node for each shared resource that a spec declares."""
    rows = {_hub(x): x for x in spec.get("links") or [] if x.get("type") == "shared_resource"}
    return spark.createDataFrame([(i, x["name"], x.get("kind") or "resource", RESOURCE) for i, x in sorted(rows.items())], "id string, label string, file_type string, repo string")


def select(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """``link, end, id`` of the nodes that selectors (``link, end, member, by, value``) mean: by id, by file (the file's own node, its path equal or at a slash),
    by label (exact, else in any case).

    All selectors are joined at once, each kind on a key that it shares with few nodes.
    """
    own = nodes.select("id", "repo", "label", "source_file")
    by = {k: F.broadcast(selectors.where(F.col("by") == k)) for k in ("id", "file", "label")}  # a spec's table
    ids = own.join(by["id"], (F.col("repo") == F.col("member")) & (F.col("id") == F.concat("member", F.lit("::"), "value"))).select("link", "end", "id")
    base = F.element_at(F.split("value", "/"), -1)
    files = own.join(by["file"], (F.col("repo") == F.col("member")) & (F.col("label") == base)).where(path_match(F.col("source_file"), F.col("value")) & (F.col("label") == F.element_at(F.split("source_file", "/"), -1))).select("link", "end", "id")
    named = own.join(by["label"], (F.col("repo") == F.col("member")) & (F.lower("label") == F.lower("value"))).select("link", "end", "id", (F.col("label") == F.col("value")).alias("exact"))
    sure = named.where("exact").select("link", "end").distinct()
    named = named.join(F.broadcast(sure.withColumn("sure", F.lit(True))), ["link", "end"], "left").where("exact or sure is null").select("link", "end", "id")
    return ids.unionByName(files).unionByName(named)


def declared(nodes: DataFrame, spec: dict, strict: bool = True) -> tuple[DataFrame, list[str]]:
    """Edges (``src, dst, relation``) of the links that a spec declares, and reports on selectors that mean no node or several.

    What refers to a shared resource is linked with the resource's node (:func:`resources`); a link with an unclear end gives no edge,
    an unclear referent leaves the others.
    """
    if wrong := check_spec(spec):
        raise ValueError("; ".join(wrong))
    spark, links = nodes.sparkSession, spec.get("links") or []
    kinds = [(k, end, s["member"], next(c for c in ("id", "file", "label") if s.get(c)), s) for k, link in enumerate(links) for end, s in _ends(link)]
    wanted = spark.createDataFrame([(k, end, member, by, s[by]) for k, end, member, by, s in kinds], "link int, end string, member string, by string, value string")
    found = {(r.link, r.end): r for r in select(nodes, wanted).groupBy("link", "end").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).collect()}  # a row per selector
    reports = [f"links[{k}].{end}: {'no node' if (k, end) not in found else 'several nodes'}" for k, end, *_ in kinds if (k, end) not in found or found[k, end].n > 1]
    if strict and reports:
        raise ValueError("; ".join(reports))
    clear = {key: r.id for key, r in found.items() if r.n == 1}
    rows = []
    for k, link in enumerate(links):
        if link["type"] == "shared_resource":
            rows += [(clear[k, end], _hub(link), LINKS[link["type"]]) for end, _ in _ends(link) if (k, end) in clear]
        elif (k, "from") in clear and (k, "to") in clear:
            rows.append((clear[k, "from"], clear[k, "to"], LINKS[link["type"]]))
    return spark.createDataFrame(rows, "src string, dst string, relation string"), reports
