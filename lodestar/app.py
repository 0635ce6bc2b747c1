"""The query surface: one table of commands over a stored graph, used by the command line, by tool servers and by HTTP handlers alike."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cluster, graph, lifecycle, question, symbols, traverse
from .operators import community as C
from .operators import memory as M
from .sinks import exports, reports
from .sources import corpus, extract

Rows = list[dict]


@dataclass
class Graph:
    """Nodes and edges on which commands work."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "Graph":
        return cls(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))

    def write(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{folder}/edges")


#: name: (function of a graph and its arguments, arguments with their defaults, what it does)
COMMANDS: dict[str, tuple[Callable, dict, str]] = {}


def command(help_: str, **arguments):
    def keep(f):
        COMMANDS[f.__name__] = (f, arguments, help_)
        return f

    return keep


def _rows(df: DataFrame, most: int = 1000) -> Rows:
    """The first ``most`` rows; if there are more, a last one says how many were left out."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    return rows if len(rows) <= most else [*rows[:most], {"left_out": df.count() - most}]


@command("answer a question with a piece of the graph", question="", mode="bfs", depth=3, budget=2000)
def query_graph(g: Graph, question: str, mode: str, depth: int, budget: int) -> str:
    from .operators.question import query_graph as ask

    return "\n".join(r.line for r in ask(g.nodes, g.edges, question, mode, int(depth), budget=int(budget)).orderBy("place").collect())


@command("show one node", id="")
def get_node(g: Graph, id: str) -> Rows:  # noqa: A002
    return _rows(question.node_detail(g.nodes, g.edges, question.resolve_seed(g.nodes, id) or id))


@command("show the edges at a node", id="", relation="")
def get_neighbors(g: Graph, id: str, relation: str) -> Rows:  # noqa: A002
    kept = g.edges.where(F.col("relation").contains(relation)) if relation else g.edges
    return _rows(question.neighbourhood(g.nodes, kept, question.resolve_seed(g.nodes, id) or id))


@command("show the members of a community", community=0)
def get_community(g: Graph, community: int) -> Rows:
    return _rows(g.nodes.where(F.col("community") == int(community)).orderBy("id"))


@command("the most connected entities", k=10)
def god_nodes(g: Graph, k: int) -> Rows:
    return _rows(graph.god_nodes(g.nodes, g.edges, int(k)))


@command("sizes and confidence")
def graph_stats(g: Graph) -> Rows:
    return _rows(graph.stats(g.nodes, g.edges))


@command("the shortest path between what two queries find", source="", target="", hops=8)
def shortest_path(g: Graph, source: str, target: str, hops: int) -> Rows:
    return _rows(question.path_text(g.nodes, g.edges, source, target, int(hops)).orderBy("step"))


@command("what depends on a node", id="", depth=2, relations="calls,imports_from,inherits,references")
def affected(g: Graph, id: str, depth: int, relations: str) -> Rows:  # noqa: A002
    seed = question.resolve_seed(g.nodes, id)
    if seed is None:
        return []
    start = g.nodes.where(F.col("id") == seed).select("id")
    return _rows(traverse.affected(g.edges, start, relations.split(","), int(depth)).orderBy("depth", "id"))


@command("edges that hide a problem")
def diagnose(g: Graph) -> Rows:
    return _rows(graph.dangling(g.nodes, g.edges))


@command("partition the graph")
def communities(g: Graph) -> Rows:
    found = cluster.cluster(g.nodes, g.edges)
    return _rows(found.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("community"))


@command("surprising connections", k=5)
def surprises(g: Graph, k: int) -> Rows:
    return _rows(C.surprises(g.nodes, g.edges).orderBy(F.desc("score"), "src", "dst").limit(int(k)))


@command("a report in Markdown")
def report(g: Graph) -> str:
    return reports.report(g.nodes, g.edges)


@command("an export: graphml, cypher, json, html, svg or canvas", form="json", path="")
def export(g: Graph, form: str, path: str) -> str:
    if form in ("graphml", "cypher", "json"):
        exports.write({"graphml": exports.graphml, "cypher": exports.cypher, "json": exports.graph_json}[form](g.nodes, g.edges), path)
        return path
    return {"html": reports.page, "svg": reports.svg, "canvas": reports.canvas}[form](g.nodes, g.edges)


@command("symbols by name", q="", kind="")
def search_symbol(g: Graph, q: str, kind: str) -> Rows:
    return _rows(symbols.search(g.nodes.withColumnRenamed("label", "name"), q, kind).limit(200))


def run(g: Graph, name: str, **arguments) -> Rows | str:
    """A command by name; unknown names and arguments are refused."""
    if name not in COMMANDS:
        raise KeyError(f"unknown command {name!r}; there are {', '.join(sorted(COMMANDS))}")
    f, known, _ = COMMANDS[name]
    if extra := set(arguments) - set(known):
        raise TypeError(f"{name} has no argument {', '.join(sorted(extra))}")
    return f(g, **(known | arguments))


def tools() -> Rows:
    """The commands as tool descriptions."""
    kind = lambda v: {"type": "integer" if isinstance(v, int) else "string", "default": v}
    return [{"name": n, "description": h, "inputSchema": {"type": "object", "properties": {k: kind(v) for k, v in a.items()}}} for n, (_, a, h) in sorted(COMMANDS.items())]


def rpc(g: Graph, message: dict) -> dict:
    """The answer to a JSON-RPC message of a tool client: ``tools/list`` or ``tools/call``."""
    reply = {"jsonrpc": "2.0", "id": message.get("id")}
    try:
        if message.get("method") == "tools/list":
            return reply | {"result": {"tools": tools()}}
        if message.get("method") == "tools/call":
            p = message.get("params") or {}
            got = run(g, p.get("name"), **(p.get("arguments") or {}))
            return reply | {"result": {"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, default=str)}]}}
        return reply | {"error": {"code": -32601, "message": "unknown method"}}
    except (KeyError, TypeError, ValueError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}


def handle(g: Graph, method: str, path: str, parameters: dict | None = None) -> tuple[int, object]:
    """(status, body) of an HTTP request: ``GET /api/<command>`` with its arguments as parameters."""
    if method != "GET" or not path.startswith("/api/"):
        return 404, {"error": "not found"}
    try:
        return 200, run(g, path.removeprefix("/api/").strip("/"), **(parameters or {}))
    except KeyError as e:
        return 404, {"error": str(e)}
    except (TypeError, ValueError) as e:
        return 400, {"error": str(e)}


def events(answer: Callable[[], Iterator[str]], cancelled: Callable[[], bool] = lambda: False) -> Iterator[bytes]:
    """Server-sent events of an answer as it comes: started, a delta each, finished, or cancelled or failed."""

    def event(kind: str, **data) -> bytes:
        return f"event: {kind}\ndata: {json.dumps(data, sort_keys=True)}\n\n".encode()

    yield event("run_started", at=int(time.time()))
    try:
        for k, piece in enumerate(answer()):
            if cancelled():
                yield event("run_cancelled")
                return
            yield event("text_delta", seq=k, text=piece)
    except Exception as e:  # noqa: BLE001  the client is told
        yield event("run_error", message=str(e))
        return
    yield event("run_finished")


class Chat:
    """Questions about a graph with a history a thread: retrieval, synthesis, feedback, suggestions."""

    def __init__(self, g: Graph, model: Callable | None = None, keep: int = 200):
        self.g, self.model, self.keep = g, model, keep
        self.turns: dict[str, list[dict]] = {}

    def ask(self, query: str, thread: str = "", depth: int = 2) -> dict:
        from .operators.envelope import synthesize

        if not query.strip():
            return {"answer": "", "problems": ["empty_query"], "evidence": []}
        start, visited, _ = question.walk(self.g.nodes, self.g.edges, query, depth=depth)
        found = visited.join(self.g.nodes.select("id", "label"), "id").orderBy("depth", "id").limit(20).collect()
        evidence = [{"id": r.id, "text": r.label, "depth": r.depth} for r in found]
        turn = {"query": query, "answer": synthesize(query, evidence, self.model), "evidence": evidence, "problems": [], "feedback": None}
        own = self.turns.setdefault(thread, [])
        own.append(turn | {"seq": (own[-1]["seq"] if own else 0) + 1})
        del own[: -self.keep]
        return own[-1]

    def stream(self, query: str, thread: str = "", cancelled: Callable[[], bool] = lambda: False) -> Iterator[bytes]:
        return events(lambda: iter(self.ask(query, thread)["answer"].splitlines(keepends=True)), cancelled)

    def feedback(self, thread: str, seq: int, useful: bool) -> None:
        for t in self.turns.get(thread, ()):
            if t["seq"] == seq:
                t["feedback"] = "useful" if useful else "dead_end"

    def suggestions(self, k: int = 3) -> list[str]:
        return [f"What does {r.label} depend on?" for r in graph.god_nodes(self.g.nodes, self.g.edges, k).collect()]


#: Plug-ins. Passes over a graph by the suffixes that call for them, in order; embedders by name.
PASSES: list[tuple[str, frozenset[str], Callable[[DataFrame, DataFrame], DataFrame]]] = []
EMBEDDERS: dict[str, Callable] = {M.EMBEDDER: M.embed}


def register_pass(name: str, suffixes: set[str], f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A pass (nodes, edges) to edges, run where a node's source file has one of the suffixes; of one name there is one."""
    PASSES[:] = [p for p in PASSES if p[0] != name] + [(name, frozenset(suffixes), f)]


def run_passes(g: Graph) -> Graph:
    there = {r.s for r in g.nodes.select(corpus.suffix(F.col("source_file")).alias("s")).distinct().collect()}
    edges = g.edges
    for _, suffixes, f in PASSES:
        if suffixes & there:
            edges = f(g.nodes, edges)
    return Graph(g.nodes, edges)


def build(spark: SparkSession, root: str) -> Graph:
    """The graph of a folder's sources, partitioned."""
    files = corpus.scan(spark, root).where("category = 'code'")
    nodes, edges = extract.graph_of(files)
    edges = edges.withColumns({"weight": F.lit(1.0), "confidence_score": F.when(F.col("confidence") == "EXTRACTED", 1.0).otherwise(0.5), "context": F.lit(None).cast("string")})
    found = cluster.cluster(nodes, edges)
    return Graph(nodes.withColumn("file_type", F.lit("code")).join(found, "id", "left"), edges)


def update(g: Graph, spark: SparkSession, root: str, paths: list[str]) -> tuple[Graph, bool]:
    """The graph with the named files read anew (gone ones dropped), and whether anything changed."""
    now = corpus.scan(spark, root).where(F.col("path").isin(paths)).select("path", "content")
    gone = spark.createDataFrame([(p, None) for p in paths], "path string, content string").join(now.select("path"), "path", "left_anti")

    def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        n, e = extract.graph_of(files)
        own = n.withColumns({"file_type": F.lit("code"), "community": F.lit(None).cast("long")})
        ends = n.select(F.col("id").alias("src"), "source_file").distinct()
        return own, e.join(ends, "src").withColumns({"weight": F.lit(1.0), "confidence_score": F.lit(1.0), "context": F.lit(None).cast("string")})

    source = g.nodes.select(F.col("id").alias("src"), "source_file")
    nodes, edges, changed = lifecycle.rebuild(g.nodes, g.edges.join(source, "src"), now.unionByName(gone), read)
    return Graph(nodes, edges.drop("source_file")), changed


def main(argv: list[str] | None = None) -> int:
    """``python -m lodestar.app build ROOT GRAPH`` or ``COMMAND GRAPH [--argument value]``."""
    top = argparse.ArgumentParser(prog="lodestar")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="extract, resolve and partition the sources of a folder")
    b.add_argument("root")
    b.add_argument("graph")
    for name, (_, known, help_) in sorted(COMMANDS.items()):
        p = sub.add_parser(name.replace("_", "-"), help=help_)
        p.add_argument("graph")
        for k, v in known.items():
            p.add_argument(f"--{k}", default=v, type=type(v))
    given = vars(top.parse_args(argv))
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    name, folder = given.pop("command"), given.pop("graph")
    if name == "build":
        build(spark, given["root"]).write(folder)
        return 0
    got = run(Graph.read(spark, folder), name.replace("-", "_"), **given)
    sys.stdout.write(got if isinstance(got, str) else "\n".join(json.dumps(r, default=str, sort_keys=True) for r in got) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
