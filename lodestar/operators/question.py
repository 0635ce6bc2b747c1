"""From a question to a piece of the graph as text: terms, seeds, context, walk, rendering; paths and nodes on their own."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.store import settle
from . import retrieval, traverse
from .graph import degree
from .upkeep import by_context

#: Words that only ask, in several languages.
ASKING = frozenset(
    "how what why when where which who whom whose does did is are was were be been being can could should would will shall may might must has have had "
    "the and but not for from with without into onto off that this these those there here its their them they about any all some work works working "
    "der die das den dem ein eine und oder nicht wie wer wann wo warum wieso welche welcher welches ist sind wird wurde hat haben kann koennen können soll "
    "muss sich bei mit von fuer für ueber über nach aus gibt es funktioniert geaendert geändert aendert ändert "
    "pourquoi quand quel quelle quels quelles quoi qui que est sont fonctionne cette dans avec où "
    "cómo como qué cuál cuáles cuándo dónde donde porque por para funciona está están hay "
    "qual quais quando onde são estão tem uma não perché cosa quale quali dove funziona sono che della".split()
)
#: Words for a relation; they rank like others but have no seat of their own among the seeds.
RELATIONAL = frozenset(
    "call calls called caller callers invoke invokes invoked use uses used using import imports imported export exports exported "
    "extend extends extended implement implements implemented depend depends reference references referenced".split()
)
#: Words of a question that hint at a context, and other names of contexts.
HINTS = {
    "call": "call calls called caller callers invoke invokes invoked",
    "import": "import imports imported module modules",
    "field": "field fields member members property properties",
    "parameter_type": "parameter parameters param params argument arguments",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
}
ALIASES = {
    "parameter_type": "param params parameter parameters argument arguments arg args",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
    "attribute": "annotation annotations decorator decorators",
    "call": "calls called invoke invocation",
    "field": "fields property properties member members",
    "import": "imports imported module modules",
    "export": "exports exported",
}
_CONTEXT_OF = {alias: context for context, names in ALIASES.items() for alias in names.split()}
#: Characters that a token of rendered text is taken to have.
PER_TOKEN = 3


def bare(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def searchable(term: str) -> bool:
    return len(term) > 2 or not re.fullmatch("[a-z]*", term)


def terms(question: str) -> list[str]:
    """Words to look for. Runs of Chinese characters give their pairs and themselves; words that only ask go unless there are no others."""
    out = []
    for word in question.lower().split():
        if re.search("[一-鿿]", word):
            pairs = [word[k : k + 2] for k in range(len(word) - 1)] or [word]
            out += pairs + ([word] if len(word) > 1 and word not in pairs else [])
        else:
            out += re.findall(r"\w+", word)
    out = [t for t in out if searchable(t)]
    return [t for t in out if t not in ASKING] or out


def contexts(question: str, wanted: list[str] | None = None) -> tuple[list[str], str | None]:
    """Contexts of edges to keep and why: those asked for (``explicit``), those the question hints at (``heuristic``), or none."""
    named = [_CONTEXT_OF.get(k, k) for k in (bare(str(x)).strip().lower() for x in wanted or ()) if k]
    if named:
        return list(dict.fromkeys(named)), "explicit"
    said = {bare(w).lower() for w in re.split(r"[\s?,]+", question)}
    hinted = [c for c, words in HINTS.items() if said & set(words.split())]
    return hinted, "heuristic" if hinted else None


def rank(nodes: DataFrame, wanted: list[str]) -> DataFrame:
    """``id, label, score, matched`` of nodes by terms; a term weighs by how few labels hold it."""
    label = X.folded(F.col("label"))
    wanted = list(dict.fromkeys(X.fold(t) for t in wanted))
    if not wanted:
        return nodes.select("id", "label", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched")).where("false")
    row = nodes.agg(F.count("*").alias("n"), *[F.count_if(label.contains(t)).alias(f"t{k}") for k, t in enumerate(wanted)]).first()
    return retrieval.score(nodes, {t: math.log(1 + row.n / (1 + row[f"t{k}"])) for k, t in enumerate(wanted)})


def seeds(nodes: DataFrame, edges: DataFrame, question: str, k: int = 3, share: float = 0.2) -> DataFrame:
    """``id, label, score``: the best ``k`` of at least ``share`` of the best score, one a label, and the best node of every term.

    A term's own node is that of highest degree among those of the term alone; words for a relation have none, unless all terms are such.
    """
    wanted = terms(question)
    scored = settle(rank(nodes, wanted))
    best = retrieval.seeds(scored, k, share)
    own = [X.fold(t) for t in dict.fromkeys(wanted) if t not in RELATIONAL] or [X.fold(t) for t in dict.fromkeys(wanted)]
    told = scored.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    for t in own:
        hit = told.where(X.folded(F.col("label")).contains(t))
        one = hit.orderBy((X.folded(F.col("label")) != t).cast("int"), F.desc("degree"), F.length("label"), "id").limit(1)
        best = best.unionByName(one.select("id", "label", "score"))
    return settle(best.groupBy("label").agg(F.max_by(F.struct("id", "score"), F.struct("score", F.hash("id"))).alias("x")).select("x.id", "label", "x.score"))


def walk(nodes: DataFrame, edges: DataFrame, question: str, mode: str = "bfs", depth: int = 3, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, visited nodes ``id, depth``, edges among them) of a question."""
    start = seeds(nodes, edges, question)
    kept = by_context(edges, contexts(question, wanted)[0])
    hub = traverse.hub_limit(edges, nodes)
    depth = max(1, min(depth, 6))
    visited = traverse.dfs(kept, start, depth, hub=hub).select("id", F.col("depth").cast("int").alias("depth")) if mode == "dfs" else traverse.bfs(kept, start, depth, hub=hub)
    visited = settle(visited)
    return start, visited, settle(traverse.induced(kept, visited.select("id")))


def rendered(nodes: DataFrame, edges: DataFrame, visited: DataFrame, start: DataFrame, budget: int = 2000) -> DataFrame:
    """``place, line``: seeds, then nodes by distance, falling degree and id, then edges, as far as the budget of tokens goes.

    Seeds are never cut; where all nodes fit, no edge is.
    """
    deg = degree(edges)
    own = visited.join(nodes.select("id", "label", "source_file"), "id").join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    own = own.join(start.select("id", F.lit(True).alias("is_seed")), "id", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    line = F.concat(F.lit("NODE "), "label", F.lit(" ["), F.coalesce("source_file", F.lit("")), F.lit("]"))
    told = own.select(F.lit(0).alias("kind"), (~F.col("is_seed")).cast("int").alias("a"), F.col("depth").alias("b"), (-F.col("degree")).alias("c"), F.col("id").alias("d"), line.alias("line"))
    ends = edges.select("src", "dst", "relation").join(nodes.select(F.col("id").alias("src"), F.col("label").alias("from")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst")
    link = ends.select(F.lit(1).alias("kind"), F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.concat_ws("\0", "src", "dst", "relation").alias("d"), F.concat(F.lit("EDGE "), "from", F.lit(" --"), "relation", F.lit("--> "), "to").alias("line"))
    # a line has at least seven characters, so that only so many lines, nodes first, can lie within the budget
    told = settle(told)
    all_fit = (told.agg(F.sum(F.length("line") + 1)).first()[0] or 0) <= budget * PER_TOKEN
    lines = settle(told.unionByName(link).orderBy("kind", "a", "b", "c", "d").limit(budget * PER_TOKEN))
    order = Window.orderBy("kind", "a", "b", "c", "d")  # at most budget * PER_TOKEN rows
    upto = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = (upto <= budget * PER_TOKEN) | (F.col("a") == 0) | ((F.col("kind") == 1) & F.lit(all_fit))
    return lines.withColumns({"fits": fits, "place": F.row_number().over(order).cast("long")}).where("fits").select("place", "line")


def query_graph(nodes: DataFrame, edges: DataFrame, question: str, mode: str = "bfs", depth: int = 3, wanted: list[str] | None = None, budget: int = 2000) -> DataFrame:
    """``place, line``: the answer to a question as lines of text."""
    start, visited, inner = walk(nodes, edges, question, mode, depth, wanted)
    return rendered(nodes, inner, visited, start, budget)


def endpoint(nodes: DataFrame, query: str) -> str | None:
    """Id of the first ranked node whose label holds all words of the query, else of the first ranked one."""
    words = terms(query)
    scored = settle(rank(nodes, words))
    held = F.lit(True)
    for w in words:
        held = held & F.lower("label").contains(w)
    got = scored.orderBy((~held).cast("int"), F.desc("score"), F.length("label"), "id").select("id").first()
    return got.id if got else None


def unclear(nodes: DataFrame, query: str, share: float = 0.9) -> bool:
    """Whether the second node comes within a tenth of the first."""
    top = rank(nodes, terms(query)).orderBy(F.desc("score")).select("score").limit(2).collect()
    return len(top) == 2 and top[1].score >= share * top[0].score


def path_text(nodes: DataFrame, edges: DataFrame, source: str, target: str, hops: int = 8, directed: bool = True) -> DataFrame:
    """``step, id, label, relations`` of the shortest path between what two queries find."""
    a, b = endpoint(nodes, source), endpoint(nodes, target)
    found = traverse.shortest_path(edges, a, b, hops, directed) if a and b else edges.sparkSession.createDataFrame([], "step long, id string, relations string")
    return found.join(nodes.select("id", "label"), "id", "left").select("step", "id", "label", "relations")


def resolve_seed(nodes: DataFrame, query: str) -> str | None:
    """Id of the node meant: by id, unique label, unique bare name, unique source file (or its own node), unique part of a label; else None."""
    q = query.strip().lower()
    name = F.regexp_replace(F.lower("label"), r"^\.|\(\)$", "")
    path, label = F.lower(F.coalesce("source_file", F.lit(""))), F.lower("label")
    own = nodes.select("id", F.col("id").eqNullSafe(query).alias("r0"), (label == q).alias("r1"), (name == re.sub(r"^\.|\(\)$", "", q)).alias("r2"), (path == q).alias("r3"), label.contains(q).alias("r4"), (label == F.element_at(F.split(path, "/"), -1)).alias("own"))
    row = own.agg(*[F.count_if(f"r{k}").alias(f"n{k}") for k in range(5)], *[F.min(F.when(F.col(f"r{k}"), F.col("id"))).alias(f"i{k}") for k in range(5)], F.count_if(F.col("r3") & F.col("own")).alias("n5"), F.min(F.when(F.col("r3") & F.col("own"), F.col("id"))).alias("i5")).first()
    for k in (0, 1, 2, 3, 5, 4):
        if row[f"n{k}"] == 1:
            return row[f"i{k}"]
    return None


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """The node's row with its degree and the numbers of edges in and out."""
    touched = edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    n = touched.agg(F.count_if(F.col("src") == node_id).alias("n_out"), F.count_if(F.col("dst") == node_id).alias("n_in"))
    return nodes.where(F.col("id") == node_id).crossJoin(F.broadcast(n)).withColumn("degree", F.col("n_out") + F.col("n_in"))  # n is one row


def neighbourhood(nodes: DataFrame, edges: DataFrame, focus: str = "", limit: int = 50) -> DataFrame:
    """Edges with both labels, ordered; only those at ``focus`` where given; at most ``limit``."""
    kept = edges if not focus else edges.where((F.col("src") == focus) | (F.col("dst") == focus))
    few = kept.select("src", "dst", "relation").distinct().orderBy("src", "dst", "relation").limit(limit)
    return few.join(nodes.select(F.col("id").alias("src"), F.col("label").alias("from")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst")


def path_match(a, b):
    """Whether two paths are equal or one ends with the other at a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def matched_files(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted, known``: paths (``path``) that match at a slash, found through the tails of both, not by comparing all."""

    def tails(df, name):
        parts = F.split("path", "/")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        return df.select(F.col("path").alias(name), F.explode(ends).alias("tail")), df.select(F.col("path").alias(name), F.col("path").alias("tail"))

    (many_a, one_a), (many_b, one_b) = tails(wanted.select("path").distinct(), "wanted"), tails(known.select("path").distinct(), "known")
    return many_a.join(one_b, "tail").select("wanted", "known").unionByName(one_a.join(many_b, "tail").select("wanted", "known")).distinct()


def log_query(spark: SparkSession, path: str, kind: str, question: str, corpus: str, nodes_returned: int, duration_ms: float) -> None:
    """Appends a record of a query to a JSON lines folder."""
    row = [(kind, question, corpus, int(nodes_returned), float(duration_ms))]
    spark.createDataFrame(row, "kind string, question string, corpus string, nodes_returned long, duration_ms double").withColumn("at", F.current_timestamp()).write.mode("append").json(path)
