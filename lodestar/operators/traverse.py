"""Set-at-a-time traversal. Every level is one join with the frontier; what was reached is kept in settled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import settle
from .flows import flows
from .graph import degree


def hub_limit(edges: DataFrame, nodes: DataFrame) -> int:
    """max(50, p99 of degree), p99 being the value at index int(0.99 n) of the sorted degrees (isolated nodes have 0)."""
    d = nodes.select("id").join(degree(edges), "id", "left").groupBy(F.coalesce("degree", F.lit(0)).alias("d")).agg(F.count("*").alias("n"))
    rows = sorted((r.d, r.n) for r in d.collect())  # a row per distinct degree
    at, seen = int(sum(n for _, n in rows) * 0.99), 0
    for value, n in rows:
        seen += n
        if seen > at:
            return max(50, value)
    return 50


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = True, hub: int | None = None) -> DataFrame:
    """``id, depth`` of what is reached from ``seeds`` (``id``) in at most ``depth`` steps.

    Nodes of degree ``hub`` or more are reached but not expanded unless they are seeds.
    """
    steps = edges.select("src", "dst").distinct()
    if not directed:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if hub is not None:
        hubs = degree(edges).where(F.col("degree") >= hub).select(F.col("id").alias("src"))
        hubs = hubs.join(seeds.select(F.col("id").alias("src")), "src", "left_anti")
        steps = steps.join(hubs, "src", "left_anti")
    steps = settle(steps)
    reached = settle(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = reached
    for level in range(1, depth + 1):
        new = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = settle(new.join(reached, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Every edge between given nodes, without self-loops, one per (src, dst, relation)."""
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").where("src <> dst").select("src", "dst", "relation").distinct()


#: Relations of a node to its members.
MEMBERS = ("method", "contains")


def affected(edges: DataFrame, seed: DataFrame, relations: list[str], depth: int = 2, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """``id, depth, via, relation, relations, file, place``: what depends on ``seed`` or its members, by steps against ``relations``.

    The walk starts from the seeds and what they hold (one step along ``members``); neither are hits. ``via`` is the node that a hit was
    reached from, of several the smallest; ``relations`` are all that lead to it, ``relation`` the first of them, with the file and place of its edge
    (``source_file`` and ``source_location``, null where edges have none).
    """
    blank = F.lit(None).cast("string")
    told = [(F.col(c).cast("string") if c in edges.columns else blank).alias(n) for c, n in (("source_file", "file"), ("source_location", "place"))]
    back = settle(edges.where(F.col("relation").isin(relations)).select("src", "dst", "relation", *told).distinct())
    own = edges.where(F.col("relation").isin(*members)).join(seed.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id"))
    reached = front = settle(seed.select("id").unionByName(own).distinct())
    hits = back.select(F.col("src").alias("id"), F.lit(0).alias("depth"), F.col("dst").alias("via"), "relation", F.array("relation").alias("relations"), "file", "place").limit(0)
    for level in range(1, depth + 1):
        step = front.join(back, F.col("id") == F.col("dst")).select("src", F.col("id").alias("via"), "relation", "file", "place").join(reached.withColumnRenamed("id", "src"), "src", "left_anti")
        # per pair first, so that a node with very many ways in is no group of its own
        first = F.min(F.struct("relation", F.coalesce("file", F.lit("")).alias("f"), F.coalesce("place", F.lit("")).alias("p"), "file", "place")).alias("first")
        pairs = step.groupBy("src", "via").agg(first, F.array_sort(F.collect_set("relation")).alias("relations"))
        one = pairs.groupBy("src").agg(F.min_by(F.struct("via", "first", "relations"), "via").alias("x"))
        new = settle(one.select(F.col("src").alias("id"), F.lit(level).alias("depth"), "x.via", "x.first.relation", "x.relations", "x.first.file", "x.first.place"))
        if new.isEmpty():
            break
        hits, front = hits.unionByName(new), new.select("id")
        reached = reached.unionByName(front)
    return hits


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges touched when walking both ways from ``seeds`` up to ``depth`` steps."""
    inner = bfs(edges, seeds, depth - 1, directed=False).select("id")
    e = edges.select("src", "dst", "relation").distinct()
    return e.join(inner.select(F.col("id").alias("src")), "src", "left_semi").unionByName(e.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()


def path_length(edges: DataFrame, start: DataFrame, end: str, hops: int = 8, directed: bool = True) -> DataFrame:
    """``id, depth``: the length of the shortest path to ``end``, no row if there is none within ``hops``; walks no further than needed."""
    steps = settle(_adjacent(edges, directed))
    reached = front = settle(start.select("id").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, hops + 1):
        found = front.where(F.col("id") == end)
        if not found.isEmpty():
            return found
        new = front.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = settle(new.join(reached, "id", "left_anti").withColumn("depth", F.lit(level)))
        reached = reached.unionByName(front)
    return front.where(F.col("id") == end)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of every node on an edge to another, by contraction.

    Each round a hash orders the nodes, every node joins the first of itself and its neighbours, and the graph of what is left is a fraction
    of the last; the rounds' choices are then followed back. All joins are on tables, so that hubs can be split.
    """
    def once(pairs: DataFrame) -> DataFrame:
        return settle(pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())

    pairs = once(edges)
    steps: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        order = [F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("to")) for c in ("src", "dst")]
        to = settle(both.groupBy("src").agg(F.least(F.min(order[1]), F.min(order[0])).alias("x")).select(F.col("src").alias("id"), "x.to"))
        steps.append(to)
        for c in ("src", "dst"):
            pairs = pairs.join(to.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")), c).drop(c).withColumnRenamed(f"{c}_to", c)
        pairs = once(pairs)
    if not steps:
        return pairs.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    found = steps[-1]
    for to in reversed(steps[:-1]):
        found = settle(to.join(found.select(F.col("id").alias("to"), F.col("to").alias("further")), "to", "left").select("id", F.coalesce("further", "to").alias("to")))
    first = found.groupBy("to").agg(F.min("id").alias("component"))
    return settle(found.join(first, "to").select("id", "component"))


def _trimmed(steps: DataFrame) -> DataFrame:
    """The edges that are left when nodes without edges in or out go, again and again: the others lie on no cycle."""
    left = None
    while (n := steps.count()) != left:
        left = n
        on = settle(steps.select(F.col("src").alias("id")).intersect(steps.select(F.col("dst").alias("id"))))
        steps = settle(steps.join(on.withColumnRenamed("id", "src"), "src", "left_semi").join(on.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return steps


def _coloured(steps: DataFrame) -> DataFrame:
    """``id, colour``: the first node, in the order of a hash, from which each can be reached, itself included."""
    own = F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("id"))
    colour = settle(steps.select("src").distinct().select(F.col("src").alias("id"), own.alias("colour")))
    front = colour
    while not front.isEmpty():
        told = front.join(steps, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("new"))
        new = settle(colour.join(told, F.col("id") == F.col("dst"), "left").select("id", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
        colour, front = new.select("id", "colour"), new.where("moved").select("id", "colour")
    return colour.select("id", F.col("colour.id").alias("colour"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of every node that lies on a cycle of two nodes or more.

    Trims what lies on no cycle, colours nodes by the first node that reaches them, and walks back from each colour's node within the
    colour: what that reaches is its component. Components go, and the rest is trimmed and coloured anew until nothing is left.
    """
    steps = _trimmed(settle(edges.where("src <> dst").select("src", "dst").distinct()))
    found = steps.select(F.col("src").alias("id"), F.col("dst").alias("root")).limit(0)
    while not steps.isEmpty():
        colour = settle(_coloured(steps))
        inner = steps.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = settle(inner.where("a = b").select("src", "dst", F.col("a").alias("root")))
        back = front = settle(colour.where("id = colour").select("id", F.col("colour").alias("root")))
        while not front.isEmpty():
            new = front.join(inner.select("src", F.col("dst").alias("id")), "id").select(F.col("src").alias("id"), "root").distinct()
            front = settle(new.join(back, "id", "left_anti"))
            back = settle(back.unionByName(front))
        found = found.unionByName(back)
        gone = back.select("id")
        steps = _trimmed(settle(steps.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")))
    found = settle(found)
    # a node that is alone in its colour lies between two cycles, on none
    own = found.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return settle(found.join(own, "root").select("id", "component"))


def file_graph(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...] = ("imports_from", "re_exports")) -> DataFrame:
    """``src, dst`` of files, oriented by the file that an import stands in (``edges.source_file``), whichever way its edge runs; deferred imports don't count.

    The other end's file is the target; where no end is in the importing file the edge's target's is, or else its source's. Ends without a file give none.
    """
    files = nodes.select("id", "source_file")
    kept = edges.where(F.col("relation").isin(*relations) & (F.coalesce("source_file", F.lit("")) != ""))
    if "deferred" in edges.columns:
        kept = kept.where(~F.coalesce("deferred", F.lit(False)))
    both = kept.select("src", "dst", F.col("source_file").alias("at"))
    for c in ("src", "dst"):
        both = both.join(files.select(F.col("id").alias(c), F.coalesce("source_file", F.lit("")).alias(f"{c}_file")), c, "left")
    a, b = F.coalesce("src_file", F.lit("")), F.coalesce("dst_file", F.lit(""))
    target = F.when(a == F.col("at"), b).when((b == F.col("at")) | (b == ""), a).otherwise(b)
    return both.select(F.col("at").alias("src"), target.alias("dst")).where("dst <> ''").distinct()


def cycles(edges: DataFrame, longest: int = 5, top: int | None = None) -> DataFrame:
    """``cycle, length``: simple cycles of at most ``longest`` nodes, each once, written from its smallest node; the ``top`` shortest, then first in text, if given.

    Paths grow inside strongly connected components only, from their smallest node, a step a round; with ``top`` the rounds end at the
    length at which there are enough, so that longer paths of a dense graph are never made.
    """
    e = edges.select("src", "dst").distinct()
    found = e.where("src = dst").select(F.array("src").alias("path"))
    of = strong_components(e)
    step = e.where("src <> dst").join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    step = settle(step.where("a = b").select("src", "dst"))
    last, first = F.element_at("path", -1), F.element_at("path", 1)
    paths = step.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = settle(found)
    for n in range(2, longest + 1):
        if top is not None and found.count() >= top or paths.isEmpty():
            break
        found = settle(found.unionByName(paths.join(step, (last == F.col("src")) & (first == F.col("dst")), "left_semi").select("path")))
        if n < longest:
            paths = settle(paths.join(step, last == F.col("src")).where((F.col("dst") > first) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
    out = found.select(F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length"))
    return out if top is None else out.orderBy("length", "cycle").limit(top)


def _adjacent(edges: DataFrame, directed: bool) -> DataFrame:
    steps = edges.where("src <> dst").select("src", "dst").distinct()
    return steps if directed else steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 8, directed: bool = True) -> DataFrame:
    """``step, id, relations``: the nodes of a shortest path in order, the relations that lead to each joined by ``/``; empty if none.

    Steps are taken from both ends in turn, always from the smaller frontier, and end where the two meet; of equal paths the one of smallest
    predecessors is given. Only what a frontier touches is read from the edges.
    """
    spark = edges.sparkSession
    steps = settle(_adjacent(edges, directed))
    if start == end:
        return spark.createDataFrame([(0, start, None)], "step long, id string, relations string")
    known = [settle(spark.createDataFrame([(x, None, 0)], "id string, parent string, depth int")) for x in (start, end)]
    front, size, depth = list(known), [1, 1], [0, 0]
    while sum(depth) < hops and all(size):
        side = 0 if size[0] <= size[1] else 1
        here, there = ("src", "dst") if side == 0 else ("dst", "src")
        new = front[side].select(F.col("id").alias(here)).join(steps, here).groupBy(F.col(there).alias("id")).agg(F.min(here).alias("parent"))
        depth[side] += 1
        front[side] = settle(new.join(known[side], "id", "left_anti").withColumn("depth", F.lit(depth[side])))
        size[side] = front[side].count()
        known[side] = known[side].unionByName(front[side])
        met = front[side].select("id").join(known[1 - side], "id", "left_semi").agg(F.min("id")).first()[0]
        if met is not None:
            break
    else:
        met = None
    if met is None:
        return spark.createDataFrame([], "step long, id string, relations string")

    def chain(table: DataFrame, at: str) -> list[str]:
        out = []
        while at is not None:
            out.append(at)
            at = table.where(F.col("id") == at).select("parent").first()[0]  # a row a step, at most ``hops``
        return out

    path = chain(known[0], met)[::-1] + chain(known[1], met)[1:]
    hop = spark.createDataFrame([(k, x, path[k - 1] if k else None) for k, x in enumerate(path)], "step long, id string, before string")
    ends = [(F.col("src") == F.col("before")) & (F.col("dst") == F.col("id"))] + ([] if directed else [(F.col("dst") == F.col("before")) & (F.col("src") == F.col("id"))])
    between = hop.where("before is not null").join(edges.select("src", "dst", "relation").distinct(), ends[0] if directed else ends[0] | ends[1])
    told = between.groupBy("step").agg(F.array_join(F.array_sort(F.collect_set("relation")), "/").alias("relations"))
    return hop.join(told, "step", "left").select("step", "id", "relations")


def dfs(edges: DataFrame, seeds: DataFrame, depth: int = 3, hub: int | None = None, most: int = 1_000_000) -> DataFrame:
    """``id, depth, place``: what a depth-first walk visits within ``depth`` steps, in order, from the seeds in order of id.

    A node counts as visited when it is taken from the stack, at the depth it was found at then. That order can't be had set by set, so
    the walk is done in one place, over the edges among what a breadth-first walk reaches; more than ``most`` of them are refused.
    """
    spark = edges.sparkSession
    ball = bfs(edges, seeds, depth, hub=hub).select("id")
    inner = induced(edges, ball).select("src", "dst").distinct()
    if hub is not None:
        hubs = degree(edges).where(F.col("degree") >= hub).select(F.col("id").alias("src")).join(seeds.select(F.col("id").alias("src")), "src", "left_anti")
        inner = inner.join(hubs, "src", "left_anti")
    inner = settle(inner)
    if (n := inner.count()) > most:
        raise ValueError(f"a depth-first walk over {n} edges is refused; the bound is {most}")
    after: dict[str, list[str]] = {}
    for r in inner.collect():
        after.setdefault(r.src, []).append(r.dst)
    stack = [(r.id, 0) for r in seeds.select("id").distinct().orderBy(F.desc("id")).collect()]
    seen: dict[str, int] = {}
    while stack:
        at, far = stack.pop()
        if at in seen or far > depth:
            continue
        seen[at] = far
        stack += [(x, far + 1) for x in sorted(after.get(at, ()), reverse=True) if x not in seen]
    return spark.createDataFrame([(i, d, k) for k, (i, d) in enumerate(seen.items())], "id string, depth long, place long")


def _folded(steps: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(``src, dst`` of the core; ``id, nodes, pivots`` of the nodes that stay; ``id, to, nodes, pivots`` of those that went, by round).

    Nodes with a single neighbour go into it, round by round, with how many nodes and pivots they stand for; of two that have only one another
    the smaller stays. What stays is the core of cycles and the paths between them, or one node of a tree.
    """
    of = settle(steps.select(F.col("src").alias("id")).unionByName(pivots.select("id")).distinct().join(pivots.select("id", F.lit(1).alias("p")).distinct(), "id", "left").select("id", F.lit(1).cast("long").alias("nodes"), F.coalesce("p", F.lit(0)).cast("long").alias("pivots")))
    went = []
    while True:
        ends = steps.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to"), F.count("*").alias("n")).where("n = 1").select("id", "to")
        other = ends.select(F.col("id").alias("to"), F.lit(True).alias("mutual"))
        gone = settle(ends.join(other, "to", "left").where("mutual is null or id > to").drop("mutual").join(of, "id"))
        if gone.isEmpty():
            return steps, of, went
        went.append(gone)
        more = gone.groupBy(F.col("to").alias("id")).agg(F.sum("nodes").alias("n"), F.sum("pivots").alias("p"))
        of = settle(of.join(gone.select("id"), "id", "left_anti").join(more, "id", "left").select("id", (F.col("nodes") + F.coalesce("n", F.lit(0))).alias("nodes"), (F.col("pivots") + F.coalesce("p", F.lit(0))).alias("pivots")))
        for c in ("src", "dst"):
            steps = steps.join(gone.select(F.col("id").alias(c)), c, "left_anti")
        steps = settle(steps)


def _flows(steps: DataFrame, of: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(``id, score``; ``src, dst, score``) of shortest paths along ``steps``, each by the pivots its start and the nodes its end stand for.

    Paths are counted forward level by level for all pivots at once, then dependencies are added up backward; every level is a
    join and an aggregation keyed by (pivot, node).
    """
    if steps.isEmpty():
        return None, None
    weight = of.select("id", F.col("nodes").cast("double").alias("own"))
    start = of.where("pivots > 0").select(F.col("id").alias("p"), F.col("pivots").cast("double").alias("times"))
    front = settle(start.join(steps.select(F.col("src").alias("p")).distinct(), "p", "left_semi").select("p", F.col("p").alias("id"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("p", "id")
    while True:
        new = front.join(steps, F.col("id") == F.col("src")).groupBy("p", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = settle(new.join(seen, ["p", "id"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("p", "id"))
    below, flows, sums = None, [], []
    for upper, lower in reversed(list(zip(levels, levels[1:], strict=False))):
        lower = lower.join(weight, "id")
        lower = lower.withColumn("depends", F.lit(0.0)) if below is None else lower.join(below, ["p", "id"], "left").withColumn("depends", F.coalesce("depends", F.lit(0.0)))
        to = lower.select("p", F.col("id").alias("dst"), F.col("paths").alias("all"), (F.col("own") + F.col("depends")).alias("after"))
        flow = upper.join(steps, F.col("id") == F.col("src")).join(to, ["p", "dst"]).select("p", "src", "dst", (F.col("paths") / F.col("all") * F.col("after")).alias("flow"))
        flow = settle(flow)
        flows.append(flow)
        below = flow.groupBy("p", F.col("src").alias("id")).agg(F.sum("flow").alias("depends"))
        sums.append(below.where("p <> id"))
    if not flows:
        return None, None
    nodes, ties = reduce(DataFrame.unionByName, sums), reduce(DataFrame.unionByName, flows)
    nodes = nodes.join(start, "p").groupBy("id").agg(F.sum(F.col("depends") * F.col("times")).alias("score"))
    return nodes, ties.join(start, "p").groupBy("src", "dst").agg(F.sum(F.col("flow") * F.col("times")).alias("score"))


def betweenness(edges: DataFrame, pivots: DataFrame, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``id, score``; ``src, dst, score``): how much of the shortest paths from ``pivots`` (``id``) goes through each node and edge.

    With all nodes as pivots the scores are exact (each undirected pair counts twice). Of an undirected graph what hangs on it as trees is
    counted without walking: a path there is the only one, so that an edge has all pairs of what lies on its sides, and a node all pairs of
    what its branches hold. Only the rest is walked, from every pivot, and its nodes stand for what hangs on them: in tasks that hold the
    graph and take some of the pivots each (``flows``), or by joins where it is too large for that.
    """
    steps = settle(_adjacent(edges, directed))
    pivots = settle(pivots.select("id").distinct())
    none = edges.sparkSession.createDataFrame([], "src string, dst string, score double")
    if directed:
        of = steps.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(pivots).distinct().join(pivots.withColumn("p", F.lit(1)), "id", "left").select("id", F.lit(1).alias("nodes"), F.coalesce("p", F.lit(0)).alias("pivots"))
        nodes, ties = _flows(steps, settle(of))
        return (none.select(F.col("src").alias("id"), "score") if nodes is None else nodes), (none if ties is None else ties)
    core, of, went = _folded(steps, pivots)
    nodes, ties = (None, None) if core.isEmpty() else flows(core, of) or _flows(core, of)
    parts = of.withColumn("part", F.col("id"))
    if not core.isEmpty():
        parts = of.join(components(core), "id", "left").withColumn("part", F.coalesce("component", "id"))
    sizes = parts.groupBy("part").agg(F.sum("nodes").alias("all"), F.sum("pivots").alias("starts"))
    known = settle(parts.join(sizes, "part").select("id", "nodes", "pivots", "all", "starts"))
    tree = []  # what went, with the nodes and pivots of its whole part
    for gone in reversed(went):
        told = settle(gone.join(known.select(F.col("id").alias("to"), "all", "starts"), "to"))
        tree.append(told)
        known = known.unionByName(told.select("id", "nodes", "pivots", "all", "starts"))
    if tree:
        n, p, all_, starts = (F.col(c).cast("double") for c in ("nodes", "pivots", "all", "starts"))
        branches = reduce(DataFrame.unionByName, tree)
        held = branches.select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), (p * (all_ - n) + (starts - p) * n).alias("score"))
        inner = branches.groupBy(F.col("to").alias("id")).agg(F.sum(p * (all_ - 1 - n)).alias("among"))
        through = inner.join(known, "id").select("id", (F.col("among") + (starts - p) * (n - 1)).alias("score"))
        own = none.select(F.col("src").alias("id"), "score") if nodes is None else nodes
        nodes = own.unionByName(through.where("score > 0"))
        held = held.where("score > 0")
        ties = held if ties is None else ties.unionByName(held)
    if nodes is None:
        return none.select(F.col("src").alias("id"), "score"), none if ties is None else ties
    return nodes.groupBy("id").agg(F.sum("score").alias("score")), ties.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("score").alias("score"))


def sampled_pivots(edges: DataFrame, exact: int = 1000, sample: int = 100) -> DataFrame:
    """All nodes on an edge where there are at most ``exact``, else the ``sample`` of smallest hash."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids if ids.limit(exact + 1).count() <= exact else ids.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(sample)
