"""Walks, paths, betweenness, clusters and questions against plain versions."""

import random
from collections import deque
from itertools import combinations

import numpy as np
import pytest
from lodestar.operators import cluster, question
from lodestar.operators import community as C
from lodestar.operators import traverse as V
from plain import louvain
from pyspark.sql import functions as F


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "x", 1.0, "EXTRACTED", None) for a, b in pairs], "src string, dst string, relation string, weight double, confidence string, context string")


def ids(spark, names):
    return spark.createDataFrame([(x,) for x in names], "id string")


@pytest.fixture(scope="module")
def graph():
    rnd = random.Random(6)
    names = [f"n{k:02}" for k in range(30)]
    return names, sorted({(a, b) for a, b in (rnd.sample(names, 2) for _ in range(60))})


def after(pairs, directed=True):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        if not directed:
            out.setdefault(b, set()).add(a)
    return out


def distances(start, next_):
    far, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in sorted(next_.get(x, ())):
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    return far


def test_shortest_path(spark, graph):
    names, pairs = graph
    for directed in (True, False):
        next_ = after(pairs, directed)
        for a, b in [("n00", "n07"), ("n03", "n21"), ("n05", "n05"), ("n11", "none")]:
            got = [r.id for r in V.shortest_path(frame(spark, pairs), a, b, directed=directed).orderBy("step").collect()]
            far = distances(a, next_).get(b)
            assert (far is None or far > 8) == (not got)
            if got:
                assert got[0] == a and got[-1] == b and len(got) == far + 1
                assert all(y in next_[x] for x, y in zip(got, got[1:], strict=False))
    assert V.shortest_path(frame(spark, [(str(k), str(k + 1)) for k in range(12)]), "0", "9", hops=8).count() == 0


def test_dfs(spark, graph):
    names, pairs = graph
    next_ = after(pairs)
    stack, seen = [("n04", 0), ("n01", 0)], {}
    while stack:
        x, d = stack.pop()
        if x not in seen and d <= 3:
            seen[x] = d
            stack += [(y, d + 1) for y in sorted(next_.get(x, ()), reverse=True) if y not in seen]
    got = [(r.id, r.depth) for r in V.dfs(frame(spark, pairs), ids(spark, ["n01", "n04"]), 3).orderBy("place").collect()]
    assert got == list(seen.items())
    with pytest.raises(ValueError, match="refused"):
        V.dfs(frame(spark, pairs), ids(spark, ["n01"]), 3, most=2)


def test_betweenness(spark, graph):
    names, pairs = graph
    next_ = after(pairs, False)
    far = {x: distances(x, next_) for x in next_}

    def paths(s, t):
        if s == t:
            return [[t]]
        return [[s, *p] for y in next_[s] if far[y].get(t, 99) == far[s][t] - 1 for p in paths(y, t)]

    nodes, edges = {}, {}
    for s in next_:
        for t in far[s]:
            every = paths(s, t) if s != t else []
            for p in every:
                for x in p[1:-1]:
                    nodes[x] = nodes.get(x, 0) + 1 / len(every)
                for e in zip(p, p[1:], strict=False):
                    e = tuple(sorted(e))
                    edges[e] = edges.get(e, 0) + 1 / len(every)
    n, e = V.betweenness(frame(spark, pairs), ids(spark, next_))
    assert {r.id: r.score for r in n.where("score > 1e-9").collect()} == pytest.approx(nodes)
    assert {(r.src, r.dst): r.score for r in e.collect()} == pytest.approx(edges)
    assert V.sampled_pivots(frame(spark, pairs), exact=5, sample=7).count() == 7


def test_betweenness_of_trees_and_cycles(spark, monkeypatch):
    """Trees that hang on cycles, a tree alone and pivots that are few: as counted path by path; and what hangs on a graph isn't paired with all of it."""
    rnd = random.Random(4)
    core = [(f"c{k}", f"c{(k + 1) % 6}") for k in range(6)] + [("c1", "c4")]
    names = [f"c{k}" for k in range(6)]
    hung = []
    for k in range(14):
        hung.append((f"h{k:02}", rnd.choice(names)))
        names.append(f"h{k:02}")
    tree = [(f"t{k}", f"t{rnd.randrange(k)}") for k in range(1, 7)]
    pairs = core + hung + tree
    next_ = after(pairs, False)
    far = {x: distances(x, next_) for x in next_}

    def paths(s, t):
        return [[t]] if s == t else [[s, *p] for y in sorted(next_[s]) if far[y].get(t, 99) == far[s][t] - 1 for p in paths(y, t)]

    for pivots in (sorted(next_), ["c2", "h01", "h07", "t3"], ["h13", "elsewhere"]):
        nodes, edges = {}, {}
        for s in pivots:
            for t in far.get(s, ()):
                every = paths(s, t) if s != t else []
                for p in every:
                    for x in p[1:-1]:
                        nodes[x] = nodes.get(x, 0) + 1 / len(every)
                    for e in zip(p, p[1:], strict=False):
                        edges[tuple(sorted(e))] = edges.get(tuple(sorted(e)), 0) + 1 / len(every)
        n, e = V.betweenness(frame(spark, pairs), ids(spark, pivots))
        assert {r.id: r.score for r in n.collect()} == pytest.approx(nodes)
        assert {(r.src, r.dst): r.score for r in e.collect()} == pytest.approx(edges)

    made, settle = [], V.settle
    monkeypatch.setattr(V, "settle", lambda df: (made.append(x.count()) if (x := settle(df)) is not None else None) or x)
    star = [("hub", f"x{k:03}") for k in range(300)]
    n, _ = V.betweenness(frame(spark, star), ids(spark, sorted(after(star, False))))
    assert [(r.id, r.score) for r in n.collect()] == [("hub", 300.0 * 299)]
    assert max(made) <= 600  # the pairs of its leaves are 89,700


def test_betweenness_settles_few_tables(spark, monkeypatch):
    made, settle = [], V.settle
    monkeypatch.setattr(V, "settle", lambda df: made.append(df) or settle(df))
    pairs = [("hub", "x1"), ("hub", "x2"), ("hub", "x3"), ("a", "b")]
    n, _ = V.betweenness(frame(spark, pairs), ids(spark, sorted(after(pairs, False))))
    assert [(r.id, r.score) for r in n.collect()] == [("hub", 6.0)]
    assert len(made) <= 9  # 11 when ends were settled each round


def modularity(pairs, of):
    m = len(pairs)
    k = {}
    for a, b in pairs:
        k[of[a]] = k.get(of[a], 0) + 1
        k[of[b]] = k.get(of[b], 0) + 1
    return sum(of[a] == of[b] for a, b in pairs) / m - sum((x / (2 * m)) ** 2 for x in k.values())


def planted(seed, groups=6, size=12):
    rnd = random.Random(seed)
    names = [f"g{g}m{k:02}" for g in range(groups) for k in range(size)]
    inside = [(a, b) for a, b in combinations(names, 2) if a[:2] == b[:2] and rnd.random() < 0.5]
    return names, inside + [(a, b) for a, b in combinations(names, 2) if a[:2] != b[:2] and rnd.random() < 0.015]


def together(pairs, of):
    """Whether every community is connected by pairs within it."""
    root = {x: x for x in of}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if of[a] == of[b]:
            root[find(a)] = find(b)
    return all(len({find(x) for x in of if of[x] == c}) == 1 for c in set(of.values()))


@pytest.mark.parametrize("seed,groups,size", [(3, 6, 12), (8, 25, 10)])
def test_partition_is_as_good_as_one_at_a_time(spark, seed, groups, size):
    names, pairs = planted(seed, groups, size)
    got = {r.id: r.community for r in cluster.partition(frame(spark, pairs)).collect()}
    assert set(got) == {x for p in pairs for x in p} and together(pairs, got)
    at = {x: k for k, x in enumerate(sorted(got))}
    ends = np.array([sorted((at[a], at[b])) for a, b in pairs])
    plain = louvain(ends[:, 0], ends[:, 1], np.ones(len(ends)), len(at))
    assert modularity(pairs, got) >= 0.99 * modularity(pairs, {x: plain[k] for x, k in at.items()})


def test_partition_is_the_same_in_rounds_of_joins_and_in_one_task(spark):
    rnd = np.random.default_rng(5)
    ends = [(int(a), int(a * rnd.random() ** 2)) for a in rnd.integers(1, 120, 260)]  # early nodes are hubs
    _, dense = planted(2, 4, 9)
    pairs = [(f"h{a:03}", f"h{b:03}") for a, b in ends] + dense
    a, b = (cluster.partition(frame(spark, pairs), most=most).collect() for most in (cluster.PAIRS, 150))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and together(pairs, {r.id: r.community for r in a})


def test_rounds_on_blocks_settle_nothing_and_agree_with_joins(spark, monkeypatch):
    """Rounds on blocks give what rounds of joins and one task give, without a table each."""
    pairs = planted(2, 4, 9)[1]
    one = sorted(map(tuple, cluster.partition(frame(spark, pairs)).collect()))
    made, settle = [], cluster.settle
    monkeypatch.setattr(cluster, "settle", lambda df: made.append(df) or settle(df))
    blocks = sorted(map(tuple, cluster.partition(frame(spark, pairs), most=60).collect()))
    few = len(made)
    monkeypatch.setattr(cluster, "NODES", 0)
    joins = sorted(map(tuple, cluster.partition(frame(spark, pairs), most=60).collect()))
    assert blocks == joins == one
    assert 2 * few < len(made) - few


def test_hash_is_the_engines(spark):
    x = np.array([0, 1, -5, 1 << 60, 7], np.int64)
    df = spark.createDataFrame([(int(v), int(v) * 3 % 1000) for v in x], "x long, y long")
    assert [r[0] for r in df.select(cluster._drawn(9, "x", "y")).collect()] == cluster._drawn_np(9, x, x * 3 % 1000).tolist()


def test_parts_are_graphs_of_their_own(spark):
    """Each part's communities are those it has when it is alone, though a member may be in several parts."""
    one, two = planted(11, 3, 8)[1], planted(12, 2, 10)[1]
    rows = [("p", a, b, 1.0) for a, b in one] + [("q", a, b, 2.0) for a, b in two] + [("z", "x", "x", 0.0)]
    got = cluster.communities(spark.createDataFrame(rows, "part string, a string, b string, w double")).collect()
    for part, pairs in (("p", one), ("q", two)):
        of = {r.id: r.group for r in got if r.part == part}
        at = {x: k for k, x in enumerate(sorted(of))}
        ends = np.array([sorted((at[a], at[b])) for a, b in pairs])
        plain = louvain(ends[:, 0], ends[:, 1], np.ones(len(ends)), len(at))
        assert together(pairs, of) and modularity(pairs, of) >= 0.97 * modularity(pairs, {x: plain[k] for x, k in at.items()})
    assert [r.id for r in got if r.part == "z"] == ["x"]


def test_louvain_does_no_worse_than_single_moves():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 40, (2, 150))
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    of = list(range(40))  # the plain version: move one node at a time to where modularity is highest
    moved = True
    while moved:
        moved = False
        for x in range(40):
            best = max(sorted({of[y] for p in pairs if x in p for y in p} | {of[x]}), key=lambda c: (round(modularity(pairs, dict(enumerate(of[:x] + [c] + of[x + 1 :]))), 12), c == of[x]))
            if best != of[x]:
                of[x], moved = best, True
    got = louvain(a, b, np.ones(len(a)), 40)
    assert modularity(pairs, dict(enumerate(got.tolist()))) >= modularity(pairs, dict(enumerate(of))) - 1e-9


def test_cluster_covers_splits_and_numbers(spark):
    names, pairs = planted(5, groups=3, size=20)
    nodes = ids(spark, [*names, "alone1", "alone2"])
    got = {r.id: r.community for r in cluster.cluster(nodes, frame(spark, [*pairs, ("g0m00", "gone")])).collect()}
    assert set(got) == {*names, "alone1", "alone2"}
    sizes = [sum(c == k for c in got.values()) for k in range(max(got.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-2:] == [1, 1]
    hubs = {r.id for r in cluster.cluster(nodes, frame(spark, [*pairs, *[("g0m00", x) for x in names[1:]]]), hub_percentile=97).collect()}
    assert hubs == set(got)


def test_stable_ids_go_on_after_the_first_round(spark):
    old = spark.createDataFrame([(k, 0 if k < 10 else 1) for k in range(16)], "id long, community long")
    new = spark.createDataFrame([(k, 5 if k < 6 else 6 if k < 12 else 7) for k in range(16)], "id long, community long")
    got = {r.id: r.community for r in cluster.stable(new, old).collect()}
    assert {got[k] for k in range(6)} == {0} and {got[k] for k in range(6, 12)} == {2} and {got[k] for k in range(12, 16)} == {1}


def test_terms_and_contexts():
    assert question.terms("How does the Frontier cache work?") == ["frontier", "cache"]
    assert question.terms("how does it work") == ["how", "does", "work"]
    assert question.terms("知识图谱 of x1") == ["知识", "识图", "图谱", "知识图谱", "x1"]
    assert question.contexts("who calls this?") == (["call"], "heuristic")
    assert question.contexts("who calls this?", ["Params", "params", "x"]) == (["parameter_type", "x"], "explicit")
    assert question.contexts("what is it") == ([], None)


def test_question_to_text(spark):
    n = spark.createDataFrame([("a", "FrontierCache", "f.py"), ("b", "load()", "g.py"), ("c", "store()", "h.py"), ("d", "calls_log", "i.py"), ("e", "other", "j.py")], "id string, label string, source_file string")
    e = frame(spark, [("a", "b"), ("b", "c"), ("d", "e")])
    assert {r.id for r in question.seeds(n, e, "what calls the frontiercache").collect()} == {"a", "d"} or {r.id for r in question.seeds(n, e, "what calls the frontiercache").collect()} == {"a"}
    lines = [r.line for r in question.query_graph(n, e, "frontiercache", depth=2).orderBy("place").collect()]
    assert lines[0] == "NODE FrontierCache [f.py]" and "NODE store() [h.py]" in lines and "EDGE load() --x--> store()" in lines and not any("other" in x for x in lines)
    short = [r.line for r in question.query_graph(n, e, "frontiercache", depth=2, budget=1).orderBy("place").collect()]
    assert short == ["NODE FrontierCache [f.py]"]
    assert [r.id for r in question.path_text(n, e, "frontiercache", "store").orderBy("step").collect()] == ["a", "b", "c"]
    assert question.resolve_seed(n, "a") == "a" and question.resolve_seed(n, "load") == "b" and question.resolve_seed(n, "h.py") == "c" and question.resolve_seed(n, "zzz") is None
    assert question.endpoint(n, "store") == "c" and not question.unclear(n, "frontiercache")


def test_bridge_questions(spark):
    """Two cliques joined by one node, which alone is asked about; the cliques' other members have no neighbour elsewhere."""
    left, right = [f"a{k}" for k in range(4)], [f"b{k}" for k in range(4)]
    pairs = [*combinations(left, 2), *combinations(right, 2), ("m", "a0"), ("m", "b0")]
    rows = [(x, x, f"{x}.py/", 0 if x[0] == "a" else 1 if x[0] == "b" else 2) for x in [*left, *right, "m"]]
    nodes = spark.createDataFrame([(i, label, "src/f.py", c) for i, label, _, c in rows], "id string, label string, source_file string, community long")
    got = {r.about: r.n for r in C.bridge_questions(nodes, frame(spark, pairs)).collect()}
    assert got == {"m": 2, "a0": 1, "b0": 1}
    inside = nodes.withColumn("community", F.lit(7).cast("long"))
    assert C.bridge_questions(inside, frame(spark, pairs)).count() == 0


def test_cycles_end_where_there_are_enough(spark):
    """A dense graph of 10,000 nodes: its paths of five nodes are never made."""
    dense = spark.range(200_000).selectExpr("concat('f', pmod(xxhash64(id, 1), 10000)) AS src", "concat('f', pmod(xxhash64(id, 2), 10000)) AS dst")
    got = V.cycles(dense, top=20).collect()
    assert len(got) == 20 and all(r.length <= 2 for r in got)


def test_strong_components(spark):
    rnd = random.Random(7)
    pairs = {(f"n{rnd.randrange(40):02}", f"n{rnd.randrange(40):02}") for _ in range(60)} | {("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "v"), ("v", "w"), ("u", "x"), ("q", "q")}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: reach(x) for p in pairs for x in p}
    want = {}
    for x in far:
        own = {y for y in far[x] if x in far.get(y, ())} | {x}
        if len(own) > 1:
            want[x] = min(own)
    assert {r.id: r.component for r in V.strong_components(frame(spark, pairs)).collect()} == want


def test_file_graph_is_oriented_by_the_importing_file(spark):
    nodes = spark.createDataFrame([("a", "a.ts"), ("b", "b.ts"), ("c", "c.ts"), ("n", None), ("s", "a.ts")], "id string, source_file string")
    rows = [("a", "b", "imports_from", "a.ts", False), ("b", "a", "imports_from", "a.ts", False), ("c", "b", "re_exports", "c.ts", None), ("b", "c", "imports_from", "b.ts", True), ("a", "b", "calls", "a.ts", False), ("n", "c", "imports_from", "x.ts", False), ("a", "n", "imports_from", "a.ts", False), ("s", "a", "imports_from", "a.ts", False), ("a", "b", "imports_from", None, False)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, source_file string, deferred boolean")
    assert {tuple(r) for r in V.file_graph(nodes, edges).collect()} == {("a.ts", "b.ts"), ("c.ts", "b.ts"), ("x.ts", "c.ts"), ("a.ts", "a.ts")}


def test_betweenness_in_tasks_and_by_joins(spark, monkeypatch):
    """A graph of cycles, hubs, parts, loops and parallel edges, with few pivots or all: tasks that hold it give what joins of its levels give."""
    from lodestar.operators import flows as W

    rnd = random.Random(11)
    pairs = [(f"a{min(rnd.randrange(60), rnd.randrange(60)):02}", f"a{rnd.randrange(60):02}") for _ in range(150)] + [(f"b{k}", f"b{(k + 1) % 7}") for k in range(7)] + [("b0", "b0"), ("a01", "b9"), ("hub", "a03")]
    for pivots in (sorted(after(pairs, False)), ["a05", "b2", "hub", "elsewhere"]):
        got = []
        for most, block, looked in ((10**6, 4, 1), (10**6, 64, 9), (0, 4, 1)):
            monkeypatch.setattr(W, "PAIRS", most)
            monkeypatch.setattr(W, "BLOCK", block)
            monkeypatch.setattr(W, "LOOKED_UP", looked)
            n, e = V.betweenness(frame(spark, pairs), ids(spark, pivots))
            got.append(({r.id: r.score for r in n.where("score > 1e-9").collect()}, {(r.src, r.dst): r.score for r in e.collect()}))
        for nodes, ties in got[:2]:
            assert nodes and nodes == pytest.approx(got[2][0]) and ties == pytest.approx(got[2][1])


@pytest.mark.parametrize("name", ["betweenness_nodes", "betweenness_edges"])
def test_betweenness_queries_take_all_relations(spark, tmp_path, name):
    """Two orders of a customer share a part and reach a supplier: cycles over relations and nodes other than nations and regions."""
    import datetime

    import duckdb
    import pandas as pd
    from lodestar.plans import catalog

    day = datetime.datetime(2020, 1, 1)
    tables = {
        "region": {"r_regionkey": [0], "r_name": ["R"]},
        "nation": {"n_nationkey": [0, 1], "n_name": ["N", "M"], "n_regionkey": [0, 0]},
        "customer": {"c_custkey": [0, 1], "c_name": ["C", "D"], "c_nationkey": [0, 1], "c_mktsegment": ["A", "A"]},
        "supplier": {"s_suppkey": [0], "s_name": ["S"], "s_nationkey": [0]},
        "part": {"p_partkey": [0, 1], "p_name": ["P", "Q"], "p_brand": ["B", "B"], "p_size": [1, 2]},
        "orders": {"o_orderkey": [0, 1], "o_custkey": [0, 0], "o_orderstatus": ["F", "O"], "o_orderpriority": ["1", "2"], "o_orderdate": [day, day]},
        "lineitem": {"l_orderkey": [0, 1, 1], "l_partkey": [0, 0, 1], "l_suppkey": [0, 0, 0], "l_quantity": [1.0, 2.0, 3.0], "l_returnflag": ["A", "R", "N"], "l_linestatus": ["O", "O", "F"]},
    }
    con = duckdb.connect()
    for t, columns in tables.items():
        pd.DataFrame(columns).to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    pairs = [("n:0", "r:0"), ("n:1", "r:0"), ("c:0", "n:0"), ("c:1", "n:1"), ("s:0", "n:0"), ("o:0", "c:0"), ("o:1", "c:0"), ("o:0", "p:0"), ("o:1", "p:0"), ("o:1", "p:1"), ("p:0", "s:0"), ("p:1", "s:0")]
    next_ = after(pairs, False)
    far = {x: distances(x, next_) for x in next_}

    def paths(s, t):
        return [[t]] if s == t else [[s, *p] for y in sorted(next_[s]) if far[y].get(t, 99) == far[s][t] - 1 for p in paths(y, t)]

    want = {}
    for s in next_:
        for t in far[s]:
            every = paths(s, t) if s != t else []
            for p in every:
                for x in p[1:-1] if name == "betweenness_nodes" else [tuple(sorted(x)) for x in zip(p, p[1:], strict=False)]:
                    want[x] = want.get(x, 0) + 1 / len(every)
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    told = con.execute(catalog.ORACLE[name]).fetchall()
    if name == "betweenness_nodes":
        assert {r.id: r.score for r in got} == pytest.approx(want) == dict(told)
        assert {x[:1] for x in want} == set("rnspoc")
    else:
        assert {(r.src, r.dst): r.score for r in got} == pytest.approx(want)
        assert {(a, b): s for a, b, s in told} == pytest.approx(want)
