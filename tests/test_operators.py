"""Operators on the reference-style edge cases: self-loops, reversed twins, dangling ends, isolated nodes, empty tables."""

import datetime
import random

from lodestar.functions import text as X
from lodestar.operators import community as C
from lodestar.operators import documents as D
from lodestar.operators import entity as E
from lodestar.operators import graph as G
from lodestar.operators import retrieval as R
from lodestar.operators import traverse as V
from lodestar.streaming import debounce
from pyspark.sql import functions as F


def edges(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "src string, dst string, relation string, weight double")


def test_degree_counts_loops_twice(spark):
    got = {r.id: r.degree for r in G.degree(edges(spark, [("a", "a", "x"), ("a", "b", "x"), ("b", "a", "x")])).collect()}
    assert got == {"a": 4, "b": 2}


def test_collapse_keeps_specific(spark):
    e = edges(spark, [("a", "b", "calls"), ("a", "b", "uses"), ("b", "a", "references"), ("c", "d", "mentions"), ("c", "d", "uses")])
    got = {(r.a, r.b): (r.relation, r.parallel_count) for r in G.collapse(e).collect()}
    assert got == {("a", "b"): ("calls", 3), ("c", "d"): ("uses", 2)}
    assert G.collapse(e, directed=True).count() == 3


def test_endpoint_resolution_needs_unique_alias(spark):
    n = spark.createDataFrame([("a b",), ("A-B",), ("c",)], "id string")
    e = edges(spark, [("c", "a b", "x"), ("C", "c", "x"), ("c", "a_b", "x")])
    assert {(r.src, r.dst) for r in G.resolve_endpoints(n, e).collect()} == {("c", "a b"), ("c", "c")}


def test_traversal(spark):
    e = edges(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x"), ("e", "f", "x"), ("f", "f", "x")])
    seed = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in V.bfs(e, seed, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.cycle for r in V.cycles(e).collect()} == {"a>b>c", "f"}
    assert {r.id: r.component for r in V.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    assert V.path_length(e, seed, "d").first().depth == 3
    assert V.path_length(e, seed, "f").count() == 0
    assert {r.id for r in V.affected(e, spark.createDataFrame([("d",)], "id string"), ["x"]).collect()} == {"c", "b"}
    none = edges(spark, [("a", "b", "x")]).limit(0)
    assert V.components(none).count() == 0 and V.cycles(none).count() == 0


def test_hub_is_reached_but_not_expanded(spark):
    e = edges(spark, [("a", "h", "x"), ("h", "z", "x")] + [("h", f"n{i}", "x") for i in range(60)])
    seed = spark.createDataFrame([("a",)], "id string")
    assert {r.id for r in V.bfs(e, seed, 3, hub=50).collect()} == {"a", "h"}
    assert V.bfs(e, seed, 3).count() == 63


def test_text(spark):
    r = spark.createDataFrame([("Foo_Bar  baz!", "aab")], "a string, b string").select(X.norm_label(F.col("a")).alias("n"), X.entropy(F.col("b")).alias("h"), X.shingles(F.lit("ab")).alias("s"), X.tokens(F.col("a")).alias("t")).first()
    assert r.n == "foo bar baz" and abs(r.h - 0.9182958) < 1e-6 and r.s == ["ab"] and r.t == ["foo", "bar", "baz"]


def test_jaro_winkler_known_values():
    assert abs(E.winkler("martha", "marhta") - 0.961111) < 1e-6
    assert abs(E.winkler("dwayne", "duane") - 0.84) < 1e-6
    assert E.winkler("abc", "xyz") == 0.0


def test_chunks_overlap_and_cover(spark):
    rnd = random.Random(2)
    texts = ["word " * 1000, "x" * 725, "", "  \n", None, " " * 30 + "a b" + " " * 300 + "c" * 90 + " d" * 200, "".join(rnd.choice("ab  é\n") for _ in range(3000)), "a" * 200, "a" * 199 + " b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in D.chunk(docs, 200, 20).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.start, r.end, r.chunk))
    blank = " \t\n\x0b\x0c\r"
    for i, t in enumerate(texts):
        body, want, at = (t or "").strip(blank), [], 0
        while at < len(body):  # the rule read literally
            stop = min(at + 200, len(body))
            cut = max((k for k in range(at + 1, stop + 1) if body[k : k + 1] == " "), default=-1) if stop < len(body) else -1
            end = cut if cut > at + 20 else stop
            if piece := body[at:end].strip(blank):
                want.append((len(want), at, end, piece))
            if end >= len(body):
                break
            at = max(end - 20, at + 1)
            while at < len(body) and body[at] in blank:
                at += 1
        assert sorted(got.get(i, [])) == want, i


def test_pack(spark):
    rnd = random.Random(4)
    files = [(f"d{rnd.randrange(3)}/{k:03}", rnd.randint(1, 900), rnd.random() < 0.2) for k in range(120)]
    got = {r.path: (r.directory, r.pack) for r in D.pack(spark.createDataFrame(files, "path string, tokens long, is_image boolean"), 1000, 2).collect()}
    packs = {}
    for path, tokens, image in files:
        packs.setdefault(got[path], []).append((path, tokens, image))
    assert len(got) == len(files)
    for (folder, k), own in packs.items():
        assert all(p.startswith(folder) for p, _, _ in own) and (sum(t for _, t, _ in own) <= 1000 or len(own) == 1) and sum(i for _, _, i in own) <= 2
        if (folder, k + 1) in packs:  # the next file did not fit
            _, t, i = min(packs[folder, k + 1])
            assert sum(x for _, x, _ in own) + t > 1000 or sum(x for _, _, x in own) + i > 2


def test_cohesion_of_single_and_pair(spark):
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, community long")
    got = {r.community: r.cohesion for r in C.cohesion(n, edges(spark, [("a", "b", "x"), ("b", "a", "x"), ("a", "a", "x")])).collect()}
    assert got == {1: 1.0, 2: 1.0}


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "k long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "k long, score double")
    assert [r.k for r in R.fuse([a, b], "k").collect()] == [2, 1, 3]


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(u, t0 + datetime.timedelta(seconds=s)) for u in (1, 2) for s in (0, 1, 2, 10, 11, 30 * u)] + [(3, t0 + datetime.timedelta(days=9))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    debounce.watch(spark, f"{tmp_path}/in", df.schema, "3 seconds", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.user_id, r.first_ts, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.user_id, r.first_ts, r.n) for r in debounce.batch_sessions(df, 3).where("user_id < 3").collect()}
    assert want and want <= got


def test_query_guard():
    from lodestar.operators.rag import guard

    good = "MATCH (n {workspace_id: $workspace_id}) RETURN n.text LIMIT $limit"
    assert guard(good) is None
    assert guard(good.replace("RETURN", "SET n.x = 1 RETURN")).startswith("not read-only")
    assert guard(good + "; MATCH (m) RETURN m") == "several statements"
    assert guard("MATCH (n) RETURN n LIMIT $limit") == "no workspace"
    assert guard(good.replace(" LIMIT $limit", "")) == "no limit"
    assert guard(good.replace("n.text", "'please delete; this'")) is None


def test_externals_make_no_new_loops(spark):
    from lodestar.operators.rag import collapse_externals

    n = spark.createDataFrame([("a", "L", ""), ("b", "L", None), ("c", "M", "f.py")], "id string, label string, source_file string")
    e = edges(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "c", "x")])
    left, moved = collapse_externals(n, e)
    assert {r.id for r in left.collect()} == {"a", "c"} and {(r.src, r.dst) for r in moved.collect()} == {("a", "c"), ("c", "c")}


def test_label_propagation_and_modularity(spark):
    clique = [(a, b, "x") for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]]
    got = {r.id: r.community for r in C.propagate(edges(spark, [*clique, ("d", "w", "x")])).collect()}
    assert len({got[i] for i in "abcd"}) == 1 and len({got[i] for i in "wxyz"}) == 1 and got["a"] != got["z"]
    n = spark.createDataFrame([(i, 1 if i in "abcd" else 2) for i in "abcdwxyz"], "id string, community long")
    q = sum(r.q for r in C.modularity(n, edges(spark, [*clique, ("d", "w", "x")])).collect())
    assert abs(q - (12 / 13 - 0.5)) < 1e-6


def test_search_is_blind_to_accents(spark):
    nodes = spark.createDataFrame([("a", "Café()", "a.py"), ("b", "cafe\u0301 noir", "b.py"), ("c", "CAFE", "c.py"), ("d", "ｃａｆｅ", "d.py"), ("e", "coffee", "e.py"), ("f", "강남 한글", "f.py")], "id string, label string, source_file string")
    for query in ("cafe", "CAFÉ", "cafe\u0301"):
        assert {r.id for r in R.score(nodes, {query: 1.0}).collect()} == {"a", "b", "c", "d"}
        assert {r.id: r.tier for r in R.tiers(nodes, query).collect()} == {"a": 2, "b": 2, "c": 1, "d": 1}
    assert [r.id for r in R.score(nodes, {"한글": 1.0}).collect()] == ["f"]
    texts = ["Été à Zürich", "Kelvin K Å ﬁ", "İstanbul ΣΑΣ", "naïve Ångström", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.folded(F.col("t"))).collect()] == [X.fold(t) for t in texts]
    assert {r.term for r in R.document_frequency(df, "t", ["ete", "zürich"]).collect()} == {"ete", "zurich"}


def test_impact_starts_from_members_and_tells_how(spark):
    rows = [("svc", "svc.call", "method", "svc.py", "L3"), ("job", "svc.call", "calls", "job.py", "L9"), ("job", "svc.call", "imports", "job.py", "L1"), ("job", "svc.call", "calls", "job.py", "L4"), ("cli", "job", "calls", "cli.py", None), ("far", "cli", "calls", "far.py", "L1"), ("svc.call", "job", "calls", "svc.py", "L5"), ("x", "svc", "mentions", "x.py", "L1")]
    e = spark.createDataFrame(rows, "src string, dst string, relation string, source_file string, source_location string")
    got = {r.id: (r.depth, r.via, r.relation, r.relations, r.file, r.place) for r in V.affected(e, spark.createDataFrame([("svc",)], "id string"), ["calls", "imports"]).collect()}
    assert got == {"job": (1, "svc.call", "calls", ["calls", "imports"], "job.py", "L4"), "cli": (2, "job", "calls", ["calls"], "cli.py", None)}
    assert V.affected(e.drop("source_file", "source_location"), spark.createDataFrame([("none",)], "id string"), ["calls"]).count() == 0


def test_shared_types_in_chunks(spark, monkeypatch):
    """Lists of a few give the pairs that comparing all with all gives: equal rows, one id in two repos and nulls too."""
    monkeypatch.setattr(G, "LISTED", 3)
    rows = [(f"i{k:02}", f"n{k % 2}", f"l{k % 3 // 2}", f"r{k % 4 // 2}") for k in range(40)] + [("i01", "n1", "l0", "r1"), ("i03", "n1", "l0", "r1"), (None, "n1", "l0", "r0"), ("x", None, "l0", "r0"), ("y", "n0", "l0", None)]
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in a and None not in b and a[1:3] == b[1:3] and a[0] < b[0] and a[3] != b[3])
    assert sorted(map(tuple, G.shared_types(spark.createDataFrame(rows, "id string, namespace string, label string, repo string")).collect())) == want


def test_label_propagation_by_rows_and_by_joins(spark, monkeypatch):
    """Loops, parallel edges in both directions, nulls and ids that order as text: rows of neighbours give what joins give, and rows of few pairs too."""
    import random

    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(70)}", f"n{min(rnd.randrange(70), rnd.randrange(70))}", "x") for _ in range(260)] + [("é", "n7", "x"), ("n7", "é", "y"), ("n9", "n9", "x"), ("alone", "alone", "x"), (None, "n1", "x"), ("n1", None, "x")]
    got = []
    for most, block in ((10**6, 10**6), (10**6, 7), (0, 7)):
        monkeypatch.setattr(C, "NODES", most)
        monkeypatch.setattr(C, "BLOCK", block)
        got.append(sorted(map(tuple, C.propagate(edges(spark, rows)).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == len({a for a, *_ in rows if a not in (None, "alone")} | {b for _, b, _ in rows if b not in (None, "alone")})
    made, settle = [], C.settle
    monkeypatch.setattr(C, "NODES", 10**6)
    monkeypatch.setattr(C, "settle", lambda df: made.append(df) or settle(df))
    C.propagate(edges(spark, rows))
    assert len(made) <= 4  # 7 when each round was settled
