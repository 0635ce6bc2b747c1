"""Envelopes, life cycle, federation and the query surface."""

import json

import pytest
from lodestar import app
from lodestar.operators import envelope as EN
from lodestar.operators import federation as FE
from lodestar.operators import lifecycle as L
from lodestar.sinks import reports
from pyspark.sql import functions as F

NODE = "id string, label string, source_file string, file_type string, community long"
EDGE = "src string, dst string, relation string, confidence string, confidence_score double, weight double, context string"


@pytest.fixture
def small(spark):
    n = spark.createDataFrame([("a", "Alpha", "x/a.py", "code", 0), ("b", "beta()", "x/b.py", "code", 0), ("c", "Gamma", "y/c.py", "code", 1), ("d", "Delta", "y/d.md", "document", 1)], NODE)
    e = spark.createDataFrame([("a", "b", "calls", "EXTRACTED", 1.0, 1.0, "call"), ("b", "c", "uses", "AMBIGUOUS", 0.2, 1.0, None), ("d", "c", "references", "INFERRED", 0.5, 1.0, None)], EDGE)
    return app.Graph(n, e)


def test_envelope(spark):
    n = spark.createDataFrame([("f", "f()", "function", "f(x)", "Doc.", "f(x)", "L1"), ("g", "g()", "func-tion", None, None, None, None)], "id string, label string, kind string, signature string, doc string, description string, source_location string")
    e = spark.createDataFrame([("f", "g", "calls"), ("f", "g", "calls")], "src string, dst string, relation string")
    t = EN.envelope(n, e, "w", "s")
    got = {r.external_id: r for r in t["nodes"].collect()}
    assert got["f"].text == "f(x)\n\nDoc." and got["g"].type == "FUNC_TION" and t["chunks"].count() == t["citations"].count() == 1 and t["relationships"].count() == 1
    assert EN.content_hash(t) == EN.content_hash({k: v.repartition(3) for k, v in t.items()}) != EN.content_hash(EN.envelope(n.limit(1), e, "w", "s"))
    index = EN.index(t["chunks"], t["nodes"], "v1", 64)
    assert index.count() == 3 and EN.is_current(index, "v1", 64) and not EN.is_current(index, "v2", 64)
    with pytest.raises(ValueError, match="dimensions"):
        EN.index(t["chunks"], t["nodes"], "v1", 5000)


def test_documents_to_graph(spark):
    docs = spark.createDataFrame([(1, "Alice Smith met Bob. Alice Smith left."), (2, "bob met no one"), (3, None)], "doc_id long, text string")
    t = EN.ingest(docs, EN.capitalised)
    assert {r.entity_id for r in t["entities"].collect()} == {"alice smith", "bob"} and t["relations"].count() == 1 and t["mentions"].count() == 2 and t["chunks"].count() == 2


def test_model_answers(spark):
    assert EN.parse_json('```json\n{"a": 1}\n```') == {"a": 1} and EN.parse_json('so: {"a": 2} ok') == {"a": 2} and EN.parse_json("no") == EN.parse_json(None) == EN.parse_json("[1]") == {}

    def ask(text):
        return json.dumps({"nodes": [{"id": w} for w in text.split()]}) if len(text) < 8 else '{"nodes": [{"id"'

    got = EN.extract_corpus(spark.createDataFrame([("p", "aa bb cc dd")], "pack string, text string"), ask)
    assert {json.loads(r.payload)["id"] for r in got.collect()} == {"aa", "bb", "cc", "dd"}
    assert EN.synthesize("q", []) == "No evidence was found." and EN.synthesize("q", [{"text": "t"}], lambda q, e: 1 / 0) == "[1] t" and EN.synthesize("q", [], lambda q, e: "yes") == "yes"


def test_limits_scope_and_evidence(spark, small):
    assert EN.Limits.resolve(k=50, rows=10) == EN.Limits(20, 10) and EN.Limits.resolve() == EN.Limits(5, 50)
    known = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    assert EN.scope(known, ["s1", "s9"], " ") == (["s1"], ["empty_query", "unknown_source:s9"])
    n, e = EN.explain(spark.createDataFrame([("a",), ("b",), ("z",)], "id string"), small.nodes, small.edges)
    assert n.count() == 2 and e.count() == 1


def test_workspaces(spark, tmp_path):
    w = EN.Workspaces(str(tmp_path / "w.json"))
    w.create("main", ["s"])
    run = w.start("main", "s")
    w.move(run, "running")
    w.move(run, "failed")
    w.move(run, "queued")
    with pytest.raises(ValueError, match="can't become"):
        w.move(run, "succeeded")
    with pytest.raises(ValueError):
        w.start("main", "x")
    assert [(r.run, r.state) for r in w.runs(spark).collect()] == [("run-1", "queued")]


def test_versions(spark):
    rows = spark.createDataFrame([("s", 1), ("t", 2)], "source_id string, x int")
    one = L.activate(L.activate(L.stage_version(None, rows, "v1"), "s", "v1"), "t", "v1")
    two = L.stage_version(one, rows.withColumn("x", F.col("x") * 10), "v2")
    back = L.roll_back(two, "s", "v2")
    assert {(r.source_id, r.version, r.active) for r in back.collect()} == {("s", "v1", True), ("t", "v1", True), ("t", "v2", False)}
    on = L.activate(two, "s", "v2")
    assert {(r.source_id, r.x) for r in on.where("active").collect()} == {("s", 10), ("t", 2)}
    assert L.delete_source(rows, "s").count() == 1


def test_queue_and_cache(spark, tmp_path):
    q, done = str(tmp_path / "q"), str(tmp_path / "done")
    L.enqueue(spark, q, spark.createDataFrame([("a",), ("a",), ("b",)], "path string"))
    work = lambda batch: batch.select("path").write.mode("append").parquet(done)
    L.drain(spark, q, work, str(tmp_path / "cp"))
    L.drain(spark, q, work, str(tmp_path / "cp"))
    assert sorted(r.path for r in spark.read.parquet(done).collect()) == ["a", "b"]
    assert L.fingerprint("a \r\nb") == L.fingerprint("a\nb\n") != L.fingerprint("a b")
    f = spark.createDataFrame([("n.md", "---\nt: 1\n---\nbody"), ("x.py", "1")], "path string, content string")
    g = spark.createDataFrame([("n.md", "---\nt: 2\n---\nbody"), ("x.py", "2")], "path string, content string")
    hit, miss = L.cached(L.keyed(g, "p", "1"), L.keyed(f, "p", "1").select(*L.KEY))
    assert [r.path for r in hit.collect()] == ["n.md"] and [r.path for r in miss.collect()] == ["x.py"]
    assert L.pruned_cache(L.keyed(f, "p", "1"), L.keyed(g, "p", "1")).count() == 1


def test_fragments(spark, small):
    n, e = FE.concat([(small.nodes, small.edges), (small.nodes.limit(1).withColumn("label", F.lit("New")), small.edges)])
    assert n.where("id = 'a'").first().label == "New" and e.count() == 3 and n.count() == 4
    said = spark.createDataFrame([("r", "this cache exists because writes are slow here", None, "rationale", 0)], NODE)
    why = spark.createDataFrame([("r", "a", "rationale_for", "EXTRACTED", 1.0, 1.0, None)], EDGE)
    left, rest = FE.fold_rationales(small.nodes.unionByName(said), small.edges.unionByName(why))
    assert left.count() == 4 and left.where("id = 'a'").first().rationale.startswith("this cache") and rest.count() == 3
    two = spark.createDataFrame([("x", "f.py"), ("x", "g.py"), ("y", "g.py")], "id string, source_file string")
    links = spark.createDataFrame([("x", "y", "g.py")], "src string, dst string, source_file string")
    n, e = FE.rekey(two, links)
    assert {r.id for r in n.collect()} == {"x__f_py", "x__g_py", "y"} and e.first().src == "x__g_py"


def test_shared_graph_and_declared_links(spark, small, tmp_path):
    shared = FE.replace_repo(FE.replace_repo(None, small.nodes, "one"), small.nodes, "two")
    again = FE.replace_repo(shared, small.nodes.limit(1), "one")
    assert {r.repo: r.n for r in FE.list_repos(again).collect()} == {"one": 1, "two": 4}
    root = f"file://{tmp_path}/shared"
    assert FE.shared_graph(spark, root) is None
    assert FE.put_repo(small.nodes, small.edges, root, "one") and FE.put_repo(small.nodes, small.edges, root, "two")
    pinned, _ = FE.shared_graph(spark, root)
    files = sorted(p.name for p in (tmp_path / "shared" / "nodes").iterdir())
    assert not FE.put_repo(small.nodes.repartition(5), small.edges, root, "two")  # unchanged: nothing is written
    assert sorted(p.name for p in (tmp_path / "shared" / "nodes").iterdir()) == files
    assert FE.put_repo(small.nodes.limit(1), small.edges, root, "one")
    assert {r.repo: r.n for r in FE.list_repos(FE.shared_graph(spark, root)[0]).collect()} == {"one": 1, "two": 4}
    assert pinned.count() == 8  # a reader of the version before
    FE.drop_repo(spark, root, "one")
    assert {r.repo for r in FE.list_repos(FE.shared_graph(spark, root)[1]).collect()} == {"two"}
    spec = {"members": [{"tag": "one"}, {"tag": "two"}], "links": [{"type": "api_call", "from": {"member": "one", "label": "alpha"}, "to": {"member": "two", "id": "c"}}]}
    edges, reports_ = FE.declared(shared, spec)
    assert [(r.src, r.dst, r.relation) for r in edges.collect()] == [("one::a", "two::c", "calls_api")] and not reports_
    spec["links"][0]["to"] = {"member": "two", "label": "none"}
    with pytest.raises(ValueError, match="no node"):
        FE.declared(shared, spec)
    one = {"type": "shared_resource", "name": "orders", "kind": "topic", "referents": [{"member": "one", "label": "ALPHA"}, {"member": "two", "id": "b"}, {"member": "two", "label": "none"}]}
    edges, reports_ = FE.declared(shared, {"members": spec["members"], "links": [one]}, strict=False)
    assert [(r.src, r.dst, r.relation) for r in edges.orderBy("src").collect()] == [("one::a", "resource::topic:orders", "uses"), ("two::b", "resource::topic:orders", "uses")]
    assert reports_ == ["links[0].referents[2]: no node"] and [tuple(r) for r in FE.resources(spark, {"links": [one, one]}).collect()] == [("resource::topic:orders", "orders", "topic", "resource")]
    assert "needs a name" in FE.check_spec({"members": [{"tag": "a"}], "links": [{"type": "shared_resource"}]})[0]
    assert FE.check_spec({}) and "used twice" in FE.check_spec({"members": [{"tag": "a"}, {"tag": "a"}]})[0] and "type must" in FE.check_spec({"members": [{"tag": "a"}], "links": [{"type": "x"}]})[0]


def test_surface(small, tmp_path, spark):
    assert app.run(small, "graph_stats")[0]["n_nodes"] == 4
    assert "NODE Alpha" in app.run(small, "query_graph", question="alpha")
    status, body = app.handle(small, "GET", "/api/get_node", {"id": "Alpha"})
    assert status == 200 and body[0]["n_out"] == 1
    assert app.handle(small, "GET", "/api/nothing")[0] == 404 and app.handle(small, "GET", "/api/get_node", {"x": 1})[0] == 400 and app.handle(small, "POST", "/api/get_node")[0] == 404
    assert "result" in app.rpc(small, {"id": 1, "method": "tools/list"}) and app.rpc(small, {"id": 1, "method": "tools/call", "params": {"name": "zzz"}})["error"]["code"] == -32602
    got = app.rpc(small, {"id": 2, "method": "tools/call", "params": {"name": "shortest_path", "arguments": {"source": "alpha", "target": "gamma"}}})
    assert [r["id"] for r in json.loads(got["result"]["content"][0]["text"])] == ["a", "b", "c"]
    assert {r["id"] for r in app.run(small, "affected", id="Gamma", relations="uses,calls")} == {"a", "b"}
    chat = app.Chat(small, keep=1)
    assert chat.ask("alpha", "t")["seq"] == 1 and chat.ask("gamma", "t")["seq"] == 2 and len(chat.turns["t"]) == 1 and chat.ask(" ")["problems"] == ["empty_query"]
    chat.feedback("t", 2, True)
    assert chat.turns["t"][0]["feedback"] == "useful" and len(chat.suggestions(2)) == 2
    kinds = [x.split(b"\n")[0] for x in chat.stream("alpha", "u")]
    assert kinds[0] == b"event: run_started" and kinds[-1] == b"event: run_finished"
    assert [x.split(b"\n")[0] for x in app.events(lambda: iter("ab"), lambda: True)][-1] == b"event: run_cancelled"
    app.register_pass("p", {"py"}, lambda n, e: e.limit(0))
    assert app.run_passes(small).edges.count() == 0
    app.PASSES.clear()


def test_reports(small, spark, tmp_path):
    text = reports.report(small.nodes, small.edges)
    assert "4 nodes, 3 edges" in text and "the graph has gaps" in text
    assert "<canvas>" in reports.page(small.nodes, small.edges) and reports.svg(small.nodes, small.edges).count("<circle") == 4
    assert json.loads(reports.canvas(small.nodes, small.edges))["edges"] and "<td>" in reports.flow_page(small.nodes, small.edges)
    roll = spark.createDataFrame([("", 3), ("x", 2), ("y", 1)], "path string, total long")
    assert "(+1 more)" in reports.tree_page(roll, 1)
    lessons = spark.createDataFrame([("a", 1.5, 2, 0, "preferred")], "node string, score double, pos long, neg long, status string")
    assert "## preferred" in reports.lessons_text(lessons)
    out = str(tmp_path / "g")
    for k in range(5):
        small.nodes.write.mode("overwrite").parquet(out)
        kept = reports.back_up(spark, out, 2)
    assert len(kept) == 2 and kept[-1].endswith("000005")


def test_build_and_update(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("from b import g\ndef f():\n    g()\n")
    (root / "b.py").write_text("def g():\n    pass\n")
    g = app.build(spark, str(root))
    assert ("a.py#f", "b.py#g", "calls") in {(r.src, r.dst, r.relation) for r in g.edges.collect()} and g.nodes.where("community is null").count() == 0
    g.write(str(tmp_path / "g"))
    kept = app.Graph.read(spark, str(tmp_path / "g"))
    (root / "b.py").unlink()
    new, changed = app.update(kept, spark, str(root), ["b.py"])
    assert changed and {r.id for r in new.nodes.collect()} == {"a.py", "a.py#f"}


def test_plug_ins(spark, small):
    from lodestar.operators import community as C
    from lodestar.operators import symbols as S
    from lodestar.operators import upkeep as U
    from lodestar.operators import vectors

    hubs = {r.community: r.label for r in C.named(small.nodes, small.edges).collect()}
    assert hubs == {0: "beta", 1: "Gamma"}
    assert {r.community: r.label for r in C.named(small.nodes, small.edges, lambda lists: [x[0].upper() for x in lists]).collect()} == {0: "BETA()", 1: "GAMMA"}
    assert {r.community: r.label for r in C.named(small.nodes, small.edges, lambda lists: 1 / 0).collect()} == hubs
    fine, broken = vectors.remote(lambda texts: [[1.0, float(len(t))] for t in texts], 2), vectors.remote(lambda texts: 1 / 0, 2)
    docs = spark.createDataFrame([("abc",), (None,)], "text string")
    assert sorted(r.v for r in docs.select(fine("text").alias("v")).collect()) == [[1.0, 0.0], [1.0, 3.0]]
    assert [r.v for r in docs.select(broken("text").alias("v")).collect()] == [[0.0, 0.0]] * 2
    with pytest.raises(ValueError, match="no backend"):
        EN.ask_model("hi", "none")
    EN.BACKENDS["echo"] = lambda prompt, most: prompt[:most]
    assert EN.ask_model("hello", "echo", 2) == "he"
    scored = spark.createDataFrame([("b", "c", 2.0), ("d", "c", 1.0)], "src string, dst string, score double")
    assert U.diagram_nodes(small.nodes, small.edges, scored, 3) == ["a", "b", "c"]
    sym = spark.createDataFrame([("s2",), ("s1",)], "id string")
    links = spark.createDataFrame([("s2", "s1", "calls")], "source string, target string, kind string")
    assert [r.id for r in S.full_graph(sym, links)[0].collect()] == ["s1", "s2"]


def test_what_is_left_out_is_told(spark, monkeypatch):
    assert app._rows(spark.range(5), 3)[-1] == {"left_out": 2} and len(app._rows(spark.range(3), 3)) == 3
    monkeypatch.setattr(reports, "FOLDERS", 2)
    tree = spark.createDataFrame([("", 9), ("a", 6), ("b", 3), ("a/c", 6)], "path string, total long")
    page = reports.tree_page(tree)
    assert "2 folders further down are left out" in page and "a (6)" in page and "c (6)" not in page
