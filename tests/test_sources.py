import json

from lodestar.operators import symbols as S
from lodestar.sinks import exports
from lodestar.sources import corpus
from pyspark.sql import functions as F


def test_scan_and_changes(spark, tmp_path):
    files = {"a.py": "x = 1\n", "doc/b.md": "---\nt: 1\n---\n# Head\n[x](c.md) [[Wiki]]\n", ".env": "K=1", "node_modules/z.js": "1", "p.txt": "Abstract. We propose. arXiv [1] et al.", "q.zip": "x", ".env.example": "K="}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    got = corpus.scan(spark, f"file://{tmp_path}").cache()
    assert {r.path: r.category for r in got.collect()} == {"a.py": "code", "doc/b.md": "document", "p.txt": "paper"}
    old = corpus.manifest(got)
    new = corpus.manifest(got.where("path <> 'p.txt'").withColumn("content", F.when(F.col("path") == "a.py", "x = 2").otherwise(F.replace("content", F.lit("t: 1"), F.lit("t: 2")))))
    assert {r.path: r.change for r in corpus.changes(old, new).collect()} == {"a.py": "changed", "doc/b.md": "unchanged", "p.txt": "deleted"}
    assert {(r.dst, r.relation) for r in corpus.markdown_edges(got.where("path like '%md'")).collect()} == {("doc/b.md#Head", "contains"), ("c.md", "references"), ("Wiki", "references")}


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1, "label": "a"}, {"id": "b", "label": "b"}], "edges": [{"from": 1, "to": "b", "relation": "x"}]}))
    n, e = corpus.read_graph(spark, f"{tmp_path}/g.json")
    assert {r.id for r in n.collect()} == {"1", "b"} and [(r.src, r.dst) for r in e.collect()] == [("1", "b")]


def test_sql_source(spark):
    ddl = "CREATE TABLE a (id int); -- x\ncreate table s.b (a_id int references a(id));\ncreate view v as with c as (select 1) select * from s.b join a on 1=1 join c on true;\nALTER TABLE ONLY a ADD CONSTRAINT f FOREIGN KEY (x) REFERENCES s.b(y);\ncreate trigger t after insert on a execute function f();"
    got = {(r.kind, r.src, r.dst) for r in corpus.sql_edges(spark.createDataFrame([("x.sql", ddl), ("y.sql", None)], "path string, content string")).collect()}
    assert {("references", "s.b", "a"), ("reads_from", "v", "s.b"), ("reads_from", "v", "a"), ("references", "a", "s.b"), ("triggers", "a", "t"), ("table", "a", None), ("view", "v", None)} <= got
    assert ("reads_from", "v", "c") not in got


def test_exports(spark, tmp_path):
    n = spark.createDataFrame([("a", "A & 'b'", "code"), ("c", "a & 'B'", "document")], "id string, label string, file_type string")
    e = spark.createDataFrame([("a", "c", "calls")], "src string, dst string, relation string")
    lines = [r.line for r in exports.cypher(n, e).orderBy("part", "key").collect()]
    assert lines[0] == r"MERGE (n:Code {id: 'a'}) SET n.label = 'A & \'b\'';" and lines[2] == "MATCH (a {id: 'a'}), (b {id: 'c'}) MERGE (a)-[:CALLS]->(b);"
    import xml.dom.minidom

    exports.write(exports.graphml(n, e), f"{tmp_path}/g")
    body = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/g", wholetext=True).collect())
    assert len(xml.dom.minidom.parseString("".join(r.line for r in exports.graphml(n, e).orderBy("part", "key").collect())).getElementsByTagName("node")) == 2 and "</graphml>" in body
    assert {r.name for r in exports.notes(n, e).collect()} == {"A & 'b'", "a & 'B'-2"}
    assert json.loads(exports.graph_json(n, e).where("part = 1").first().line)["relation"] == "calls"


def test_symbols(spark):
    sym = spark.createDataFrame([("1", "f", "d/a.ts", "ts", "function", "", ""), ("2", "f", "d/b.js", "js", "function", "", ""), ("3", "g", "e/c.ts", "ts", "method", "gone", "K"), ("4", "K", "e/k.ts", "ts", "class", "", ""), ("5", "f", "z/q.py", "py", "function", "", "")], "id string, name string, file_path string, language string, kind string, parent_id string, receiver string")
    calls = spark.createDataFrame([("x", "f", "d/a.ts", "ts", False), ("y", "f", "d/n.tsx", "tsx", False), ("z", "f", "o/n.ts", "ts", False), ("w", "g", "o/n.ts", "ts", False), ("v", "g", "o/n.ts", "ts", True)], "from_id string, name string, file_path string, language string, qualified boolean")
    assert {(r.from_id, r.to_id) for r in S.resolve_calls(sym, calls).collect()} == {("x", "1"), ("y", "1"), ("w", "3")}
    assert {r.id: r.parent_id for r in S.repair_parents(sym).collect()}["3"] == "4"
    e = spark.createDataFrame([("1", "2", "calls"), ("2", "3", "calls")], "src string, dst string, relation string")
    assert {r.id: r.role for r in S.call_roles(e).collect()} == {"1": "entry", "2": "normal", "3": "leaf"}
