"""Source code, manifests and documents read as rows."""

import io
import json
import uuid
import zipfile
import zlib

import pytest
from lodestar.sources import extract as X
from lodestar.sources import manifests as M
from pyspark.sql import functions as F


def files(spark, pairs):
    return spark.createDataFrame(list(pairs), "path string, content string")


PY = '''"""Module."""
import os
from .store import Store
class Base:
    def save(self):
        pass
class Child(Base):
    """A child."""
    def run(self):
        s = Store()
        s.put(1)  # NOTE: must come first
        helper()
def helper():
    return os.getcwd()
'''
STORE = "class Store:\n    def put(self, x):\n        return x\n"


def test_python():
    rows = X.python_rows(PY)
    assert ("symbol", "method", "run", "Child", None, 9) in rows and ("symbol", "function", "helper", None, None, 13) in rows
    assert ("inherits", "inherits", "Base", "Child", None, 7) in rows and ("import", "imports_from", ".store:Store", None, None, 3) in rows
    assert ("call", "calls", "put", "run", "s", 11) in rows and ("typed", "variable", "s", "run", "Store", 10) in rows
    assert ("rationale", "note", "must come first", None, None, 11) in rows and ("rationale", "docstring", "A child.", "Child", None, 7) in rows
    assert X.python_rows("def (") == []


SAMPLES = {
    "a.ts": ("import {x} from './b';\nexport class Foo extends Bar {\n  run(a: number): void { helper(a) }\n}\nfunction helper(a) { return 1 }\n// class Not {}\n", {"Foo", "run", "helper"}, {"./b"}, {"helper"}),
    "A.java": ("import java.util.List;\npublic class A extends B {\n    public int size(List x) { return count(x); }\n    private int count(List x) { return 0; }\n}\n", {"A", "size", "count"}, {"java.util.List"}, {"count"}),
    "a.go": ('package a\nimport "fmt"\ntype T struct {}\nfunc (t *T) Run() {\n\thelper()\n}\nfunc helper() { fmt.Println("func no()") }\n', {"T", "Run", "helper"}, {"fmt"}, {"helper"}),
    "a.rs": ("use std::io;\nstruct S {}\nimpl Display for S { fn fmt(&self) { go() } }\nfn go() {}\n", {"S", "fmt", "go"}, {"std::io"}, {"go"}),
    "a.c": ('#include "b.h"\nstatic int add(int a) {\n  return sub(a);\n}\nint sub(int a) { return a; }\n', {"add", "sub"}, {"b.h"}, {"sub"}),
    "a.rb": ("require 'json'\nclass Foo < Bar\n  def go\n    stop(1)\n  end\nend\n", {"Foo", "go"}, {"json"}, {"stop"}),
    "A.cs": ("using System;\nclass A : B {\n    public void Go() { Stop(1); }\n}\n", {"A", "Go"}, {"System"}, {"Stop"}),
    "a.kt": ("import a.b.C\nclass A : B() {\n  fun go() { stop(1) }\n}\n", {"A", "go"}, {"a.b.C"}, {"stop"}),
    "a.php": ("<?php\nuse A\\B;\nclass C extends D {\n  function go() { stop(1); }\n}\n", {"C", "go"}, {"A\\B"}, {"stop"}),
    "a.swift": ("import Foundation\nclass A: B {\n  func go() { stop(1) }\n}\n", {"A", "go"}, {"Foundation"}, {"stop"}),
    "a.lua": ('local m = require("x.y")\nfunction M.go()\n  stop(1)\nend\n', {"go"}, {"x.y"}, {"stop"}),
    "a.sh": ("source ./lib.sh\nmain() {\n  setup\n}\nsetup() {\n  echo hi\n}\n", {"main", "setup"}, {"./lib.sh"}, {"setup"}),
    "a.ps1": ("Import-Module Tools\nfunction Get-It {\n  Set-It 1\n}\n", {"Get-It"}, {"Tools"}, {"Set-It"}),
    "a.ex": ("defmodule A.B do\n  alias C.D\n  def go(x) do\n    stop(x)\n  end\nend\n", {"A.B", "go"}, {"C.D"}, {"stop"}),
    "a.jl": ("using Foo\nfunction go(x)\n  stop(x)\nend\n", {"go"}, {"Foo"}, {"stop"}),
    "a.scala": ("import a.B\nclass A extends C {\n  def go() = { stop(1) }\n}\n", {"A", "go"}, {"a.B"}, {"stop"}),
    "a.zig": ('const std = @import("std");\nfn go() void {\n  stop(1);\n}\n', {"go"}, {"std"}, {"stop"}),
    "a.dart": ("import 'b.dart';\nclass A extends B {\n  void go(int x) { stop(x); }\n}\n", {"A", "go"}, {"b.dart"}, {"stop"}),
    "a.lisp": ("(defun go (x)\n  (stop x))\n", {"go"}, set(), {"stop"}),
    "a.ml": ("open List\nlet go x = List.map x\n", {"go"}, {"List"}, {"map"}),
    "a.f90": ("subroutine go(x)\n  use utils\n  call stop_it(x)\nend subroutine\n", {"go"}, {"utils"}, {"stop_it"}),
    "a.sv": ('`include "x.svh"\nmodule top(input a);\n  child u1(a);\nendmodule\n', {"top"}, {"x.svh"}, {"child"}),
    "a.pas": ("unit a;\nuses SysUtils, Classes;\ntype TFoo = class(TBar)\nend;\nprocedure TFoo.Go;\nbegin\n  Stop(1);\nend;\n", {"TFoo", "TFoo.Go"}, {"SysUtils", "Classes"}, {"Stop"}),
    "a.tf": ('module "net" {\n  source = "./net"\n}\nresource "x" "y" {\n  id = module.net\n}\n', {"net", "y"}, {"./net"}, {"net"}),
    "a.csproj": ('<Project><ItemGroup><PackageReference Include="N.J" Version="1"/></ItemGroup></Project>', set(), {"N.J"}, set()),
    "a.blade.php": ("@extends('layouts.app')\n@include('parts.nav')\n", set(), {"layouts.app", "parts.nav"}, set()),
    "a.vue": ("<template><MyCard/></template>\n<script>\nimport MyCard from './MyCard.vue'\nfunction go() { stop(1) }\n</script>\n", {"go"}, {"./MyCard.vue"}, {"stop"}),
    "package.json": ('{"dependencies": {"left": "1"}, "extends": "base"}', {"dependencies", "extends"}, {"left"}, set()),
    "a.dm": ('#include "b.dm"\n/obj/item\n/obj/item/proc/go(x)\n\tstop(x)\n', {"/obj/item", "go"}, {"b.dm"}, {"stop"}),
    "a.m": ('#import "A.h"\n@interface A : B\n- (void)go;\n@end\n', {"A", "go"}, {"A.h"}, set()),
    "a.cls": ("public class A {\n  public void go(Integer x) { insert acc; for (Account a : [SELECT Id FROM Account]) {} }\n}\n", {"A", "go"}, set(), set()),
    "tool": ("#!/usr/bin/env bash\ngo() {\n  :\n}\n", {"go"}, set(), set()),
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_languages(name):
    text, symbols, imports, calls = SAMPLES[name]
    rows = X.parser_of(name, text)[1](text)
    assert symbols <= {r[2] for r in rows if r[0] == "symbol"}, rows
    assert {r[2] for r in rows if r[0] == "import"} == imports, rows
    assert calls <= {r[2] for r in rows if r[0] == "call"}, rows
    assert not {"Not", "no"} & {r[2] for r in rows if r[0] == "symbol"}


def test_headers_and_unknown():
    assert X.parser_of("a.h", "@interface A : B\n@end")[0] == "objc" and X.parser_of("a.h", "int x;")[0] == "c"
    assert X.parser_of("a.xyz", "") is None and X.parser_of("LICENSE", "text") is None


def test_resolution(spark):
    src = files(spark, [
        ("app/main.py", PY),
        ("app/store.py", STORE),
        ("web/index.ts", "export * from './util';\n"),
        ("web/util.ts", "export function shared(a) { return a }\n"),
        ("web/page.ts", "import {shared} from './web';\nfunction page(a) { shared(a) }\n"),
        ("sh/a.sh", "source ./lib.sh\nmain() {\n  setup\n  lonely\n}\n"),
        ("sh/lib.sh", "setup() {\n  :\n}\n"),
        ("sh/other.sh", "lonely() {\n  :\n}\n"),
        ("broken.py", "def ("),
        ("none.py", None),
    ])
    rows = X.extract(src)
    calls = {(r.src.split("#")[1], r.dst) for r in X.resolve_calls(rows).collect()}
    assert ("Child.run", "app/store.py#Store.put") in calls and ("Child.run", "app/main.py#helper") in calls
    assert ("page", "web/util.ts#shared") in calls and ("main", "sh/lib.sh#setup") in calls
    assert not any(d.endswith("#lonely") for _, d in calls)
    assert {(r.src, r.dst) for r in X.resolve_types(rows).collect()} == {("app/main.py#Child", "app/main.py#Base")}
    nodes, edges = X.graph_of(src)
    got = {(r.src, r.dst, r.relation) for r in edges.collect()}
    assert ("app/main.py", "app/store.py", "imports_from") in got and ("app/store.py#Store", "app/store.py#Store.put", "method") in got and ("web/index.ts", "web/util.ts", "re_exports") in got
    assert {"app/main.py", "app/main.py#Child"} <= {r.id for r in nodes.collect()}


def test_index_reads_only_what_changed(spark):
    a = files(spark, [("a.py", "def f(): pass\n"), ("b.py", "def g(): pass\n")])
    rows, _ = X.index(a)
    b = files(spark, [("a.py", "def f(): pass\n"), ("c.py", "def h(): pass\n")])
    again, hashes = X.index(b, rows)
    assert {r.name for r in again.collect()} == {"f", "h"} and hashes.count() == 2


def test_scip(spark):
    doc = {"documents": [
        {"relative_path": "a.py", "language": "python", "symbols": [{"symbol": "pkg#A", "kind": "class", "documentation": ["Doc"], "occurrences": [{"range": [4, 0]}], "relationships": [{"symbol": "pkg#B", "is_implementation": True}, {"symbol": "pkg#Two", "is_definition": "false"}, {"symbol": "out#X", "is_type_definition": True}]}, {"symbol": ""}]},
        {"relative_path": "b.py", "symbols": [{"symbol": "pkg#B", "display_name": "Bee"}, {"symbol": "pkg#Two"}]},
        {"relative_path": "c.py", "symbols": [{"symbol": "pkg#Two"}]},
    ]}
    nodes, edges = M.scip(files(spark, [("x.json", json.dumps(doc)), ("bad.json", "[1")]))
    got = {r.id: (r.label, r.kind, r.line) for r in nodes.collect()}
    assert got["scip:a.py:pkg#A"] == ("A", "class", 4) and got["scip:b.py:pkg#B"][0] == "Bee" and got["scip:a.py:out#X"][1] == "external" and got["scip:a.py:pkg#Two"][1] == "external"
    assert {(r.dst, r.relation) for r in edges.collect()} == {("scip:b.py:pkg#B", "scip_impl"), ("scip:a.py:pkg#Two", "scip_ref"), ("scip:a.py:out#X", "scip_typed")}


def test_packages_and_workspaces(spark):
    src = files(spark, [
        ("p/pyproject.toml", '[project]\nname = "My.Pkg"\nversion = "1"\ndependencies = ["requests>=2", "my.pkg", "Foo_Bar[x]; python_version<\'3\'"]\n'),
        ("go.mod", "module example.org/m\nrequire (\n\tgithub.com/a/b v1.0.0\n)\nrequire github.com/c/d v2.0.0\n"),
        ("pom.xml", '<project xmlns="http://x"><groupId>g</groupId><artifactId>a</artifactId><version>1</version><dependencies><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency></dependencies></project>'),
        ("apm.yml", "name: tool\nversion: 3\ndependencies:\n  - one\n  - two:x\n"),
        ("bad/Cargo.toml", "[package\n"),
    ])
    found = {r.name: (r.ecosystem, r.dependencies) for r in M.packages(src).collect()}
    assert found == {"My.Pkg": ("python", ["requests", "my.pkg", "Foo_Bar"]), "example.org/m": ("go", ["github.com/a/b", "github.com/c/d"]), "g:a": ("maven", ["h:b"]), "tool": ("apm", ["one", "two"])}
    nodes, edges = M.package_graph(M.packages(src))
    mine = {r.label: r for r in nodes.collect()}["My.Pkg"]
    assert mine.package_key == "python:my-pkg" and mine.dependency_keys == ["python:requests", "python:foo-bar"]
    assert ("pkg:my_pkg", "pkg:my_pkg") not in {(r.src, r.dst) for r in edges.collect()}
    cargo = files(spark, [("Cargo.toml", '[workspace]\nmembers = ["crates/*"]\n'), ("crates/a/Cargo.toml", '[package]\nname = "a"\n[dependencies]\ndb = { path = "../b", package = "b" }\nserde = "1"\n'), ("crates/b/Cargo.toml", '[package]\nname = "b"\n'), ("other/c/Cargo.toml", '[package]\nname = "c"\n')])
    nodes, edges = M.workspace(cargo)
    assert {r.label for r in nodes.collect()} == {"a", "b"} and [(r.src, r.dst) for r in edges.collect()] == [("crate:a", "crate:b")]
    one = spark.createDataFrame([(" pkg[extra]==1",)], "s string").select(M.requirement_name(F.col("s"))).first()[0]
    assert one == "pkg"


def test_server_configurations(spark):
    doc = {"mcpServers": {"fs": {"command": "npx", "args": ["-y", "@org/server@1.2", "/secret/path"], "env": {"API_KEY": "sk-value"}}, "": {"command": "x"}}}
    nodes, edges = M.mcp(files(spark, [("a/.mcp.json", json.dumps(doc)), ("b/mcp.json", json.dumps({"mcp": {"servers": {"fs": {"command": "npx"}}}})), ("c/other.json", json.dumps(doc))]))
    got = {(r.id, r.kind) for r in nodes.collect()}
    assert ("env_var:API_KEY", "env_var") in got and ("mcp_package:@org/server", "mcp_package") in got and ("mcp_command:npx", "mcp_command") in got
    assert not any("sk-value" in i or "secret" in i for i, _ in got)
    assert ("a/.mcp.json#fs", "env_var:API_KEY", "requires_env") in {(r.src, r.dst, r.relation) for r in edges.collect()}


def test_catalog(spark):
    catalog = {
        "tables": spark.createDataFrame([("public", "orders", "BASE TABLE"), ("public", "users", "BASE TABLE"), ("public", "v", "VIEW")], "table_schema string, table_name string, table_type string"),
        "keys": spark.createDataFrame([("public", "orders", "public", "users")], "table_schema string, table_name string, to_schema string, to_table string"),
        "views": spark.createDataFrame([("public", "v", 'SELECT * FROM orders JOIN public."users" ON true')], "table_schema string, table_name string, view_definition string"),
        "routines": spark.createDataFrame([("public", "f", "select 1 from users")], "routine_schema string, routine_name string, routine_definition string"),
    }
    nodes, edges = M.catalog_graph(catalog)
    assert {(r.id, r.kind) for r in nodes.collect()} == {("public.orders", "table"), ("public.users", "table"), ("public.v", "view"), ("public.f", "function")}
    assert {(r.src, r.dst, r.relation) for r in edges.collect()} == {("public.orders", "public.users", "references"), ("public.v", "public.orders", "reads_from"), ("public.v", "public.users", "reads_from"), ("public.f", "public.users", "reads_from")}


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'})
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xlsx = archive({
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>name</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{m}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>',
    })
    body = zlib.compress(b"BT (Hello \\(you\\)) Tj [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj"
    df = spark.createDataFrame([("a.docx", bytearray(docx)), ("b.xlsx", bytearray(xlsx)), ("c.pdf", bytearray(pdf)), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    got = {r.path: r.text for r in M.office_text(df).collect()}
    assert got == {"a.docx": "## Title\nSome text", "b.xlsx": "## S1\n| name | 7 |", "c.pdf": "Hello (you)\nworld", "bad.docx": None}
    assert {(r.src, r.dst, r.kind) for r in M.xlsx_structure(df).collect()} == {("b.xlsx", "b.xlsx#S1", "sheet"), ("b.xlsx#S1", "b.xlsx#S1.name", "column"), ("b.xlsx#S1", "b.xlsx#S1.7", "column")}


def test_ignore_rules(spark):
    rules = M.ignore_rules("# comment\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/draft.md\n!build/x.py\nfile[0-9].c\n") + M.ignore_rules("*.tmp\n", "sub")
    want = {"a.log": True, "x/a.log": True, "keep.log": False, "build/x.py": True, "x/build/y": True, "build": False, "top.txt": True, "x/top.txt": False, "docs/draft.md": True, "docs/a/b/draft.md": True, "sub/a.tmp": True, "a.tmp": False, "file3.c": True, "filex.c": False}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.i for r in df.select("path", M.is_ignored(F.col("path"), rules).alias("i")).collect()} == want


def test_ignore_rules_as_a_table(spark):
    """The same decisions as rule by rule, however many folders have rules of their own."""
    text = "# comment\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/draft.md\n!build/x.py\nfile[0-9].c\n"
    rules = M.ignore_rules(text) + M.ignore_rules("*.tmp\n!a.log\n", "sub")
    paths = ["a.log", "x/a.log", "keep.log", "build/x.py", "x/build/y", "build", "top.txt", "x/top.txt", "docs/draft.md", "docs/a/b/draft.md", "sub/a.tmp", "sub/a.log", "sub/b.log", "a.tmp", "file3.c", "filex.c"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    table = M.rules_of(spark.createDataFrame([(".gitignore", text), ("sub/.gitignore", "*.tmp\n!a.log\n"), ("none/.gitignore", None)], "path string, text string"))
    want = {r.path for r in df.where(M.is_ignored(F.col("path"), rules)).collect()}
    assert {r.path for r in M.ignored(df, table).collect()} == want and "sub/a.log" not in want


def test_many_folders_with_rules(spark):
    """100,000 files in 10,000 folders, each with an ignore file: a plan of constant size."""
    files = spark.range(100_000).selectExpr("concat('d', id % 10000, '/f', id, '.py') AS path")
    rules = M.rules_of(spark.range(10_000).selectExpr("concat('d', id, '/.gitignore') AS path", "concat('f', id, '.py') AS text"))
    got = M.ignored(files, rules)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert got.count() == 10_000


def test_calls_are_resolved_from_one_pass_over_the_files(spark, tmp_path):
    """What parses files is run once for all that resolution needs of it, and a call finds what its file sees among equal names."""
    files = [("src/a/m.py", "from b.m import go\ndef top():\n    go()\n    own()\ndef own():\n    pass"), ("src/b/m.py", "def go():\n    pass"), ("src/c/m.py", "def go():\n    pass\ndef other():\n    go()")]

    def noted(parts):
        for pdf in parts:
            for path in pdf["path"]:
                (tmp_path / uuid.uuid4().hex).write_text(path)
            yield pdf

    df = spark.createDataFrame(files, "path string, content string").repartition(3, "path").mapInPandas(noted, "path string, content string")
    got = {(r.src, r.dst, r.tier) for r in X.resolve_calls(X.extract(df)).collect()}
    assert got == {("src/a/m.py#top", "src/b/m.py#go", 2), ("src/a/m.py#top", "src/a/m.py#own", 1), ("src/c/m.py#other", "src/c/m.py#go", 1)}
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == [p for p, _ in files]
