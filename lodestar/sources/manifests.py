"""Structured sources: symbol indexes, package manifests, workspaces, server configurations, database catalogs, Office and PDF files."""

from __future__ import annotations

import fnmatch
import io
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- symbol indexes (SCIP as JSON)

_REL = "array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>"
_SYMBOL = f"array<struct<symbol:string,kind:string,display_name:string,documentation:array<string>,relationships:{_REL},occurrences:array<struct<range:array<int>>>>>"
SCIP = f"documents array<struct<relative_path:string,language:string,symbols:{_SYMBOL}>>"


def _scip_id(path: Column, symbol: Column) -> Column:
    return F.concat(F.lit("scip:"), path, F.lit(":"), symbol)


def scip(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, label, kind, source_file, line, description``) and edges (``src, dst, relation, source_file, line``) of index files (``content``).

    A relationship's target is the symbol of that name in the same document, else the only one anywhere, else an external stub. Flags count
    only as literal true: implementation before type before definition, else a plain reference.
    """
    docs = files.select(F.explode(F.from_json("content", SCIP)["documents"]).alias("d")).select(F.coalesce("d.relative_path", F.lit("")).alias("path"), F.explode("d.symbols").alias("s")).where("s.symbol <> ''")
    line = F.get(F.get("s.occurrences", F.lit(0))["range"], F.lit(0))
    tail = F.element_at(F.split("s.symbol", "#"), -1)
    label = F.coalesce(*[F.when(x != "", x) for x in (F.col("s.display_name"), tail)], F.col("s.symbol"))
    own = docs.select("path", F.col("s.symbol").alias("symbol"), label.alias("label"), F.coalesce("s.kind", F.lit("unknown")).alias("kind"), F.coalesce(F.get("s.documentation", F.lit(0)), F.lit("")).alias("description"), F.when(line > 0, line).alias("line"), "s.relationships")
    first = own.groupBy("path", "symbol").agg(F.min(F.struct("line", "label", "kind", "description")).alias("x"))
    nodes = first.select(_scip_id(F.col("path"), F.col("symbol")).alias("id"), "x.label", "x.kind", F.col("path").alias("source_file"), "x.line", "x.description")
    rel = own.select("path", "symbol", "line", F.explode("relationships").alias("r")).where("r.symbol <> ''")
    relation = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref")
    rel = rel.select("path", "symbol", "line", F.col("r.symbol").alias("to"), relation.alias("relation"))
    here = first.select(F.col("path").alias("p"), F.col("symbol").alias("s"), F.lit(True).alias("is_here"))
    only = first.groupBy(F.col("symbol").alias("t")).agg(F.min("path").alias("there"), F.count("*").alias("n")).where("n = 1").drop("n")
    j = rel.join(here, (F.col("path") == F.col("p")) & (F.col("to") == F.col("s")), "left").join(only, F.col("to") == F.col("t"), "left")
    at = F.when(F.col("is_here"), F.col("path")).otherwise(F.coalesce("there", "path"))
    edges = j.select(_scip_id(F.col("path"), F.col("symbol")).alias("src"), _scip_id(at, F.col("to")).alias("dst"), "relation", F.col("path").alias("source_file"), "line").distinct()
    outside = j.where("is_here is null and there is null").select(_scip_id(F.col("path"), F.col("to")).alias("id"), F.element_at(F.split("to", "#"), -1).alias("label"), F.lit("external").alias("kind"), F.col("path").alias("source_file"), F.lit(None).cast("int").alias("line"), F.lit("").alias("description"))
    return nodes.unionByName(outside.distinct()), edges


# --- package manifests

#: Names of manifests and the ecosystem of each.
ECOSYSTEMS = {"apm.yml": "apm", "apm.yaml": "apm", "pyproject.toml": "python", "cargo.toml": "cargo", "go.mod": "go", "pom.xml": "maven"}


def requirement_name(spec: Column) -> Column:
    """The package that a requirement names."""
    return F.regexp_extract(F.trim(spec), r"^([^\s<>=!~;\[(]*)", 1)


def package_key(ecosystem: Column, name: Column) -> Column:
    """Identity across repos; names of Python distributions in their normal form."""
    flat = F.when(ecosystem == "python", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).when(ecosystem == "apm", F.lower(name)).otherwise(name)
    return F.concat(ecosystem, F.lit(":"), flat)


def _names(block) -> list[str]:
    if isinstance(block, dict):
        return list(block)
    return [str(x if isinstance(x, str) else next(iter(x))) for x in block or () if isinstance(x, str) or (isinstance(x, dict) and x)] if isinstance(block, list) else []


def _pyproject(text: str):
    doc = tomllib.loads(text)
    project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
    wanted = [re.match(r"[^\s<>=!~;\[(]*", x.strip())[0] for x in project.get("dependencies") or () if isinstance(x, str)]
    wanted += [x for x in poetry.get("dependencies") or () if x.lower() != "python"]
    return project.get("name") or poetry.get("name"), project.get("version") or poetry.get("version"), wanted


def _cargo(text: str):
    doc = tomllib.loads(text)
    package = doc.get("package") or {}
    wanted = _names(doc.get("dependencies"))
    for target in (doc.get("target") or {}).values():
        wanted += _names(target.get("dependencies")) if isinstance(target, dict) else []
    version = package.get("version")
    return package.get("name"), version if isinstance(version, str) else None, wanted


def _gomod(text: str):
    module = re.search(r"^\s*module\s+(\S+)", text, re.M)
    blocks = "\n".join(re.findall(r"^\s*require\s*\((.*?)\)", text, re.M | re.S))
    single = re.findall(r"^\s*require\s+([^\s(]+)\s+v\S+", text, re.M)
    return module and module[1], None, re.findall(r"^\s*([^\s/][^\s]*)\s+v\S+", blocks, re.M) + single


def _pom(text: str):
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))

    def name(x):
        group, artifact = x.findtext("groupId"), x.findtext("artifactId")
        return f"{group}:{artifact}" if group and artifact else artifact

    return name(root), root.findtext("version"), [n for n in map(name, root.iterfind(".//dependencies/dependency")) if n]


def _apm(text: str):
    top = dict(re.findall(r"""^(name|version):\s*["']?([^"'\s#]+)""", text, re.M))
    block = re.search(r"^dependencies:\s*\n((?:[ \t-].*\n?|\n)*)", text, re.M)
    wanted = re.findall(r"""^\s*-\s*["']?([^"'\s#:]+)|^\s{2,}([\w./@-]+)\s*:""", block[1] if block else "", re.M)
    return top.get("name"), top.get("version"), [a or b for a, b in wanted]


_PARSERS = {"python": _pyproject, "cargo": _cargo, "go": _gomod, "maven": _pom, "apm": _apm}


def packages(files: DataFrame) -> DataFrame:
    """``path, ecosystem, name, version, dependencies`` of the manifests among ``path, content``; broken ones give no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                kind = ECOSYSTEMS.get(path.rsplit("/", 1)[-1].lower())
                try:
                    name, version, wanted = _PARSERS[kind](content or "") if kind else (None, None, [])
                except (ValueError, ET.ParseError, AttributeError, TypeError):
                    continue
                if name:
                    rows.append((path, kind, name, version, list(dict.fromkeys(w for w in wanted if w))))
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "version", "dependencies"])

    return files.select("path", "content").mapInPandas(run, "path string, ecosystem string, name string, version string, dependencies array<string>")


def package_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Package nodes (with ``package_key, dependency_keys``) and ``depends_on`` edges; a package doesn't depend on itself, outside ones get no node."""
    pid = lambda x: F.concat(F.lit("pkg:"), F.lower(F.regexp_replace(x, r"[^\w]+", "_")))
    wanted = F.filter("dependencies", lambda d: pid(d) != pid(F.col("name")))
    nodes = found.select(pid(F.col("name")).alias("id"), F.col("name").alias("label"), "ecosystem", "version", F.col("path").alias("source_file"), package_key(F.col("ecosystem"), F.col("name")).alias("package_key"), F.transform(wanted, lambda d: package_key(F.col("ecosystem"), d)).alias("dependency_keys"))
    edges = found.select(pid(F.col("name")).alias("src"), F.explode(wanted).alias("d"), F.col("path").alias("source_file")).select("src", pid(F.col("d")).alias("dst"), F.lit("depends_on").alias("relation"), "source_file").distinct()
    return nodes, edges


def workspace(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crates of a Cargo workspace (``path, content``; paths relative to its root) and the dependencies among them; renamed ones by their real name."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    doc = tomllib.loads(content or "")
                except ValueError:
                    continue
                wanted = doc.get("dependencies") or {}
                real = [v["package"] if isinstance(v, dict) and isinstance(v.get("package"), str) else k for k, v in wanted.items()]
                rows.append((path, (doc.get("package") or {}).get("name"), sorted(set(real)), [m for m in (doc.get("workspace") or {}).get("members") or () if isinstance(m, str)]))
            yield pd.DataFrame(rows, columns=["path", "name", "wanted", "members"])

    read = files.where("path = 'Cargo.toml' or path like '%/Cargo.toml'").select("path", "content").mapInPandas(run, "path string, name string, wanted array<string>, members array<string>")
    root = read.where("path = 'Cargo.toml'").select("members").first()
    globs = [fnmatch.translate(f"{m.rstrip('/')}/Cargo.toml").replace(".*", "[^/]*") for m in (root.members if root else [])]
    member = F.col("path") == "Cargo.toml"
    for g in globs:
        member = member | F.col("path").rlike("^" + re.sub(r"\(\?s:(.*)\)\\[zZ]", r"\1", g) + "$")
    crates = read.where(member & F.col("name").isNotNull())
    nodes = crates.select(F.concat(F.lit("crate:"), "name").alias("id"), F.col("name").alias("label"), F.col("path").alias("source_file"))
    inner = crates.select(F.col("name").alias("dep")).distinct()
    edges = crates.select("name", F.explode("wanted").alias("dep"), F.col("path").alias("source_file")).join(inner, "dep").select(F.concat(F.lit("crate:"), "name").alias("src"), F.concat(F.lit("crate:"), "dep").alias("dst"), F.lit("crate_depends_on").alias("relation"), "source_file")
    return nodes, edges


# --- server configurations

#: Names of configuration files of model-context servers.
MCP_FILES = (".mcp.json", "claude_desktop_config.json", "mcp.json", "mcp_servers.json")
_SERVERS = "map<string,struct<command:string,args:array<string>,env:map<string,string>>>"


def mcp(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of server configurations: servers by file, commands, packages and names of variables shared by all files.

    Values of variables are never read, arguments never kept but for the package they name.
    """
    own = files.where(F.element_at(F.split("path", "/"), -1).isin(*MCP_FILES)).select("path", F.from_json("content", f"mcpServers {_SERVERS}, mcp struct<servers:{_SERVERS}>").alias("c"))
    each = own.select("path", F.explode(F.coalesce("c.mcpServers", "c.mcp.servers")).alias("server", "spec")).where("server <> '' and spec is not null")
    package = F.get(F.filter("spec.args", lambda a: a.rlike(r"^(?:@[\w.-]+/)?[\w.-]+(?:@[\w.^~-]+)?$") & ~a.startswith("-")), F.lit(0))
    package = F.regexp_replace(package, r"(?<=.)@[^@/]*$", "")
    told = each.select("path", "server", F.concat("path", F.lit("#"), "server").alias("id"), F.trim("spec.command").alias("command"), package.alias("package"), F.map_keys("spec.env").alias("env"))
    links = told.select(F.col("path").alias("src"), F.col("id").alias("dst"), F.col("server").alias("label"), F.lit("mcp_server").alias("kind"), F.lit("contains").alias("relation"))
    links = links.unionByName(told.where("command <> ''").select(F.col("id").alias("src"), F.concat(F.lit("mcp_command:"), "command").alias("dst"), F.col("command").alias("label"), F.lit("mcp_command").alias("kind"), F.lit("references").alias("relation")))
    links = links.unionByName(told.where("package is not null").select(F.col("id").alias("src"), F.concat(F.lit("mcp_package:"), "package").alias("dst"), F.col("package").alias("label"), F.lit("mcp_package").alias("kind"), F.lit("references").alias("relation")))
    links = links.unionByName(told.select(F.col("id").alias("src"), F.explode("env").alias("label")).select("src", F.concat(F.lit("env_var:"), "label").alias("dst"), "label", F.lit("env_var").alias("kind"), F.lit("requires_env").alias("relation")))
    files_ = own.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("mcp_config_file").alias("kind"))
    return files_.unionByName(links.select(F.col("dst").alias("id"), "label", "kind")).distinct(), links.select("src", "dst", "relation").distinct()


# --- database catalogs

_CATALOG = {
    "tables": "select table_schema, table_name, table_type from information_schema.tables where table_schema not in ('pg_catalog', 'information_schema')",
    "keys": "select tc.table_schema, tc.table_name, ccu.table_schema as to_schema, ccu.table_name as to_table from information_schema.table_constraints tc join information_schema.constraint_column_usage ccu on tc.constraint_name = ccu.constraint_name and tc.constraint_schema = ccu.constraint_schema where tc.constraint_type = 'FOREIGN KEY'",
    "views": "select table_schema, table_name, view_definition from information_schema.views where table_schema not in ('pg_catalog', 'information_schema')",
    "routines": "select routine_schema, routine_name, routine_definition from information_schema.routines where routine_schema not in ('pg_catalog', 'information_schema')",
}


def read_catalog(spark: SparkSession, url: str, properties: dict[str, str]) -> dict[str, DataFrame]:
    """Tables, keys, views and routines of a PostgreSQL database over JDBC (its driver must be on the class path)."""
    return {name: spark.read.jdbc(url, f"({query}) q", properties=properties) for name, query in _CATALOG.items()}


def catalog_graph(catalog: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, kind``) and edges: foreign keys as ``references``, what views and routines read as ``reads_from``."""

    def full(schema, name):
        return F.lower(F.concat(F.col(schema), F.lit("."), F.col(name)))

    tables, views, routines = catalog["tables"], catalog["views"], catalog["routines"]
    nodes = tables.select(full("table_schema", "table_name").alias("id"), F.when(F.col("table_type") == "VIEW", "view").otherwise("table").alias("kind")).unionByName(routines.select(full("routine_schema", "routine_name").alias("id"), F.lit("function").alias("kind"))).distinct()
    keys = catalog["keys"].select(full("table_schema", "table_name").alias("src"), full("to_schema", "to_table").alias("dst"), F.lit("references").alias("relation"))
    bodies = views.select(full("table_schema", "table_name").alias("src"), F.lower("table_schema").alias("schema"), F.col("view_definition").alias("body")).unionByName(routines.select(full("routine_schema", "routine_name").alias("src"), F.lower("routine_schema").alias("schema"), F.col("routine_definition").alias("body")))
    read = bodies.select("src", "schema", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r'\b(?:from|join)\s+([\w."]+)'), 1)).alias("to"))
    to = F.replace(F.col("to"), F.lit('"'), F.lit(""))
    read = read.select("src", F.when(to.contains("."), to).otherwise(F.concat("schema", F.lit("."), to)).alias("dst"), F.lit("reads_from").alias("relation"))
    return nodes, keys.unionByName(read.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst")).distinct()


# --- Office and PDF files

#: Bytes that an archive or a stream may unpack to.
UNPACKED = 64 << 20


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    if sum(i.file_size for i in z.infolist()) > UNPACKED:
        raise ValueError("archive unpacks to too much")
    return z.read(name)


def docx_text(data: bytes) -> str:
    """Paragraphs, headings as Markdown."""
    z = zipfile.ZipFile(io.BytesIO(data))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    for p in ET.fromstring(_part(z, "word/document.xml")).iter(f"{w}p"):
        style = p.find(f"{w}pPr/{w}pStyle")
        level = re.match(r"Heading(\d)", style.get(f"{w}val", "") if style is not None else "")
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        if text:
            out.append("#" * int(level[1]) + " " + text if level else text)
    return "\n".join(out)


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cell texts)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ET.fromstring(_part(z, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(_part(z, "xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(_part(z, "xl/workbook.xml")).iter(f"{ns}sheet"):
        name = target[sheet.get(rel)].lstrip("/")
        rows = []
        for r in ET.fromstring(_part(z, name if name.startswith("xl/") else f"xl/{name}")).iter(f"{ns}row"):
            cells = []
            for c in r.iter(f"{ns}c"):
                v = c.findtext(f"{ns}v") or "".join(t.text or "" for t in c.iter(f"{ns}t"))
                cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
            rows.append(cells)
        out.append((sheet.get("name"), rows))
    return out


def pdf_text(data: bytes) -> str:
    """Texts that the content streams of a PDF show; encodings other than the plain ones give no text."""
    out, left = [], UNPACKED
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body, left)
            except zlib.error:
                continue
        left = max(left - len(body), 1)
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            shown = re.findall(rb"\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")|\[((?:\\.|\((?:\\.|[^()\\])*\)|[^\]])*)\]\s*TJ", block, re.S)
            for one, many in shown:
                pieces = [one] if one else re.findall(rb"\(((?:\\.|[^()\\])*)\)", many)
                out.append("".join(re.sub(rb"\\([()\\])", rb"\1", p).decode("latin-1") for p in pieces))
    return "\n".join(x for x in out if x.strip())


def office_text(files: DataFrame) -> DataFrame:
    """``path, text`` of Word, Excel and PDF files (``path, content`` as binary); broken files have a null text."""

    def read(path: str, data: bytes) -> str | None:
        try:
            kind = path.rsplit(".", 1)[-1].lower()
            if kind == "docx":
                return docx_text(data)
            if kind == "xlsx":
                return "\n\n".join(f"## {name}\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) for name, rows in xlsx_sheets(data))
            return pdf_text(data)
        except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError):
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "text": [read(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]})

    return files.where(F.lower("path").rlike(r"\.(docx|xlsx|pdf)$")).select("path", "content").mapInPandas(run, "path string, text string")


def xlsx_structure(files: DataFrame) -> DataFrame:
    """``src, dst, kind``: sheets contained in their file, columns (named by a sheet's first row) in their sheet."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for name, cells in xlsx_sheets(bytes(data)):
                        rows.append((path, f"{path}#{name}", "sheet"))
                        rows += [(f"{path}#{name}", f"{path}#{name}.{c}", "column") for c in (cells[0] if cells else []) if c]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["src", "dst", "kind"])

    return files.where(F.lower("path").rlike(r"\.xlsx$")).select("path", "content").mapInPandas(run, "src string, dst string, kind string").distinct()


# --- ignore rules


def _regex(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "[" and (end := glob.find("]", k + 2)) > 0:
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return out


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool, bool]]:
    """(regex, negated, only folders) of an ignore file that lies in ``folder``."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        base = re.escape(folder.rstrip("/") + "/") if folder else ""
        out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{_regex(line.lstrip('/'))}$", negated, only))
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a path is ignored: the last rule that matches decides, for the path and each folder above it; an ignored folder stays so."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("folder")))

    def hit(x: Column) -> Column:
        out = F.lit(False)
        for regex, negated, only in rules:  # in order: later rules win
            match = x["path"].rlike(regex) & (x["folder"] if only else F.lit(True))
            out = F.when(match, F.lit(not negated)).otherwise(out)
        return out

    return F.exists(every, hit)


RULES = "folder string, at string, line int, regex string, negated boolean, only boolean"


def rules_of(files: DataFrame) -> DataFrame:
    """The rules (see RULES) of ignore files (``path, text``): each holds for the folder that its file lies in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p.rpartition("/")[0], p, k, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for k, r in enumerate(ignore_rules(t or "", p.rpartition("/")[0]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    return files.select("path", "text").mapInPandas(run, RULES)


def prefixes(path: Column) -> Column:
    """Array of ``path, folder``: a path and each folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("folder")))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``path`` of the paths that rules leave out: the last rule that matches decides, those of deeper folders coming last, for the path and each folder
    above it; an ignored folder stays so.

    Every folder and file is joined once with the rules of the folders above it, so that the plan doesn't grow with the number of rules.
    """
    each = paths.select("path", F.explode(prefixes(F.col("path"))).alias("e")).select("path", F.col("e.path").alias("entry"), F.col("e.folder").alias("is_folder"))
    entries = each.select("entry", "is_folder").distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("entry", "/")) - 1), lambda i: F.array_join(F.slice(F.split(F.col("entry"), "/"), 1, i), "/"))
    met = entries.select("entry", "is_folder", F.explode(above).alias("folder")).join(rules, "folder")
    met = met.where((F.col("is_folder") | ~F.col("only")) & F.regexp_like("entry", F.col("regex")))
    last = met.groupBy("entry", "is_folder").agg(F.max(F.struct(F.length("at").alias("n"), "at", "line", "negated")).alias("x"))
    return each.join(last.where("not x.negated").select("entry", "is_folder"), ["entry", "is_folder"], "left_semi").select("path").distinct()
