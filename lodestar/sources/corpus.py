"""Corpus scan, manifests, graph files and structured sources as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import settle

#: File categories by suffix.
CODE = tuple(
    "py ts tsx mts cts js jsx mjs cjs ejs ets go rs java groovy gradle cpp cc cxx c h hpp cu cuh metal rb rake swift kt kts cs scala php lua luau toc zig "
    "ps1 psm1 psd1 ex exs m mm ml mli jl vue svelte astro dart v sv svh sql r f f90 f95 f03 f08 pas pp dpr dpk lpr inc dfm lfm lpk sh bash json tf tfvars hcl "
    "dm dme dmi dmm dmf sln slnx csproj fsproj vbproj xaml razor cshtml cls trigger lisp cl lsp asd".split()
)
DOCUMENT = ("md", "mdx", "qmd", "skill", "txt", "rst", "html", "yaml", "yml", "docx", "xlsx")
PAPER = ("pdf",)
IMAGE = ("png", "jpg", "jpeg", "gif", "webp", "svg")
VIDEO = ("mp4", "mov", "webm", "mkv", "avi", "m4v", "mp3", "wav", "m4a", "ogg")
#: Folders of credentials, folders that may be such, names and words of files that hold them, formats that are prose or data.
STORES = (".ssh", ".gnupg", ".aws", ".gcloud")
PERHAPS = ("secrets", "credentials")
SENSITIVE = r"(?i)(^|/)(\.env(\..*)?|\.envrc(\..*)?|id_rsa|id_dsa|id_ecdsa|id_ed25519|\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto|secring(\.(gpg|pgp))?|.*\.(pem|key|p12|pfx|keystore|jks))$"
TEMPLATE = r"(?i)(^|/)\.(env|envrc)\..*(example|sample|template|dist)$"
KEYWORD = r"(?i)(?<![a-zA-Z0-9])(?:(?:credential|secret|passwd|password|private_key)s?|tokens?|service[._-]?account)(?![a-zA-Z])"
PROSE = ("md", "markdown", "rst", "org", "adoc", "tex")
DATA = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "config", "xml", "properties", "env", "txt", "tfvars")
#: Folders without sources; those that only are so if they hold such a file.
NOISE = ("node_modules", "__pycache__", ".git", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "site-packages")
MARKED = {"env": r"(pyvenv\.cfg|bin/activate|conda-meta/.*)", "coverage": r"(lcov\.info|lcov-report/.*|coverage-final\.json|clover\.xml)", "snapshots": r"[^/]*\.snap"}
#: Signs of a paper in the first 3000 characters, and how many make one.
PAPER_SIGNS = (r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b")
#: Words below which a graph is hardly needed, words and files above which it is costly.
FEW_WORDS, MANY_WORDS, MANY_FILES = 50_000, 500_000, 500


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def looks_like_paper(text: Column, least: int = 3) -> Column:
    head = F.substring(text, 1, 3000)
    hits = F.lit(0)
    for sign in PAPER_SIGNS:
        hits = hits + head.rlike(sign).cast("int")
    return hits >= least


def category(path: Column, text: Column) -> Column:
    """code, paper, image, video or document; a text that looks like a paper is one; null if unknown."""
    s = suffix(path)
    shebang = (s == "") & text.startswith("#!")
    return (
        F.when(s.isin(*CODE) | shebang, "code")
        .when(s.isin(*PAPER) | (s.isin("md", "mdx", "txt", "rst") & F.coalesce(looks_like_paper(text), F.lit(False))), "paper")
        .when(s.isin(*IMAGE), "image")
        .when(s.isin(*VIDEO), "video")
        .when(s.isin(*DOCUMENT), "document")
    )


def is_sensitive(path: Column) -> Column:
    """Whether a file is likely to hold credentials: by its folder, by its name, or by a word that names its content.

    Such a word counts if it ends the name or the name has at most two words. Source code passes the last test and that of folders which
    only may be stores; notes of several words pass the last.
    """
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.lower(x))
    name, kind = F.element_at(parts, -1), suffix(path)
    source = kind.isin(*[c for c in CODE if c not in DATA])
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"^\.+(?=.)", "")
    few = F.size(F.filter(F.split(stem, r"[-_\s.]+"), lambda w: w != "")) <= 2
    named = stem.rlike(KEYWORD) & (stem.rlike(KEYWORD + "$") | few)
    note = kind.isin(*PROSE) & ~stem.rlike("^" + KEYWORD + "$")
    stores = F.arrays_overlap(folders, F.array(*map(F.lit, STORES)))
    perhaps = F.arrays_overlap(folders, F.array(*map(F.lit, PERHAPS))) & ~source
    return stores | perhaps | (path.rlike(SENSITIVE) & ~path.rlike(TEMPLATE)) | (named & ~source & ~note)


def is_noise(path: Column) -> Column:
    """Whether a path lies in a folder of caches, dependencies or environments."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.isin(*NOISE) | x.endswith("_venv") | x.endswith(".egg-info")) | path.rlike(r"(^|/)\.[^/]+/worktrees/")


def marked_noise(paths: DataFrame) -> DataFrame:
    """``folder``: folders that look like environments, coverage reports or snapshots and hold a file that proves it."""
    out = None
    for name, proof in MARKED.items():
        own = "(?:[^/]*_)?env|\\.env" if name == "env" else name
        hit = paths.select(F.regexp_extract("path", rf"^((?:.*/)?(?:{own}))/{proof}$", 1).alias("folder")).where("folder <> ''").distinct()
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def scan(spark: SparkSession, root: str, glob: str = "*", excludes: str = "", ignore_files: str = ".gitignore") -> DataFrame:
    """``path`` (relative), ``content``, ``bytes``, ``mtime``, ``category``, ``words`` of the files below a folder that any of Spark's file systems holds.

    Ignore files count for the folder they lie in, ``excludes`` (in the same form) for all. Files in noise folders and files that are
    likely to hold credentials are left out.
    """
    from . import manifests as M

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+://[^/]*", "")
    rel = F.call_function("substring_index", F.col("path"), F.concat(base, F.lit("/")), F.lit(-1))
    files = files.withColumn("rel", rel).where(~is_noise(F.col("rel")))
    own = files.where(F.element_at(F.split("rel", "/"), -1) == ignore_files).select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("text"))
    # excludes of the call come after all files' rules
    wide = M.rules_of(spark.createDataFrame([(excludes,)], "text string").select(F.lit("").alias("path"), "text")).withColumn("at", F.lit("~" * 4096))
    paths = settle(files.select(F.col("rel").alias("path")))
    gone = settle(M.ignored(paths, M.rules_of(own).unionByName(wide)))
    inside = paths.select("path", F.explode(M.prefixes(F.col("path"))).alias("e")).where("e.folder").select("path", F.col("e.path").alias("folder"))
    gone = settle(gone.unionByName(inside.join(marked_noise(paths), "folder", "left_semi").select("path")).distinct())
    out = files.where(~is_sensitive(F.col("rel"))).join(gone.select(F.col("path").alias("gone")), F.col("rel") == F.col("gone"), "left_anti")
    if glob != "*":
        out = out.where(F.element_at(F.split("rel", "/"), -1).rlike("^" + M._regex(glob) + "$"))
    out = out.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    return out.withColumns({"category": category(F.col("path"), F.col("content")), "words": F.regexp_count("content", F.lit(r"\S+")).cast("long")}).where("category is not null")


def totals(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``category, files, words``; warnings) of a scan."""
    by = files.groupBy("category").agg(F.count("*").alias("files"), F.sum("words").alias("words"))
    row = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    out = [f"{row.words} words: a graph is hardly needed"] if row.words < FEW_WORDS else []
    out += [f"{row.words} words: extraction will be costly"] if row.words > MANY_WORDS else []
    return by, out + ([f"{row.files} files: extraction will be costly"] if row.files > MANY_FILES else [])


def manifest(files: DataFrame) -> DataFrame:
    """``path, hash``: sha256 over content and path; of Markdown only the body below the front matter counts."""
    body = F.when(suffix(F.col("path")) == "md", F.regexp_replace("content", r"^---\n(?s:.*?)\n---\n", "")).otherwise(F.col("content"))
    return files.select("path", F.sha2(F.concat(body, F.lit("\0"), F.col("path")), 256).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` of two manifests: new, changed, unchanged or deleted."""
    a, b = old.select("path", F.col("hash").alias("a")), new.select("path", F.col("hash").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def tiered_changes(files: DataFrame, kept: DataFrame, tier: str = "ast", ignored: DataFrame | None = None) -> DataFrame:
    """``path, change`` of a scan (``path, mtime, hash``) against a manifest (``path, mtime, ast_hash, semantic_hash``) for one tier.

    A file is new without a row, changed if its tier has no hash yet or both time and hash differ, excluded if it is gone from the scan
    but ``ignored`` lists it, else deleted. A file written within two seconds of its row is compared by hash whatever its time.
    """
    old = kept.select("path", F.col("mtime").alias("then"), F.col(f"{tier}_hash").alias("was"))
    j = files.select("path", "mtime", "hash").join(old, "path", "full")
    if ignored is not None:
        j = j.join(ignored.select("path").distinct().withColumn("out", F.lit(True)), "path", "left")
    else:
        j = j.withColumn("out", F.lit(False))
    change = (
        F.when(F.col("hash").isNull(), F.when(F.col("out"), "excluded").otherwise("deleted"))
        .when(F.col("then").isNull() & F.col("was").isNull(), "new")
        .when(F.col("was").isNull() | ((F.col("hash") != F.col("was")) & ((F.col("mtime") != F.col("then")) | (F.abs(F.unix_micros("mtime") - F.unix_micros("then")) <= 2_000_000))), "changed")
        .otherwise("unchanged")
    )
    return j.select("path", change.alias("change"))


def saved_manifest(files: DataFrame, kept: DataFrame | None, tier: str = "ast") -> DataFrame:
    """The manifest after a tier was read: its hash and time are new, the other tier's hash stays, files that are gone go."""
    other = "semantic" if tier == "ast" else "ast"
    now = files.select("path", "mtime", F.col("hash").alias(f"{tier}_hash"))
    if kept is None:
        return now.withColumn(f"{other}_hash", F.lit(None).cast("string"))
    return now.join(kept.select("path", f"{other}_hash"), "path", "left")


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest as JSON lines, one path a line, in order."""
    rows.orderBy("path").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, mtime timestamp, ast_hash string, semantic_hash string").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON file; edges stand under ``links`` or ``edges``, ends may be called from and to."""
    raw = spark.read.option("multiLine", "true").json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*").withColumn("id", F.col("id").cast("string"))
    lists = [F.col(c) for c in ("links", "edges") if c in raw.columns]
    edges = raw.select(F.explode(F.coalesce(*lists)).alias("e")).select("e.*")
    for name, other in (("source", "from"), ("target", "to")):
        if other in edges.columns:
            edges = edges.withColumn(name, F.coalesce(*[F.col(f"`{c}`").cast("string") for c in (name, other) if c in edges.columns])).drop(other)
    return nodes, edges.withColumnsRenamed({"source": "src", "target": "dst"}).withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")})


def markdown_edges(files: DataFrame) -> DataFrame:
    """``src, dst, relation``: headings contained in their file, links and wiki links referenced by it."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line"))
    heads = lines.where(F.col("line").rlike(r"^#{1,6}\s+\S")).select(F.col("path").alias("src"), F.concat("path", F.lit("#"), F.trim(F.regexp_replace("line", r"^#+\s+|\s+#+$", ""))).alias("dst"), F.lit("contains").alias("relation"))

    def links(rx):
        return files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(rx), 1)).alias("dst"), F.lit("references").alias("relation"))

    return heads.unionByName(links(r"(?<!!)\[[^\]]*\]\(([^)\s#]+)[^)]*\)")).unionByName(links(r"\[\[([^\]|#]+)")).distinct()


def _tables(sql: str) -> tuple[set, set]:
    """Objects defined and (from, to, relation) edges of a DDL text."""
    name = r"((?:[\w\"]+\.)?[\w\"]+)"
    defined, edges = set(), set()
    for m in re.finditer(rf"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?{name}(.*?)(?=;|\Z)", sql):
        kind, own, rest = m[1].lower(), m[2].replace('"', "").lower(), m[3]
        defined.add((own, kind))
        for r in re.finditer(rf"(?i)references\s+{name}", rest):
            edges.add((own, r[1].replace('"', "").lower(), "references"))
        if kind in ("view", "function", "procedure"):
            ctes = {x.lower() for x in re.findall(r"(?i)(?:with|,)\s+(\w+)\s+as\s*\(", rest)}
            for r in re.finditer(rf"(?i)\b(?:from|join)\s+{name}", rest):
                if (to := r[1].replace('"', "").lower()) not in ctes:
                    edges.add((own, to, "reads_from"))
        if kind == "trigger" and (r := re.search(rf"(?i)\bon\s+{name}", rest)):
            edges.add((r[1].replace('"', "").lower(), own, "triggers"))
    for m in re.finditer(rf"(?is)alter\s+table\s+(?:only\s+)?{name}(?:(?!;).)*?references\s+{name}", sql):
        edges.add((m[1].replace('"', "").lower(), m[2].replace('"', "").lower(), "references"))
    return defined, edges


def sql_edges(files: DataFrame) -> DataFrame:
    """``path, kind, src, dst``: what SQL files define (kind of the object, dst null) and how it is linked (kind = relation)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                defined, edges = _tables(re.sub(r"--[^\n]*|(?s:/\*.*?\*/)", " ", content or ""))
                rows += [(path, kind, own, None) for own, kind in sorted(defined)] + [(path, rel, a, b) for a, b, rel in sorted(edges)]
            yield pd.DataFrame(rows, columns=["path", "kind", "src", "dst"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, src string, dst string")


def url_kind(url: Column) -> Column:
    return (
        F.when(url.rlike(r"(?i)^https?://(www\.)?(twitter|x)\.com/"), "tweet")
        .when(url.rlike(r"(?i)^https?://(www\.)?arxiv\.org/"), "arxiv")
        .when(url.rlike(r"(?i)^https?://(www\.)?(youtube\.com|youtu\.be)/"), "youtube")
        .when(url.rlike(r"(?i)\.pdf($|\?)"), "pdf")
        .when(url.rlike(r"(?i)\.(png|jpe?g|gif|webp|svg)($|\?)"), "image")
        .otherwise("web")
    )
