"""Upkeep of a graph: merging twins, rewiring stubs, guards before a graph is replaced, names and bounded renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes of one language family.
FAMILIES = {"py": "py", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "go": "go", "rs": "rs", "java": "jvm", "kt": "jvm", "scala": "jvm", "c": "c", "h": "c", "cpp": "c"}


def by_context(edges: DataFrame, contexts: list[str]) -> DataFrame:
    """Edges of the given contexts; all of them where none is given."""
    return edges.where(F.col("context").isin(contexts)) if contexts else edges


def ghosts(nodes: DataFrame) -> DataFrame:
    """``old, new``: semantic nodes of one (source_file, label) with exactly one parsed node, which replaces them.

    ``nodes``: id, source_file, label, origin (``ast`` or other).
    """
    ast = nodes.where("origin = 'ast'").groupBy("source_file", "label").agg(F.min("id").alias("new"), F.count("*").alias("n")).where("n = 1")
    return nodes.where("origin <> 'ast'").join(ast, ["source_file", "label"]).select(F.col("id").alias("old"), "new")


def repoint(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges whose ends follow ``moved`` (``old, new``, one row per old id), without self-loops that arise from it."""
    was = edges.withColumn("loop", F.col("src") == F.col("dst"))
    for end in ("src", "dst"):
        to = moved.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        was = was.join(to, F.col(end) == F.col("__old"), "left").withColumn(end, F.coalesce("__new", end)).drop("__old", "__new")
    return was.where("loop or src <> dst").drop("loop")


def stub_targets(nodes: DataFrame) -> DataFrame:
    """``old, new``: nodes without a source to the only definition of exactly their label. ``nodes``: id, label, source_file."""
    bare = F.coalesce("source_file", F.lit("")) == ""
    one = nodes.where(~bare).groupBy("label").agg(F.min("id").alias("new"), F.count("*").alias("n")).where("n = 1")
    return nodes.where(bare).join(one, "label").select(F.col("id").alias("old"), "new")


def family_of(suffix: Column) -> Column:
    """Language family of a suffix, null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), suffix)


def language_guard(edges: DataFrame) -> DataFrame:
    """Edges without those that cross languages. ``edges``: relation, confidence, src_suffix, dst_suffix and more.

    Inferred calls go if both suffixes are there and their families (an unknown one is its suffix) differ; imports and
    references go only if both families are known and differ.
    """
    a, b = family_of(F.col("src_suffix")), family_of(F.col("dst_suffix"))
    calls = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.col("src_suffix") != "") & (F.col("dst_suffix") != "")
    calls = calls & (F.coalesce(a, "src_suffix") != F.coalesce(b, "dst_suffix"))
    refs = F.col("relation").isin("imports", "imports_from", "references") & (a != b)
    return edges.where(~F.coalesce(calls, F.lit(False)) & ~F.coalesce(refs, F.lit(False)))


def short_labels(paths: DataFrame) -> DataFrame:
    """``path, label`` of distinct paths: the shortest run of last segments that no other path ends with."""
    parts = F.split("path", "/")
    ends = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, -k, k), "/").alias("label")))).alias("x"))
    ends = ends.select("path", "x.k", "x.label")
    one = ends.groupBy("label").agg(F.min("path").alias("path"), F.min("k").alias("k"), F.count("*").alias("n")).where("n = 1")
    best = one.groupBy("path").agg(F.min(F.struct("k", "label")).alias("x")).select(F.col("path").alias("p"), F.col("x.label").alias("label"))
    return paths.join(best, F.col("path") == F.col("p"), "left").select("path", F.coalesce("label", "path").alias("label"))


def note_names(nodes: DataFrame) -> DataFrame:
    """``id, name``: file names that differ also where case doesn't count; later ids of one name get _1, _2, ..."""
    safe = F.trim(F.regexp_replace("label", r'[\\/*?:"<>|#^\[\]\r\n\t]', ""))
    safe = F.when(safe == "", "unnamed").otherwise(safe)
    k = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id")) - 1
    return nodes.select("id", safe.alias("name")).withColumn("k", k).select("id", F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("k").cast("string"))).alias("name"))


def within_budget(lines: DataFrame, order: list[Column], tokens: int) -> DataFrame:
    """``lines`` (``line`` and more) in ``order`` as far as they fit ``tokens`` of three characters, a line feed each.

    A line takes one character at least, so no more than ``3 * tokens`` lines can fit: only those are ever brought together.
    """
    most = 3 * tokens
    head = lines.orderBy(*order).limit(most)
    upto = F.sum(F.length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("upto", upto).where(F.col("upto") <= most)


def confidence_split(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``community, confidence, n``: edges that touch a community, each counted once for it."""
    s, d = nodes.select(F.col("id").alias("src"), F.col("community").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    both = edges.join(s, "src").join(d, "dst").select("confidence", F.explode(F.array_distinct(F.array("a", "b"))).alias("community"))
    return both.where("community is not null").groupBy("community", "confidence").agg(F.count("*").alias("n"))


def label_lists(nodes: DataFrame, k: int = 4) -> DataFrame:
    """``community, labels``: the labels of a community's first ``k`` ids, joined by a bar."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    first = nodes.where("community is not null").select("community", "id", "label", rank.alias("rn")).where(F.col("rn") <= k)
    return first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]), "|").alias("labels"))


def edge_scores(edges: DataFrame) -> DataFrame:
    """``src, dst, relation, score`` of the edges a diagram may show: extracted ones, and inferred ones from 0.85 on."""
    c, r = F.col("confidence"), F.col("relation")
    shown = edges.where((c == "EXTRACTED") | ((c == "INFERRED") & (F.col("confidence_score") >= 0.85)))
    more = F.when(r.isin("calls", "uses", "method"), 1.0).when(r.isin("imports", "imports_from"), 0.6).when(r == "contains", -0.2).when(r == "rationale_for", -0.6).otherwise(0.0)
    return shown.select("src", "dst", "relation", F.round(F.col("confidence_score") + F.when(c == "EXTRACTED", 2.0).otherwise(0.0) + more, 6).alias("score"))


def diagram_nodes(nodes: DataFrame, edges: DataFrame, scored: DataFrame, most: int = 30) -> list[str]:
    """Ids of the nodes that a diagram of ``most`` nodes shows: where calls enter, then the ends of the best edges, then others in order of id.

    ``scored``: src, dst, score of the edges shown. Entries are ranked by how many more edges go out than come in.
    """
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("x")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(-1).alias("x")))
    own = nodes.select("id").join(ends.groupBy("id").agg(F.sum("x").alias("surplus")), "id", "left")
    picked = [r.id for r in own.where("surplus > 0").orderBy(F.desc("surplus"), "id").limit(max(1, most // 3)).collect()]
    for r in scored.orderBy(F.desc("score"), "src", "dst").limit(most).collect():
        picked += [r.src, r.dst]
    picked += [r.id for r in nodes.select("id").orderBy("id").limit(most).collect()]
    return list(dict.fromkeys(picked))[:most]


def grams_of(needle: str) -> list[str]:
    """The trigrams of a needle, which has three characters or more."""
    n = needle.lower()
    if len(n) < 3:
        raise ValueError("a needle has three characters or more")
    return sorted({n[i : i + 3] for i in range(len(n) - 2)})


def postings(nodes: DataFrame, text: Column, only: list[str] | None = None) -> DataFrame:
    """``gram, id``: which nodes hold a trigram of characters; of the trigrams ``only``, where given."""
    s = nodes.select("id", F.lower(text).alias("s")).where(F.length("s") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring("s", i, F.lit(3))))
    if only is not None:
        grams = F.filter(F.array(*map(F.lit, only)), lambda g: F.contains(F.col("s"), g))
    return s.select(F.explode(grams).alias("gram"), "id")


def gram_candidates(index: DataFrame, needle: str) -> DataFrame:
    """``id`` of the nodes that hold every trigram of ``needle``; a superset of those that hold it."""
    grams = grams_of(needle)
    return index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")


def shrinkage(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row ``lost, unexplained, allowed``: nodes (``id, source_file``) that go, and those whose source wasn't rebuilt."""
    gone = old.join(new.select("id"), "id", "left_anti")
    known = rebuilt.select(F.col("source_file").alias("s")).distinct()
    flags = gone.join(known, F.col("source_file") == F.col("s"), "left").agg(F.count("*").alias("lost"), F.count_if(F.col("s").isNull()).alias("unexplained"))
    return flags.withColumn("allowed", F.col("unexplained") == 0)


def same_topology(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``only_a, only_b, same`` over the rows of ``columns``, repeats counted: one aggregation, no set difference."""
    both = a.select(*columns, F.lit(1).alias("x")).unionByName(b.select(*columns, F.lit(-1).alias("x")))
    n = both.groupBy(*columns).agg(F.sum("x").alias("n"))
    out = n.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_b"))
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def unverified(label: Column, text: Column) -> Column:
    """Whether none of the identifiers of a label stands in the text that was read; a label without any is not flagged."""
    names = F.regexp_extract_all(F.lower(label), F.lit("[a-z_][a-z0-9_]{3,}"), 0)
    return (F.size(names) > 0) & F.forall(names, lambda x: ~F.contains(F.lower(text), x))


def line_range(docs: DataFrame, first: int, last: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, line``: lines ``first`` to ``last``, counted from one, as far as there are any."""
    lines = F.slice(F.split(text, "\n"), first, last - first + 1)
    return docs.select(doc_id, F.posexplode(lines).alias("k", "line")).select(doc_id, (F.col("k") + first).cast("long").alias("line_no"), "line")


def git_url(url: Column) -> Column:
    """scp, ssh and https forms of a repository in one: host/path in lower case, without user, port, slash and .git."""
    x = F.regexp_replace(F.trim(url), r"^[A-Za-z+]+://", "")
    x = F.regexp_replace(x, r"^[^@/]+@", "")
    x = F.regexp_replace(x, r"^([^/:]+):[0-9]+/", "$1/")
    x = F.regexp_replace(x, r"^([^/:]+):", "$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(x, "/+$", ""), r"\.git$", ""))


def neighbours(edges: DataFrame, node: str, relation: str = "") -> DataFrame:
    """``direction, other, relation``: distinct edges from, then to a node whose relation holds a string."""
    e = edges.where(F.contains("relation", F.lit(relation)))
    out = e.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation")
    return out.unionByName(e.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation")).distinct()


def parallel_keys(edges: DataFrame, identity: list[str], content: list[str]) -> DataFrame:
    """``key`` and the columns named: one row per distinct edge; edges of one identity and other content get a suffix."""
    rows = edges.select(*identity, *content).distinct()

    def text(names):
        return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names])

    many = rows.withColumn("n", F.count("*").over(Window.partitionBy(*identity)))
    key = F.substring(F.sha2(text(identity), 256), 1, 16)
    return many.select(F.when(F.col("n") == 1, key).otherwise(F.concat_ws("-", key, F.substring(F.sha2(text(content), 256), 1, 8))).alias("key"), *identity, *content)


def remap_members(groups: DataFrame, moved: DataFrame) -> DataFrame:
    """``id, members`` of (``id, members`` array): members become their survivors (``old, new``), each at its first place."""
    each = groups.select("id", F.posexplode("members").alias("pos", "member"))
    each = each.join(moved.select(F.col("old").alias("o"), "new"), F.col("member") == F.col("o"), "left").groupBy("id", F.coalesce("new", "member").alias("m")).agg(F.min("pos").alias("pos"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("members"))


def sanitized(label: Column, most: int = 256) -> Column:
    """Label without control characters, cut to ``most`` characters, with HTML escaped."""
    x = F.substring(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""), 1, most)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def survivors(rows: DataFrame, fill: list[str]) -> DataFrame:
    """One row per id: definers before others, active before archived, then the shortest and smallest label.

    ``rows``: id, source_file, definer, lifecycle, label, seq and ``fill``, whose nulls are filled from the next best row of the
    survivor's source_file that has a value. One aggregation per (id, source_file), then one per id.
    """
    rank = F.struct((~F.col("definer")).alias("d"), "lifecycle", F.length("label").alias("n"), "label", "seq")
    values = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fill]
    per = rows.groupBy("id", "source_file").agg(F.min(rank).alias("rank"), *values)
    best = per.groupBy("id").agg(F.min_by(F.struct("source_file", F.col("rank.label").alias("label"), *fill), "rank").alias("x"))
    return best.select("id", "x.*")


def doc_twins(nodes: DataFrame) -> DataFrame:
    """``old, new``: a bare slug folds into the node of the same slug with ``_doc``."""
    twins = nodes.where(F.col("id").endswith("_doc")).select(F.regexp_replace("id", "_doc$", "").alias("old"), F.col("id").alias("new"))
    return nodes.select(F.col("id").alias("old")).join(twins, "old").distinct()


def common_folders(a: Column, b: Column) -> Column:
    """How many leading segments two slash-separated paths share, their file names apart."""

    def folders(x):
        return F.slice(F.split(x, "/"), 1, F.size(F.split(x, "/")) - 1)

    same = F.zip_with(folders(a), folders(b), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def tie_break(candidates: DataFrame) -> DataFrame:
    """``call, target`` of (call, call_file, target, target_file) where one candidate is left: a call outside tests drops those
    in tests, then only candidates that share the most leading folders stay."""

    def in_tests(x):
        return F.col(x).rlike("(^|/)tests?/")

    left = candidates.where(in_tests("call_file") | ~in_tests("target_file"))
    near = left.groupBy("call", common_folders(F.col("call_file"), F.col("target_file")).alias("near")).agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"))
    return near.groupBy("call").agg(F.max(F.struct("near", "n", "target")).alias("x")).where("x.n = 1").select("call", F.col("x.target").alias("target"))


def expand(hits: DataFrame, edges: DataFrame, limit: int = 50, most: int = 3) -> DataFrame:
    """``src, dst, relation``: distinct edges that touch one of the best ``most`` hits (``id, score``), the first ``limit`` in order."""
    best = hits.orderBy(F.desc("score"), "id").limit(most).select("id")
    e = edges.select("src", "dst", "relation")
    out = e.join(F.broadcast(best), F.col("src") == F.col("id"), "left_semi").unionByName(e.join(F.broadcast(best), F.col("dst") == F.col("id"), "left_semi"))  # at most ``most`` rows
    return out.distinct().orderBy("src", "dst", "relation").limit(limit)


def overlay(lessons: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, status, score, stale``: lessons on the nodes that exist; stale where the content has another hash than when learnt.

    ``lessons``: node, status, score, seen_hash. ``nodes``: id, hash.
    """
    got = lessons.join(nodes.select("id", "hash"), F.col("node") == F.col("id"))
    return got.select("id", "status", "score", (~F.col("hash").eqNullSafe(F.col("seen_hash"))).alias("stale"))
