"""Relational core over ``nodes`` and ``edges`` DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import settle

#: Relations that never replace a specific one, and labels too common to rank.
GENERIC = ("references", "uses", "mentions")
PLUMBING = ("imports", "imports_from", "contains", "method")
JSON_KEYS = ("start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies")


def degree(edges: DataFrame) -> DataFrame:
    """``id, degree``: incident edges; a self-loop counts twice, parallel edges each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_concept(path: Column) -> Column:
    """No file behind the node: no path, or a last segment without a dot."""
    return F.coalesce(path, F.lit("")).eqNullSafe("") | ~last_segment(path).contains(".")


def is_file(label: Column, path: Column, deg: Column) -> Column:
    """The node of a file itself, a method stub, or a bare function with at most one edge."""
    return (label == last_segment(path)) | (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (deg <= 1))


def is_json_key(label: Column, path: Column) -> Column:
    """A key that any JSON file may have."""
    return F.lower(F.coalesce(path, F.lit(""))).endswith(".json") & F.lower(F.trim(label)).isin(*JSON_KEYS)


def prune_repo(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of a repo and the edges at them."""
    left = nodes.where(~F.col("repo").eqNullSafe(repo))
    return left, prune_dangling(left, edges)


def god_nodes(nodes: DataFrame, edges: DataFrame, k: int = 10, noise: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` real entities of highest degree; ties by id."""
    d = nodes.join(degree(edges), "id").where(~is_concept(F.col("source_file")) & ~is_file(F.col("label"), F.col("source_file"), F.col("degree")) & ~is_json_key(F.col("label"), F.col("source_file")))
    return d.where(~F.col("label").isin(*noise) if noise else F.lit(True)).select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(k)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, and the share of each confidence in percent, rounded; a missing confidence is EXTRACTED."""
    c = F.coalesce("confidence", F.lit("EXTRACTED"))
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    share = [F.round(100.0 * F.count_if(c == x) / F.count("*")).cast("long").alias(f"pct_{x.lower()}") for x in ("EXTRACTED", "INFERRED", "AMBIGUOUS")]
    return n.crossJoin(edges.agg(F.count("*").alias("n_edges"), *share))  # one row by one row


def audit(edges: DataFrame) -> DataFrame:
    """Edges by relation and confidence, with the mean score of what was inferred."""
    score = F.avg(F.when(F.col("confidence") == "INFERRED", F.coalesce("confidence_score", F.lit(0.5))))
    return edges.groupBy("relation", "confidence").agg(F.count("*").alias("n"), F.round(score, 2).alias("avg_inferred"))


def dedupe_nodes(rows: DataFrame, order: str) -> DataFrame:
    """One row per id: the place of its first row, the content of its last."""
    other = [c for c in rows.columns if c not in ("id", order)]
    last = F.max_by(F.struct(*other), order)
    return rows.groupBy("id").agg(F.min(order).alias("position"), last.alias("x")).select("id", "position", *[F.col("x")[c].alias(c) for c in other])


def dedupe_edges(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each (src, dst, relation)."""
    other = [c for c in rows.columns if c not in ("src", "dst", "relation", order)]
    got = rows.groupBy("src", "dst", "relation").agg(F.min_by(F.struct(*other), order).alias("x"))
    return got.select("src", "dst", "relation", *[F.col("x")[c].alias(c) for c in other])


def collapse(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One edge per pair. In order of (src, dst, relation) later edges overwrite, but a generic one never a specific one.

    So the last specific edge stays, or the last generic one where there is no other.
    """
    a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    rank = F.struct((~F.col("relation").isin(*GENERIC)).alias("specific"), "src", "dst", "relation")
    got = edges.groupBy(a.alias("a"), b.alias("b")).agg(F.max(rank).alias("x"), F.count("*").alias("parallel_count"), F.sum("weight").alias("weight"))
    return got.select("a", "b", F.col("x.relation").alias("relation"), F.col("x.src").alias("src"), "parallel_count", "weight")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select(F.col("id")).distinct()
    src, dst = ids.select(F.col("id").alias("s")), ids.select(F.col("id").alias("d"))
    return edges.join(src, F.col("src") == F.col("s"), "left").join(dst, F.col("dst") == F.col("d"), "left").where("s is null or d is null").drop("s", "d")


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, change``: added or removed."""
    a = new.select("id").join(old.select("id"), "id", "left_anti").distinct().withColumn("change", F.lit("added"))
    return a.unionByName(old.select("id").join(new.select("id"), "id", "left_anti").distinct().withColumn("change", F.lit("removed")))


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``a, b, relation, change`` over unordered pairs."""

    def keys(df, flag):
        return df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").distinct().withColumn(flag, F.lit(True))

    both = keys(old, "o").join(keys(new, "n"), ["a", "b", "relation"], "full").where("o is null or n is null")
    return both.select("a", "b", "relation", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def merge(base: DataFrame, fresh: DataFrame, sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """Incremental merge: rows of re-extracted or deleted sources leave ``base``, all rows of ``fresh`` come in."""
    gone = sources.select("source_file").unionByName(deleted.select("source_file")).distinct()
    return base.join(gone, "source_file", "left_anti").select(base.columns).unionByName(fresh.select(base.columns))


def compose(current: DataFrame, other: DataFrame) -> DataFrame:
    """Union by id; where both have a row the other wins."""
    kept = current.join(other.select("id"), "id", "left_anti")
    return kept.select(current.columns).unionByName(other.select(current.columns))


def normal_id(x: Column) -> Column:
    """Lower case, runs of what is no letter or digit become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}_]+", "_"), "^_+|_+$", "")


def resolve_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends resolved: by id, else by a normalised id that only one node has; others are dropped."""
    exact = nodes.select("id")
    alias = nodes.groupBy(normal_id(F.col("id")).alias("k")).agg(F.min("id").alias("via"), F.count("*").alias("n")).where("n = 1").select("k", "via")
    out = edges
    for end in ("src", "dst"):
        e = exact.select(F.col("id").alias("e"))
        out = out.join(e, F.col(end) == F.col("e"), "left").join(alias, normal_id(F.col(end)) == F.col("k"), "left")
        out = out.withColumn(end, F.coalesce("e", "via")).drop("e", "k", "via")
    return out.where("src is not null and dst is not null")


def diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: dangling, self-loops, valid, exact repeats, pairs with parallel edges and with several relations."""
    n = nodes.select(F.col("id").alias("s"))
    e = edges.join(n, F.col("src") == F.col("s"), "left").join(n.withColumnRenamed("s", "d"), F.col("dst") == F.col("d"), "left")
    flags = e.agg(F.count_if(F.col("s").isNull() | F.col("d").isNull()).alias("dangling"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.count("*").alias("total"))
    whole = edges.groupBy(*edges.columns).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("exact_repeats"))
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("relation").alias("r"))
    groups = pairs.agg(F.count_if(F.col("n") > 1).alias("parallel_pairs"), F.count_if(F.col("r") > 1).alias("mixed_pairs"))
    return flags.crossJoin(whole).crossJoin(groups)  # one row each


def unique_targets(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls resolved by label where exactly one symbol has it and it is not the caller; INFERRED at 0.85."""
    one = symbols.groupBy("label").agg(F.min("id").alias("dst"), F.count("*").alias("n")).where("n = 1").select("label", "dst")
    got = calls.join(one, calls.callee == one.label).where("src <> dst").select("src", "dst").distinct()
    return got.select("src", "dst", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.85).alias("confidence_score"))


def interface_dispatch(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """Interface method -> method of the same name of the only implementer. ``implements``: type, interface; ``methods``: type, id, name."""
    only = implements.groupBy("interface").agg(F.min("type").alias("impl"), F.countDistinct("type").alias("n")).where("n = 1")
    mine = methods.groupBy("type", "name").agg(F.min("id").alias("to"), F.count("*").alias("k")).where("k = 1")
    of = methods.select(F.col("type").alias("interface"), F.col("id").alias("from"), F.col("name"))
    return of.join(only, "interface").join(mine, (F.col("impl") == mine.type) & (of.name == mine.name)).select("from", "to")


def package_links(needs: DataFrame, provides: DataFrame) -> DataFrame:
    """``needs``: repo, key; ``provides``: repo, key. A need links to the provider in another repo if there is exactly one."""
    p = provides.select(F.col("repo").alias("provider"), "key").distinct()
    got = needs.select("repo", "key").distinct().join(p, "key").where("repo <> provider")
    return got.groupBy("repo", "key").agg(F.min("provider").alias("provider"), F.count("*").alias("n")).where("n = 1").select("repo", "key", "provider")


#: Members of one repo under one key that are listed together at most.
LISTED = 256


def shared_types(types: DataFrame) -> DataFrame:
    """Pairs of equal (namespace, label) in different repos, in order of id.

    Each repo's members of a key are listed (in chunks, so that no list grows with the data), lists of two repos are joined, and every two
    members of them are a pair: none is made that isn't returned.
    """
    key = ["namespace", "label"]
    own = types.where("namespace is not null and label is not null and repo is not null and id is not null").select(*key, "repo", "id")
    sizes = own.groupBy(*key, "repo").agg(F.ceil(F.count("*") / LISTED).alias("chunks"))
    lists = own.join(sizes, [*key, "repo"]).groupBy(*key, "repo", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")).agg(F.collect_list("id").alias("ids"))
    lists = settle(lists)
    x, y = (lists.select(*key, *[F.col(c).alias(f"{c}_{n}") for c in ("repo", "chunk", "ids")]) for n in "xy")
    pairs = x.join(y, key).where("repo_x < repo_y").repartition(*key, "repo_x", "repo_y", "chunk_x", "chunk_y")  # a list may make very many pairs
    told = pairs.select(F.explode("ids_x").alias("x"), "ids_y").select("x", F.explode("ids_y").alias("y"))
    return told.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
