"""Symbol store: lookups, calls and their resolution by proximity, repair of parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def family(language: Column) -> Column:
    """ts, tsx and js are one language."""
    return F.when(language.isin("ts", "tsx", "js", "jsx"), "js").otherwise(language)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolve_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``from_id, to_id``: same language family and name; the same file first, then the same folder, else a name unique in all.

    ``symbols``: id, name, file_path, language. ``calls``: from_id, name, file_path, language, qualified.
    """
    s = symbols.select("id", F.col("name").alias("n"), F.col("file_path").alias("f"), family(F.col("language")).alias("l"))
    s = s.withColumn("same", F.count("*").over(Window.partitionBy("n", "l")))
    c = calls.withColumn("cid", F.monotonically_increasing_id())
    j = c.join(s, (F.col("name") == F.col("n")) & (family(F.col("language")) == F.col("l")))
    tier = F.when(F.col("f") == F.col("file_path"), 0).when(folder(F.col("f")) == folder(F.col("file_path")), 1).when((F.col("same") == 1) & ~F.col("qualified"), 2)
    best = j.withColumn("tier", tier).where("tier is not null").groupBy("cid", "from_id").agg(F.min(F.struct("tier", "id")).alias("x"))
    return best.select("from_id", F.col("x.id").alias("to_id")).distinct()


def callers(edges: DataFrame, symbols: DataFrame, symbol_id: str) -> DataFrame:
    """Symbols that call ``symbol_id``."""
    return edges.where((F.col("target") == symbol_id) & (F.col("kind") == "calls")).join(symbols, F.col("source") == F.col("id")).select(symbols.columns)


def callees(edges: DataFrame, symbols: DataFrame, symbol_id: str) -> DataFrame:
    return edges.where((F.col("source") == symbol_id) & (F.col("kind") == "calls")).join(symbols, F.col("target") == F.col("id")).select(symbols.columns)


def repair_parents(symbols: DataFrame) -> DataFrame:
    """Members whose parent is unknown go to the class or interface of their receiver's name in their folder."""
    ids = symbols.select(F.col("id").alias("known"))
    types = symbols.where(F.col("kind").isin("class", "interface")).groupBy(folder(F.col("file_path")).alias("d"), F.col("name").alias("r")).agg(F.min("id").alias("owner"))
    j = symbols.join(ids, F.col("parent_id") == F.col("known"), "left").join(types, (folder(F.col("file_path")) == F.col("d")) & (F.col("receiver") == F.col("r")), "left")
    parent = F.when(F.col("known").isNull() & (F.coalesce("parent_id", F.lit("")) != ""), F.coalesce("owner", "parent_id")).otherwise(F.col("parent_id"))
    return j.select(*[parent.alias(c) if c == "parent_id" else F.col(c) for c in symbols.columns])


def call_roles(edges: DataFrame) -> DataFrame:
    """``id, role``: entry calls and is not called, leaf the reverse, the rest normal."""
    e = edges.where("relation = 'calls'")
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return n.select("id", F.when(F.col("i") == 0, "entry").when(F.col("o") == 0, "leaf").otherwise("normal").alias("role"))


def in_file(symbols: DataFrame, path: str) -> DataFrame:
    """Top-level symbols of a file, by line."""
    return symbols.where((F.col("file_path") == path) & (F.coalesce("parent_id", F.lit("")) == "")).orderBy("start_line", "id")


def members(symbols: DataFrame, parent_id: str) -> DataFrame:
    return symbols.where(F.col("parent_id") == parent_id).orderBy("start_line", "id")


def lookup(symbols: DataFrame, symbol_id: str) -> DataFrame:
    """The symbol of an id: one row or none."""
    return symbols.where(F.col("id") == symbol_id).limit(1)


def search(symbols: DataFrame, query: str, kind: str = "", most: int = 200) -> DataFrame:
    """Symbols whose name holds ``query`` in either case: exact names first, then prefixes; at most ``most``."""
    name, q = F.lower("name"), query.lower()
    rank = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    got = symbols.where(name.contains(q) & (F.lit(True) if not kind else F.col("kind") == kind))
    return got.withColumn("rank", rank).orderBy("rank", "name", "id").limit(most)


def full_graph(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All symbols and all edges, in order."""
    return symbols.orderBy("id"), edges.orderBy("source", "target", "kind")
