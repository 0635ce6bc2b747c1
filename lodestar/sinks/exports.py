"""Graph exports. Rows are rendered on executors as text; each export is one folder of text files, in a stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def sanitize(label: Column) -> Column:
    """Without control characters, at most 256 characters, HTML escaped."""
    return _xml(F.substring(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""), 1, 256))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, key, line``: a MERGE per node (part 0), then one per edge (part 1); sort by part and key."""
    label = F.initcap(F.regexp_replace(F.col("file_type"), "[^A-Za-z0-9_]", "_"))
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: "), _quoted(F.col("id")), F.lit("}) SET n.label = "), _quoted(F.col("label")), F.lit(";")).alias("line"))
    kind = F.upper(F.regexp_replace(F.col("relation"), "[^A-Za-z0-9_]", "_"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws("\t", "src", "dst", "relation").alias("key"), F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, key, line`` of a GraphML file: header, nodes, edges, footer."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="label">'), _xml(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\t", "src", "dst", "relation").alias("key"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="relation">'), _xml(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return frame.unionByName(n).unionByName(e)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, key, line``: one JSON object per node (part 0) and edge (part 1), nulls left out."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.to_json(F.struct(*nodes.columns)).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws("\t", "src", "dst", "relation").alias("key"), F.to_json(F.struct(*edges.columns)).alias("line"))
    return n.unionByName(e)


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``name, body``: a linked note per node; names that differ only in case get a number by order of id."""
    from pyspark.sql import Window

    stem = F.regexp_replace("label", r'[\\/:*?"<>|#^\[\]]', "_")
    named = nodes.select("id", "label", stem.alias("stem"), F.row_number().over(Window.partitionBy(F.lower(stem)).orderBy("id")).alias("k"))
    named = named.select("id", "label", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", "k")).alias("name"))
    to = named.select(F.col("id").alias("dst"), F.col("name").alias("to"))
    links = edges.select("src", "dst", "relation").distinct().join(to, "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("relation"), F.lit(" [["), F.col("to"), F.lit("]]")))).alias("l"))
    return named.join(links, "id", "left").select("name", F.concat(F.lit("# "), "label", F.lit("\n\n"), F.coalesce(F.array_join("l", "\n"), F.lit(""))).alias("body"))


def write(rendered: DataFrame, path: str) -> None:
    """Writes lines in order of part and key."""
    rendered.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)
