"""Registered queries over traversal, clustering, questions, federation, envelopes and life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cluster, envelope, federation, lifecycle, prs, question, symbols
from ..operators import documents as D
from ..operators import entity as E
from ..operators import traverse as V
from ..sources import manifests, notes
from ..sources.tables import edges, key, nodes, table
from .catalog import _sql, register

_TREE = "relation IN ('in_region', 'located_in', 'placed_by')"


@register(_sql("SELECT CAST(i - 1 AS BIGINT) AS step, p[i] AS id, CASE WHEN i > 1 THEN r[i - 1] END AS relations FROM (SELECT p, r, unnest(range(1, len(p) + 1)) AS i FROM w WHERE p[-1] = (SELECT id FROM goal))", f"t AS (SELECT DISTINCT src AS a, dst AS b, relation FROM edges WHERE {_TREE} UNION SELECT dst, src, relation FROM edges WHERE {_TREE}), w AS (SELECT ['c:7'] AS p, []::VARCHAR[] AS r UNION ALL SELECT list_append(p, b), list_append(r, relation) FROM w JOIN t ON a = p[-1] WHERE NOT list_contains(p, b)), goal AS (SELECT max('c:'||c_custkey) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7))", True))
def shortest_path(spark, sf):
    """Between two customers of a region, over the relations that form a tree there."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    region = c.where("c_custkey = 7").select("n_regionkey")
    goal = c.join(F.broadcast(region), "n_regionkey").agg(F.max(key("c", "c_custkey"))).first()[0]
    return V.shortest_path(edges(spark, sf).where(_TREE), "c:7", goal, directed=False)


#: Levels of shortest paths between all nodes over all edges, both ways: how many lead from p to v, then what of them goes on through v.
_WALKS = """e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
ids AS MATERIALIZED (SELECT id, CAST(row_number() OVER () AS INTEGER) AS x FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)),
t AS MATERIALIZED (SELECT s.x AS a, d.x AS b FROM e JOIN ids s ON s.id = src JOIN ids d ON d.id = dst UNION SELECT d.x, s.x FROM e JOIN ids s ON s.id = src JOIN ids d ON d.id = dst),
w AS (SELECT x AS p, x AS v, 0 AS d, 1.0::DOUBLE AS n, true AS front FROM ids UNION ALL
 (WITH step AS (SELECT w.p, t.b AS v, w.d + 1 AS d, sum(w.n) AS n FROM w JOIN t ON t.a = w.v WHERE w.front GROUP BY ALL)
  SELECT p, v, d, n, true FROM step ANTI JOIN w USING (p, v) UNION ALL SELECT p, v, d, n, false FROM w WHERE front)),
f AS MATERIALIZED (SELECT p, v, d, n FROM w WHERE front),
g AS (SELECT p, v, d, n, 0.0::DOUBLE AS held FROM f WHERE d = (SELECT max(d) FROM f) UNION ALL
 (WITH more AS (SELECT g.p, t.b AS v, sum((1 + g.held) / g.n) AS h FROM g JOIN t ON t.a = g.v GROUP BY ALL)
  SELECT f.p, f.v, f.d, f.n, f.n * coalesce(h, 0) FROM f LEFT JOIN more ON more.p = f.p AND more.v = f.v WHERE f.d = (SELECT max(d) - 1 FROM g)))"""


@register(_sql("SELECT id, sum(held) AS score FROM g JOIN ids ON x = v WHERE p <> v GROUP BY id HAVING sum(held) > 0", _WALKS, True))
def betweenness_nodes(spark, sf):
    """Of all nodes, by the shortest paths between all of them over all relations."""
    e = edges(spark, sf)
    return V.betweenness(e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())[0].where("score > 0")


@register(_sql("SELECT least(s.id, d.id) AS src, greatest(s.id, d.id) AS dst, score FROM (SELECT least(u.v, l.v) AS a, greatest(u.v, l.v) AS b, sum(u.n / l.n * (1 + l.held)) AS score FROM g u JOIN t ON t.a = u.v JOIN g l ON l.p = u.p AND l.v = t.b AND l.d = u.d + 1 GROUP BY ALL) r JOIN ids s ON s.x = r.a JOIN ids d ON d.x = r.b", _WALKS.replace("g AS (", "g AS MATERIALIZED ("), True))
def betweenness_edges(spark, sf):
    """Of all edges, by the shortest paths between all nodes over all relations."""
    e = edges(spark, sf)
    return V.betweenness(e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())[1]


@register()
def dfs_nodes(spark, sf):
    e = edges(spark, sf).where("relation <> 'contains'")
    return V.dfs(e, nodes(spark, sf).where("id in ('o:7', 'c:3')").select("id"), 3)


@register()
def louvain(spark, sf):
    """Communities of all nodes by all relations."""
    return cluster.cluster(nodes(spark, sf), edges(spark, sf))


@register()
def resolve_entities(spark, sf):
    """Documents as concepts, named by how their text begins."""
    own = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 60).alias("label"), F.lit("concept").alias("file_type"), F.col("source").alias("source_file"), F.lit(None).cast("long").alias("community"))
    return E.resolve(own)


@register()
def query_graph(spark, sf):
    return question.query_graph(nodes(spark, sf), edges(spark, sf).where("relation <> 'contains'"), "which nations does Customer#000000011 trade with?", depth=2)


@register()
def question_seeds(spark, sf):
    return question.seeds(nodes(spark, sf), edges(spark, sf), "how does a cold widget depend on supplier#000000003")


@register(_sql("SELECT n.*, (SELECT count(*) FROM edges WHERE src = 'n:3') AS n_out, (SELECT count(*) FROM edges WHERE dst = 'n:3') AS n_in, (SELECT count(*) FROM edges WHERE src = 'n:3') + (SELECT count(*) FROM edges WHERE dst = 'n:3') AS degree FROM nodes n WHERE id = 'n:3'"))
def node_detail(spark, sf):
    return question.node_detail(nodes(spark, sf), edges(spark, sf), "n:3")


@register(_sql('SELECT f.src, f.dst, relation, s.label AS "from", d.label AS "to" FROM (SELECT DISTINCT src, dst, relation FROM edges WHERE src = \'n:3\' OR dst = \'n:3\' ORDER BY src, dst, relation LIMIT 50) f JOIN nodes s ON s.id = f.src JOIN nodes d ON d.id = f.dst'))
def graph_context(spark, sf):
    return question.neighbourhood(nodes(spark, sf), edges(spark, sf), "n:3", 50)


@register("WITH w AS (SELECT DISTINCT c_mktsegment || '.tbl' AS path FROM customer UNION SELECT 'orders/1-URGENT.tbl' UNION SELECT 'x/customer/BUILDING.tbl'), k AS (SELECT DISTINCT 'customer/' || c_mktsegment || '.tbl' AS path FROM customer UNION SELECT DISTINCT 'orders/' || o_orderpriority || '.tbl' FROM orders) SELECT w.path AS wanted, k.path AS known FROM w JOIN k ON w.path = k.path OR ends_with(w.path, '/' || k.path) OR ends_with(k.path, '/' || w.path)")
def matched_files(spark, sf):
    wanted = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit(".tbl")).alias("path")).distinct()
    wanted = wanted.unionByName(spark.createDataFrame([("orders/1-URGENT.tbl",), ("x/customer/BUILDING.tbl",)], "path string"))
    known = nodes(spark, sf).where("source_file like 'customer/%' or source_file like 'orders/%'").select(F.col("source_file").alias("path"))
    return question.matched_files(wanted, known)


@register("SELECT 'p:'||p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#3' AND p_size % 2 = 0")
def symbols_in_file(spark, sf):
    p = table(spark, sf, "part").select(key("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.when(F.col("p_size") % 2 == 0, "").otherwise("t").alias("parent_id"), F.col("p_size").alias("start_line"))
    return symbols.in_file(p, "Brand#3").select("id", "name")


@register("SELECT DISTINCT path, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth FROM (SELECT array_to_string(string_split(f, '/')[1:i], '/') AS path FROM (SELECT f, unnest(range(0, len(string_split(f, '/')))) AS i FROM (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS f FROM documents)))")
def directory_tree(spark, sf):
    return D.directories(table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")))


@register("SELECT doc_id, round(floor(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) * 100 / 75.0::DOUBLE) / greatest(1, floor(length(text) / 4.0::DOUBLE)), 1) AS ratio FROM documents")
def token_reduction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.token_reduction(F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.length("text")).alias("ratio"))


@register()
def pack_documents(spark, sf):
    d = table(spark, sf, "documents")
    return D.pack(d.select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"), (F.col("doc_id") % 7 == 0).alias("is_image")), 20_000)


@register("WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'o:'||l_orderkey AS src, 'p:'||l_partkey AS dst, l_returnflag AS type, l_linestatus AS description FROM lineitem) SELECT ord, CASE WHEN dst NOT IN (SELECT 'p:'||p_partkey FROM part WHERE p_size > 5) THEN 'endpoint_not_accepted' WHEN ord > min(ord) OVER (PARTITION BY src, dst, type, description) THEN 'duplicate' END AS reason FROM r")
def relationship_rejects(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("description"))
    known = table(spark, sf, "orders").select(key("o", "o_orderkey").alias("id")).unionByName(table(spark, sf, "part").where("p_size > 5").select(key("p", "p_partkey").alias("id")))
    return envelope.relationship_rejects(rows, known)


@register("SELECT left(sha256(concat_ws(chr(0), 'w', 's', 'p:'||p_partkey)), 32) AS node_id, trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '_') AS type, p_brand || chr(10) || chr(10) || p_name AS text FROM part")
def envelope_nodes(spark, sf):
    p = table(spark, sf, "part").select(key("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"), F.col("p_brand").alias("signature"), F.col("p_name").alias("doc"), F.concat(F.col("p_brand"), F.lit(" ")).alias("description"), F.lit("").alias("source_location"))
    e = edges(spark, sf).limit(0)
    return envelope.envelope(p, e, "w", "s")["nodes"].select("node_id", "type", "text")


@register(_sql("SELECT relation, count(*) AS n FROM (SELECT DISTINCT * FROM edges) GROUP BY relation"))
def promoted_edges(spark, sf):
    return federation.promote(edges(spark, sf)).groupBy("relation").agg(F.countDistinct("src", "dst", "edge_key").alias("n"))


@register("SELECT id, label FROM (SELECT 'x:' || p_size AS id, min(p_name) AS label FROM part WHERE p_size % 2 = 0 GROUP BY p_size) UNION ALL SELECT 'x:' || p_size, 'second' FROM part WHERE p_size % 2 = 1 GROUP BY p_size")
def merged_chunks(spark, sf):
    p = table(spark, sf, "part")
    first = p.where("p_size % 2 = 0").groupBy(key("x", "p_size").alias("id")).agg(F.min("p_name").alias("label"))
    second = p.select(key("x", "p_size").alias("id"), F.lit("second").alias("label")).distinct()
    return federation.merge_chunks([first, second])


@register(_sql("SELECT * FROM (SELECT 'unknown_source' AS problem, count(*) FILTER (src NOT IN (SELECT id FROM k)) AS n FROM edges UNION ALL SELECT 'unknown_target', count(*) FILTER (dst NOT IN (SELECT id FROM k)) FROM edges UNION ALL SELECT 'too_many_nodes', greatest((SELECT count(*) FROM k) - 10000, 0) UNION ALL SELECT 'too_many_edges', greatest((SELECT count(*) FROM edges) - 100000, 0)) WHERE n > 0", "k AS (SELECT id FROM nodes WHERE file_type = 'code' AND id NOT LIKE 'c:1%')"))
def fragment_problems(spark, sf):
    return federation.problems(nodes(spark, sf).where("file_type = 'code' and id not like 'c:1%'"), edges(spark, sf))


_RULES = "# rules\n*.tbl\n!customer/*.tbl\npart/\n!part/Brand#1.tbl\n"


@register("""WITH p AS (SELECT p_partkey, p_brand, 'part/'||p_brand||'/'||p_size||'/p'||p_partkey||'.tbl' AS path, right(p_brand, 1) AS d FROM part)
SELECT path FROM p WHERE p_partkey::VARCHAR LIKE d||'%' AND p_partkey::VARCHAR NOT LIKE d||d||'%' OR path LIKE 'part/'||p_brand||'/'||d||'/%'""")
def ignored_by_folder(spark, sf):
    """Every brand's folder has an ignore file of its own: parts by the brand's last digit, with an exception, and a folder."""
    own = table(spark, sf, "part").select("p_brand", F.concat(F.lit("part/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".tbl")).alias("path"))
    digit = F.right("p_brand", F.lit(1))
    files = own.select("p_brand").distinct().select(F.concat(F.lit("part/"), "p_brand", F.lit("/.gitignore")).alias("path"), F.concat(F.lit("# parts\np"), digit, F.lit("*.tbl\n!p"), digit, digit, F.lit("*.tbl\n/"), digit, F.lit("/\n")).alias("text"))
    return manifests.ignored(own, manifests.rules_of(files))


@register(_sql("SELECT DISTINCT source_file AS path, NOT (source_file LIKE 'customer/%' OR source_file = 'nation/') AS ignored FROM nodes"))
def ignored_files(spark, sf):
    return nodes(spark, sf).select(F.col("source_file").alias("path")).distinct().select("path", manifests.is_ignored(F.col("path"), manifests.ignore_rules(_RULES)).alias("ignored"))


@register("SELECT doc_id AS id, doc_id % 10 IN (3, 4) AS stale FROM documents")
def stale_entries(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))
    now = d.where("id % 10 <> 4").select("path", F.when(F.col("id") % 10 == 3, "new").otherwise(F.col("hash")).alias("hash"))
    return lifecycle.stale(d, now)


@register("SELECT doc_id, sha256(text || chr(0) || source || '/' || doc_id || '.txt') AS content_hash FROM documents WHERE doc_id % 3 <> 1")
def cache_misses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    own = lifecycle.keyed(d, "extract", "1")
    return lifecycle.cached(own, own.where("doc_id % 3 = 1").select(*lifecycle.KEY))[1].select("doc_id", "content_hash")


@register("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, len(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/')) AS stems FROM pages")
def path_forms(spark, sf):
    path = X.norm_path(F.regexp_replace(F.regexp_replace("url", "^https?://", "./"), r"[?#].*$", ""))
    return table(spark, sf, "pages").select("page_id", path.alias("path"), F.size(X.path_stems(path)).cast("long").alias("stems"))


@register("SELECT event_id, epoch_us(ts) AS at FROM events")
def parsed_times(spark, sf):
    """Times as text, some with a Z, read back."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf, "events").select("event_id", F.unix_micros(X.parse_time(F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("+00:00"))))).alias("at"))


@register("SELECT source AS source_id, CASE WHEN source = (SELECT min(source) FROM documents) THEN false ELSE true END AS ok, CASE WHEN count(*) FILTER (doc_id % 2 = 1) = 0 THEN 'keep' ELSE 'replace' END AS action FROM documents WHERE source IS NOT NULL GROUP BY source")
def publish_report(spark, sf):
    """Sources republished with changed rows; one of them promises a row too many and stays as it was."""
    d = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("source_id"), "doc_id", "lang")
    new = d.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "xx").otherwise(F.col("lang")))
    first = d.agg(F.min("source_id")).first()[0]
    expected = new.groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", (F.col("n") + (F.col("source_id") == first).cast("int")).alias("expected"))
    return lifecycle.run_source(d, new, expected)[1].select("source_id", "action", "ok")


def _markdown_sql() -> str:
    quote = lambda x: x.replace("'", "''")
    out = f"regexp_replace(html, '{X.LINK}', '[\\2](\\1)', 'g')"
    for rx, to in X.MARKDOWN:
        to = to.replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{quote(rx)}', '{to}', 'g')"
    return f"regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g')"


@register(f"SELECT page_id, 'web' AS kind, md5('---' || chr(10) || 'source_url: \"' || url || '\"' || chr(10) || 'title: \"' || replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\', '\\\\'), '\"', '\\\"') || '\"' || chr(10) || 'type: web' || chr(10) || '---' || chr(10) || chr(10) || {_markdown_sql()}) AS text FROM pages")
def html_to_markdown(spark, sf):
    return notes.page_documents(table(spark, sf, "pages")).withColumn("text", F.md5("text"))


@register(_sql("SELECT number, count(*) AS n_nodes, list_sort(list(DISTINCT community) FILTER (community IS NOT NULL)) AS communities FROM (SELECT DISTINCT number, source_file FROM (SELECT c_nationkey AS number, c_mktsegment || '.tbl' AS path FROM customer UNION SELECT 100, 'orders/1-URGENT.tbl') f JOIN nodes ON source_file = path OR ends_with(source_file, '/' || path) OR ends_with(path, '/' || source_file)) JOIN nodes USING (source_file) GROUP BY number"))
def pr_impact_paths(spark, sf):
    files = table(spark, sf, "customer").select(F.col("c_nationkey").alias("number"), F.concat("c_mktsegment", F.lit(".tbl")).alias("path")).distinct()
    files = files.unionByName(spark.createDataFrame([(100, "orders/1-URGENT.tbl")], "number int, path string"))
    return prs.impact(files, nodes(spark, sf))
