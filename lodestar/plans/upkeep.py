"""Registered queries over ``operators.upkeep``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import traverse as V
from ..operators import upkeep as U
from ..sources.tables import edges, key, nodes, table
from .catalog import FILE, _sql, register


@register(_sql("SELECT src, dst, relation, context FROM edges WHERE context = 'F'"))
def context_edges(spark, sf):
    return U.by_context(edges(spark, sf), ["F"]).select("src", "dst", "relation", "context")


@register(_sql(f"SELECT id, NOT ({FILE}) AS is_concept, label = string_split(source_file, '/')[-1] AS is_file, CASE WHEN source_file LIKE '%.tbl' THEN 'tbl' ELSE '' END AS suffix FROM nodes"))
def node_predicates(spark, sf):
    path = F.col("source_file")
    return nodes(spark, sf).select("id", G.is_concept(path).alias("is_concept"), (F.col("label") == G.last_segment(path)).alias("is_file"), F.regexp_extract(path, r"\.([a-z]+)$", 1).alias("suffix"))


_TWINS = "n AS (SELECT 'p:'||p_partkey AS id, p_brand AS source_file, p_type AS label, CASE WHEN p_size <= 10 THEN 'ast' ELSE 'semantic' END AS origin FROM part), g AS (SELECT n.id AS old, a.new FROM n JOIN (SELECT source_file, label, min(id) AS new FROM n WHERE origin = 'ast' GROUP BY ALL HAVING count(*) = 1) a USING (source_file, label) WHERE origin <> 'ast')"


def _twins(spark, sf):
    p = table(spark, sf, "part")
    return U.ghosts(p.select(key("p", "p_partkey").alias("id"), F.col("p_brand").alias("source_file"), F.col("p_type").alias("label"), F.when(F.col("p_size") <= 10, "ast").otherwise("semantic").alias("origin")))


@register(f"WITH {_TWINS} SELECT old, new FROM g")
def ghost_merge(spark, sf):
    return _twins(spark, sf)


@register(f"WITH {_TWINS}, e AS (SELECT 'o:'||l_orderkey AS src, 'p:'||l_partkey AS dst FROM lineitem) SELECT src, coalesce(new, dst) AS dst, count(*) AS n FROM e LEFT JOIN g ON old = dst GROUP BY ALL")
def ghost_edges(spark, sf):
    e = table(spark, sf, "lineitem").select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"))
    return U.repoint(e, _twins(spark, sf)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@register("WITH d AS (SELECT p_brand||'.'||p_size AS label, 'p:'||p_partkey AS id FROM part) SELECT 'x:'||label AS old, min(id) AS new FROM d GROUP BY label HAVING count(*) = 1")
def stub_rewire(spark, sf):
    p = table(spark, sf, "part")
    label = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    known = p.select(key("p", "p_partkey").alias("id"), label.alias("label"), F.lit("part.tbl").alias("source_file"))
    stubs = p.select(F.concat(F.lit("x:"), label).alias("id"), label.alias("label"), F.lit("").alias("source_file")).distinct()
    return U.stub_targets(known.unionByName(stubs))


_SUFFIX = "CASE l_returnflag WHEN 'A' THEN 'py' WHEN 'N' THEN 'ts' ELSE 'zz' END"


@register(f"SELECT src_suffix, dst_suffix, relation, count(*) AS n FROM (SELECT {_SUFFIX} AS src_suffix, CASE l_linestatus WHEN 'O' THEN 'js' ELSE 'py' END AS dst_suffix, CASE WHEN l_linenumber % 2 = 0 THEN 'calls' ELSE 'imports' END AS relation FROM lineitem) WHERE CASE WHEN relation = 'calls' THEN (src_suffix = 'py') = (dst_suffix = 'py') AND src_suffix <> 'zz' ELSE src_suffix = 'zz' OR (src_suffix = 'py') = (dst_suffix = 'py') END GROUP BY ALL")
def cross_language_guard(spark, sf):
    flag = F.when(F.col("l_returnflag") == "A", "py").when(F.col("l_returnflag") == "N", "ts").otherwise("zz")
    e = table(spark, sf, "lineitem").select(flag.alias("src_suffix"), F.when(F.col("l_linestatus") == "O", "js").otherwise("py").alias("dst_suffix"), F.when(F.col("l_linenumber") % 2 == 0, "calls").otherwise("imports").alias("relation"), F.lit("INFERRED").alias("confidence"))
    return U.language_guard(e).groupBy("src_suffix", "dst_suffix", "relation").agg(F.count("*").alias("n"))


@register("""WITH p AS (SELECT DISTINCT o_orderpriority||'/'||o_orderstatus||'/'||(o_custkey % 40)||'.tbl' AS path FROM orders), e AS (SELECT path, k, array_to_string(list_slice(string_split(path, '/'), 4 - k, 3), '/') AS label FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM p)),
o AS (SELECT label, min(path) AS path, min(k) AS k FROM e GROUP BY label HAVING count(*) = 1) SELECT path, min_by(label, k) AS label FROM o GROUP BY path""")
def short_labels(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat((F.col("o_custkey") % 40).cast("string"), F.lit(".tbl"))
    return U.short_labels(o.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus", name).alias("path")).distinct())


@register("SELECT id, CASE WHEN k = 0 THEN name ELSE name||'_'||k END AS name FROM (SELECT id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) - 1 AS k FROM (SELECT 'p:'||p_partkey AS id, trim(regexp_replace(p_type, '[/#:]', '', 'g')) AS name FROM part))")
def note_names(spark, sf):
    return U.note_names(table(spark, sf, "part").select(key("p", "p_partkey").alias("id"), F.col("p_type").alias("label")))


@register(_sql("SELECT id, depth, line FROM (SELECT id, depth, line, sum(length(line) + 1) OVER (ORDER BY depth, degree DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT w.id, CAST(min(d) AS INTEGER) AS depth, any_value(degree) AS degree, any_value(label)||' ['||any_value(source_file)||']' AS line FROM w JOIN nodes ON nodes.id = w.id JOIN deg ON deg.id = w.id GROUP BY w.id)) WHERE upto <= 600", "st AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)), w AS (SELECT 'n:3' AS id, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN st ON src = id WHERE d < 2)", True))
def rendered_subgraph(spark, sf):
    """What a question about one node shows: nearest first, then by degree, until the budget of 200 tokens is used."""
    n, e = nodes(spark, sf), edges(spark, sf)
    near = V.bfs(e, spark.createDataFrame([("n:3",)], "id string"), 2, directed=False)
    lines = near.join(n, "id").join(G.degree(e), "id").select("id", "depth", "degree", F.concat("label", F.lit(" ["), "source_file", F.lit("]")).alias("line"))
    return U.within_budget(lines, [F.col("depth"), F.desc("degree"), F.col("id")], 200).select("id", "depth", "line")


@register(_sql("SELECT community, confidence, count(*) AS n FROM (SELECT confidence, unnest(list_distinct([s.community, d.community])) AS community FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst) WHERE community IS NOT NULL GROUP BY ALL"))
def community_articles(spark, sf):
    return U.confidence_split(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT community, string_agg(label, '|' ORDER BY rn) AS labels FROM (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY id) AS rn FROM nodes WHERE community IS NOT NULL) WHERE rn <= 4 GROUP BY community"))
def community_label_lists(spark, sf):
    return U.label_lists(nodes(spark, sf))


@register(_sql("SELECT src, dst, relation, round(confidence_score + 2 + CASE relation WHEN 'contains' THEN -0.2::DOUBLE ELSE 0 END, 6) AS score FROM edges WHERE confidence = 'EXTRACTED'"))
def diagram_scores(spark, sf):
    return U.edge_scores(edges(spark, sf))


@register(_sql("SELECT id FROM nodes WHERE len(list_filter(['cus', 'ust', 'sto', 'tom', 'ome', 'mer', 'er#', 'r#0'], lambda g: contains(lower(label), g))) = 8"))
def trigram_candidates(spark, sf):
    return U.gram_candidates(U.postings(nodes(spark, sf), F.col("label"), U.grams_of("Customer#0")), "Customer#0")


@register("SELECT count(*) AS lost, count(*) FILTER (o_orderpriority NOT LIKE '1%') AS unexplained, count(*) FILTER (o_orderpriority NOT LIKE '1%') = 0 AS allowed FROM orders WHERE o_orderstatus = 'P'")
def shrink_guard(spark, sf):
    o = table(spark, sf, "orders").select(key("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_file"), "o_orderstatus")
    return U.shrinkage(o, o.where("o_orderstatus <> 'P'"), o.where("source_file like '1%'"))


@register("SELECT count(*) FILTER (o_orderstatus = 'P') AS only_a, count(*) FILTER (o_orderstatus = 'F') AS only_b, false AS same FROM orders")
def topology_compare(spark, sf):
    e = table(spark, sf, "orders").select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"), "o_orderstatus")
    return U.same_topology(e.where("o_orderstatus <> 'F'"), e.where("o_orderstatus <> 'P'"), ["src", "dst"])


@register("SELECT doc_id, len(m) > 0 AND len(list_filter(m, lambda x: contains(lower(text), x))) = 0 AS unverified FROM (SELECT doc_id, d.text, regexp_extract_all(lower(b.text), '[a-z_][a-z0-9_]{3,}') AS m FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark))")
def evidence_binding(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("label"))
    return table(spark, sf, "documents").join(b, F.col("doc_id") % b.count() == F.col("item_id")).select("doc_id", U.unverified(F.col("label"), F.col("text")).alias("unverified"))


@register("SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(2, 5)) AS i FROM documents) WHERE i <= len(l)")
def source_lines(spark, sf):
    return U.line_range(table(spark, sf, "documents"), 2, 4)


@register("SELECT s_suppkey, 'git.example.org/team/' || replace(lower(s_name), '#', '-') AS url FROM supplier")
def git_urls(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.replace("s_name", F.lit("#"), F.lit("-"))
    k = F.col("s_suppkey") % 3
    form = F.when(k == 0, F.concat(F.lit("git@git.example.org:team/"), name, F.lit(".git"))).when(k == 1, F.concat(F.lit("ssh://git@git.example.org:22/team/"), name)).otherwise(F.concat(F.lit("https://Git.example.org/team/"), name, F.lit(".git/")))
    return s.select("s_suppkey", U.git_url(form).alias("url"))


@register(_sql("SELECT DISTINCT 'out' AS direction, dst AS other, relation FROM edges WHERE src = 'n:3' AND contains(relation, 'in') UNION ALL SELECT DISTINCT 'in', src, relation FROM edges WHERE dst = 'n:3' AND contains(relation, 'in')"))
def neighbour_edges(spark, sf):
    return U.neighbours(edges(spark, sf), "n:3", "in")


@register("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_linestatus FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n, substr(sha256(l_orderkey||chr(31)||l_partkey), 1, 16) AS a, substr(sha256(l_returnflag||chr(31)||l_linestatus), 1, 8) AS b FROM r)
SELECT CASE WHEN n = 1 THEN a ELSE a||'-'||b END AS key, l_orderkey, l_partkey, l_returnflag, l_linestatus FROM k""")
def parallel_keys(spark, sf):
    return U.parallel_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], ["l_returnflag", "l_linestatus"])


@register(f"WITH {_TWINS}, m AS (SELECT DISTINCT l_orderkey, 'p:'||l_partkey AS member FROM lineitem), x AS (SELECT l_orderkey, coalesce(new, member) AS m, min(member) AS place FROM m LEFT JOIN g ON old = member GROUP BY ALL) SELECT 'o:'||l_orderkey AS id, string_agg(m, ',' ORDER BY place) AS members FROM x GROUP BY l_orderkey")
def hyperedge_remap(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy(key("o", "l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(key("p", "l_partkey"))).alias("members"))
    return U.remap_members(groups, _twins(spark, sf)).select("id", F.array_join("members", ",").alias("members"))


@register("SELECT page_id, md5(replace(replace(replace(replace(replace(substr(regexp_replace(html, '[\\x00-\\x1F\\x7F]', '', 'g'), 1, 256), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS label_md5 FROM pages")
def sanitized_labels(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(U.sanitized(F.col("html"))).alias("label_md5"))


@register("""WITH r AS (SELECT 'c:'||o_custkey AS id, o_orderstatus AS source_file, o_orderstatus = 'F' AS definer, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS lifecycle, o_orderpriority AS label, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT definer, lifecycle, length(label), label, seq) AS rn FROM r), f AS (SELECT id, source_file, min_by(price, rn) FILTER (price IS NOT NULL) AS price FROM k GROUP BY ALL)
SELECT k.id, k.source_file, label, f.price FROM k JOIN f ON f.id = k.id AND f.source_file = k.source_file WHERE rn = 1""")
def collision_survivors(spark, sf):
    status = F.col("o_orderstatus")
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price")
    rows = table(spark, sf, "orders").select(key("c", "o_custkey").alias("id"), status.alias("source_file"), (status == "F").alias("definer"), F.when(status == "P", 1).otherwise(0).alias("lifecycle"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq"), price)
    return U.survivors(rows, ["price"])


@register("SELECT 'd'||doc_id AS old, 'd'||doc_id||'_doc' AS new FROM documents JOIN labels USING (doc_id) GROUP BY doc_id")
def doc_twins(spark, sf):
    bare = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    twin = table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_doc")).alias("id"))
    return U.doc_twins(bare.unionByName(twin))


_PLACE = "CASE WHEN {k} % 4 = 0 THEN 'tests/' ELSE 'src/' END || ({k} % 3) || '/' || ({k} % 2) || '/x.py'"


@register(f"""WITH c AS (SELECT 'o:'||l_orderkey AS call, {_PLACE.format(k='l_orderkey')} AS cf, 'p:'||l_partkey AS target, {_PLACE.format(k='l_partkey')} AS tf FROM lineitem),
n AS (SELECT call, target, CASE WHEN string_split(cf, '/')[1] <> string_split(tf, '/')[1] THEN 0 WHEN string_split(cf, '/')[2] <> string_split(tf, '/')[2] THEN 1 WHEN string_split(cf, '/')[3] <> string_split(tf, '/')[3] THEN 2 ELSE 3 END AS near FROM c WHERE cf LIKE 'tests/%' OR tf NOT LIKE 'tests/%'),
m AS (SELECT *, max(near) OVER (PARTITION BY call) AS top FROM n) SELECT call, min(target) AS target FROM m WHERE near = top GROUP BY call HAVING count(DISTINCT target) = 1""")
def tie_break(spark, sf):
    def place(c):
        n = F.col(c)
        return F.concat(F.when(n % 4 == 0, "tests/").otherwise("src/"), (n % 3).cast("string"), F.lit("/"), (n % 2).cast("string"), F.lit("/x.py"))

    return U.tie_break(table(spark, sf, "lineitem").select(key("o", "l_orderkey").alias("call"), place("l_orderkey").alias("call_file"), key("p", "l_partkey").alias("target"), place("l_partkey").alias("target_file")))


@register(_sql("SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT id FROM h) OR dst IN (SELECT id FROM h) ORDER BY src, dst, relation LIMIT 50", "h AS (SELECT 's:'||s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, 's:'||s_suppkey LIMIT 3)"))
def entity_expansion(spark, sf):
    return U.expand(table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("id"), F.col("s_acctbal").alias("score")), edges(spark, sf))


@register("SELECT CAST(doc_id AS VARCHAR) AS id, CASE quality WHEN 1 THEN 'preferred' ELSE 'avoid' END AS status, CAST(quality AS DOUBLE) AS score, doc_id % 5 = 0 AS stale FROM labels JOIN documents USING (doc_id)")
def learning_overlay(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("hash"))
    seen = d.select(F.col("id").alias("node"), F.when(F.col("id").cast("long") % 5 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("seen_hash"))
    told = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("node"), F.when(F.col("quality") == 1, "preferred").otherwise("avoid").alias("status"), F.col("quality").cast("double").alias("score"))
    return U.overlay(told.join(seen, "node"), d)
