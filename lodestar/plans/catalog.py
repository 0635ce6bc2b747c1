"""The registered queries over the test tables, each with its equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.store import fresh, settle
from ..operators import community as C
from ..operators import cluster, federation, index, rag, symbols, vectors
from ..operators import documents as D
from ..operators import entity as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import traverse as V
from ..sources import corpus
from ..sources.tables import edges, key, nodes, table
from ..streaming.debounce import batch_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GRAPH = """
nodes AS (
 SELECT 'r:'||r_regionkey AS id, r_name AS label, 'code' AS file_type, 'region.tbl' AS source_file, CAST(NULL AS BIGINT) AS community FROM region
 UNION ALL SELECT 'n:'||n_nationkey, n_name, 'code', 'nation/', n_nationkey FROM nation
 UNION ALL SELECT 'c:'||c_custkey, c_name, 'code', 'customer/'||c_mktsegment||'.tbl', c_nationkey FROM customer
 UNION ALL SELECT 's:'||s_suppkey, s_name, 'code', 'supplier.tbl', s_nationkey FROM supplier
 UNION ALL SELECT 'p:'||p_partkey, p_name, 'document', 'part/'||p_brand||'.tbl', p_size % 25 FROM part
 UNION ALL SELECT 'o:'||o_orderkey, 'Order#'||o_orderkey, 'code', 'orders/'||o_orderpriority||'.tbl', o_custkey % 25 FROM orders),
edges0 AS (
 SELECT 'n:'||n_nationkey AS src, 'r:'||n_regionkey AS dst, 'in_region' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight, NULL::VARCHAR AS context FROM nation
 UNION ALL SELECT 'c:'||c_custkey, 'n:'||c_nationkey, 'located_in', 'EXTRACTED', 1.0, NULL FROM customer
 UNION ALL SELECT 's:'||s_suppkey, 'n:'||s_nationkey, 'located_in', 'EXTRACTED', 1.0, NULL FROM supplier
 UNION ALL SELECT 'o:'||o_orderkey, 'c:'||o_custkey, 'placed_by', CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, 1.0, NULL FROM orders
 UNION ALL SELECT 'o:'||l_orderkey, 'p:'||l_partkey, 'contains', CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, l_quantity, NULL FROM lineitem
 UNION ALL SELECT 'p:'||l_partkey, 's:'||l_suppkey, 'supplied_by', 'EXTRACTED', l_quantity, l_linestatus FROM lineitem),
edges AS (SELECT *, CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END AS confidence_score FROM edges0),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"""
FILE = "NOT (source_file = '' OR string_split(source_file, '/')[-1] NOT LIKE '%.%')"
REAL = FILE + " AND NOT (label = string_split(source_file, '/')[-1] OR (label LIKE '.%' AND label LIKE '%()') OR (label LIKE '%()' AND degree <= 1))"


def _sql(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH}{', ' + extra if extra else ''} {body}"


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- relational core


@register(_sql("SELECT id, degree FROM deg"))
def node_degree(spark, sf):
    return G.degree(edges(spark, sf))


@register(_sql(f"SELECT id, label, degree FROM nodes JOIN deg USING (id) WHERE {REAL} ORDER BY degree DESC, id LIMIT 10"))
def god_nodes(spark, sf):
    return G.god_nodes(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT community) FROM nodes) AS n_communities, count(*) AS n_edges, " + ", ".join(f"CAST(round(100.0 * count(*) FILTER (confidence = '{c}') / count(*)) AS BIGINT) AS pct_{c.lower()}" for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")) + " FROM edges"))
def graph_stats(spark, sf):
    return G.stats(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT relation, confidence, count(*) AS n, round(avg(confidence_score) FILTER (confidence = 'INFERRED'), 2) AS avg_inferred FROM edges GROUP BY ALL"))
def confidence_audit(spark, sf):
    return G.audit(edges(spark, sf))


@register(_sql("SELECT file_type, source_file, count(*) AS n FROM nodes GROUP BY ALL"))
def language_counts(spark, sf):
    return nodes(spark, sf).groupBy("file_type", "source_file").agg(F.count("*").alias("n"))


@register(_sql("SELECT relation, count(*) AS n, round(count(*) FILTER (confidence = 'EXTRACTED') / count(*), 6) AS resolution_rate FROM edges GROUP BY relation"))
def health_rates(spark, sf):
    return edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("confidence") == "EXTRACTED") / F.count("*"), 6).alias("resolution_rate"))


@register("SELECT 'c:'||user_id AS id, min(event_id) AS position, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def dedupe_nodes(spark, sf):
    return G.dedupe_nodes(table(spark, sf, "events").select(key("c", "user_id").alias("id"), "event_id", "event_type", "value"), "event_id")


@register("SELECT 'o:'||l_orderkey AS src, 'p:'||l_partkey AS dst, 'contains' AS relation, min_by(l_quantity, [l_linenumber, l_suppkey, l_quantity]::DOUBLE[]) AS weight FROM lineitem GROUP BY l_orderkey, l_partkey")
def dedupe_edges(spark, sf):
    rows = table(spark, sf, "lineitem").select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("contains").alias("relation"), F.col("l_quantity").alias("weight"), F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("at"))
    return G.dedupe_edges(rows, "at")


_TYPED = "SELECT 'p:'||l_partkey AS src, 's:'||l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'references' ELSE 'uses' END AS relation, l_quantity AS weight FROM lineitem UNION ALL SELECT 's:'||l_suppkey, 'p:'||l_partkey, 'supplies', 1.0 FROM lineitem WHERE l_linestatus = 'O'"


def _typed(spark, sf):
    li = table(spark, sf, "lineitem")
    p, s = key("p", "l_partkey"), key("s", "l_suppkey")
    rel = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "references").otherwise("uses")
    there = li.select(p.alias("src"), s.alias("dst"), rel.alias("relation"), F.col("l_quantity").alias("weight"))
    return there.unionByName(li.where("l_linestatus = 'O'").select(s.alias("src"), p.alias("dst"), F.lit("supplies").alias("relation"), F.lit(1.0).alias("weight")))


@register(f"""WITH e AS ({_TYPED}), r AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY (relation NOT IN ('references', 'uses', 'mentions')) DESC, src DESC, dst DESC, relation DESC) AS rn FROM e)
SELECT a, b, max(relation) FILTER (rn = 1) AS relation, max(src) FILTER (rn = 1) AS src, count(*) AS parallel_count, sum(weight) AS weight FROM r GROUP BY a, b""")
def collapse_edges(spark, sf):
    return G.collapse(_typed(spark, sf))


@register(_sql("SELECT src, dst, count(*) AS parallel_count, sum(weight) AS weight, count(DISTINCT relation) AS relations FROM edges GROUP BY src, dst"))
def multigraph_pairs(spark, sf):
    return edges(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("parallel_count"), F.sum("weight").alias("weight"), F.countDistinct("relation").alias("relations"))


_KEPT = "known AS (SELECT * FROM nodes WHERE NOT (id LIKE 'c:%' AND label LIKE '%7'))"


def _known(spark, sf):
    return nodes(spark, sf).where("not (id like 'c:%' and label like '%7')")


@register(_sql("""SELECT (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM known) OR dst NOT IN (SELECT id FROM known)) AS dangling, (SELECT count(*) FROM edges WHERE src = dst) AS self_loops, (SELECT count(*) FROM edges) AS total,
 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM edges GROUP BY src, dst, relation, confidence, weight, context, confidence_score)) AS exact_repeats, count(*) FILTER (n > 1) AS parallel_pairs, count(*) FILTER (r > 1) AS mixed_pairs FROM (SELECT count(*) AS n, count(DISTINCT relation) AS r FROM edges GROUP BY least(src, dst), greatest(src, dst))""", _KEPT))
def diagnose_edges(spark, sf):
    return G.diagnostics(_known(spark, sf), edges(spark, sf))


@register(_sql("SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT id FROM known) OR dst NOT IN (SELECT id FROM known)", _KEPT))
def dangling_edges(spark, sf):
    return G.dangling(_known(spark, sf), edges(spark, sf)).select("src", "dst", "relation")


@register(_sql("SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known)", _KEPT))
def prune_repo(spark, sf):
    return G.prune_dangling(_known(spark, sf), edges(spark, sf)).select("src", "dst", "relation")


_OLD, _NEW = "o_orderstatus <> 'P'", "o_orderstatus <> 'F'"


def _snapshots(spark, sf):
    o = table(spark, sf, "orders")
    return [o.where(c).select(key("o", "o_orderkey").alias("id"), key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"), F.lit("placed_by").alias("relation")) for c in (_OLD, _NEW)]


@register(f"SELECT 'o:'||o_orderkey AS id, CASE WHEN {_NEW} THEN 'added' ELSE 'removed' END AS change FROM orders WHERE ({_OLD}) <> ({_NEW})")
def graph_diff_nodes(spark, sf):
    return G.diff_nodes(*_snapshots(spark, sf))


@register(f"SELECT least('o:'||o_orderkey, 'c:'||o_custkey) AS a, greatest('o:'||o_orderkey, 'c:'||o_custkey) AS b, 'placed_by' AS relation, CASE WHEN {_NEW} THEN 'added' ELSE 'removed' END AS change FROM orders WHERE ({_OLD}) <> ({_NEW})")
def graph_diff_edges(spark, sf):
    return G.diff_edges(*_snapshots(spark, sf))


def _doc_rows(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_file"), F.md5("text").alias("content"))


_DOC = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_file, md5(text) AS content FROM documents"


@register(f"SELECT * FROM ({_DOC}) WHERE source_file NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT id, source_file, md5(content) FROM ({_DOC}) WHERE source_file IN ('src1', 'src2')")
def incremental_merge(spark, sf):
    d = _doc_rows(spark, sf)
    names = spark.createDataFrame([("src1",), ("src2",)], "source_file string")
    gone = spark.createDataFrame([("src3",)], "source_file string")
    return G.merge(d, d.join(names, "source_file", "left_semi").withColumn("content", F.md5("content")), names, gone)


@register(f"WITH d AS ({_DOC}), n AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'labels' AS source_file, CAST(quality AS VARCHAR) AS content FROM labels) SELECT * FROM d WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def merge_union(spark, sf):
    other = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("labels").alias("source_file"), F.col("quality").cast("string").alias("content"))
    return G.compose(_doc_rows(spark, sf), other)


@register("SELECT 'o:'||o_orderkey AS src, 'c:'||o_custkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def resolve_endpoints(spark, sf):
    raw = table(spark, sf, "orders").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("src"), F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("dst"))
    return G.resolve_endpoints(nodes(spark, sf), raw).select("src", "dst")


@register("WITH p AS (SELECT *, concat_ws(' ', p_name, p_type, p_brand, CAST(p_size AS VARCHAR)) AS label FROM part), one AS (SELECT label, min('p:'||p_partkey) AS dst FROM p GROUP BY label HAVING count(*) = 1) SELECT DISTINCT 'o:'||l_orderkey AS src, dst, 'calls' AS relation, 'INFERRED' AS confidence, 0.85::DOUBLE AS confidence_score FROM lineitem JOIN p ON p_partkey = l_partkey JOIN one USING (label)")
def resolve_calls_unique(spark, sf):
    part = table(spark, sf, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")))
    calls = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(key("o", "l_orderkey").alias("src"), F.col("label").alias("callee"))
    return G.unique_targets(calls, part.select(key("p", "p_partkey").alias("id"), "label"))


@register("""WITH p AS (SELECT *, p_name||'/'||p_size AS face, p_type||'/'||p_size AS name FROM part), impl AS (SELECT face, min(p_brand) AS impl FROM p GROUP BY face HAVING count(DISTINCT p_brand) = 1), m AS (SELECT p_brand AS type, name, min('p:'||p_partkey) AS "to" FROM p GROUP BY ALL HAVING count(*) = 1)
SELECT 'i:'||p_partkey AS "from", "to" FROM p JOIN impl USING (face) JOIN m ON m.type = impl AND m.name = p.name""")
def interface_dispatch(spark, sf):
    p = table(spark, sf, "part")
    face, name = F.concat_ws("/", "p_name", F.col("p_size").cast("string")), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("name")
    own = p.select(F.col("p_brand").alias("type"), key("p", "p_partkey").alias("id"), name)
    faces = p.select(face.alias("type"), key("i", "p_partkey").alias("id"), name)
    return G.interface_dispatch(p.select(F.col("p_brand").alias("type"), face.alias("interface")), own.unionByName(faces))


@register("WITH p AS (SELECT DISTINCT 'n'||s_nationkey AS provider, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), n AS (SELECT DISTINCT 'n'||c_nationkey AS repo, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) SELECT repo, key, min(provider) AS provider FROM n JOIN p USING (key) WHERE repo <> provider GROUP BY repo, key HAVING count(*) = 1")
def package_links(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey").cast("string").alias("key")
    provides = li.join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("repo"), k)
    o = li.join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return G.package_links(o.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"), k), provides)


@register("WITH t AS (SELECT 'p:'||p_partkey AS id, p_type AS namespace, CAST(p_size AS VARCHAR) AS label, p_brand AS repo FROM part) SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.namespace = y.namespace AND x.label = y.label AND x.id < y.id AND x.repo <> y.repo")
def shared_type_links(spark, sf):
    p = table(spark, sf, "part")
    return G.shared_types(p.select(key("p", "p_partkey").alias("id"), F.col("p_type").alias("namespace"), F.col("p_size").cast("string").alias("label"), F.col("p_brand").alias("repo")))


@register("SELECT o_orderkey AS number, count(DISTINCT l_partkey) AS nodes, count(DISTINCT p_size % 25) AS communities FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def pr_impact(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("number")).agg(F.countDistinct("l_partkey").alias("nodes"), F.countDistinct(F.col("p_size") % 25).alias("communities"))


@register("SELECT p_size % 25 AS community, count(DISTINCT l_orderkey) AS prs FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def pr_conflicts(spark, sf):
    live = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, sf, "lineitem").join(live, "l_orderkey").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy((F.col("p_size") % 25).alias("community")).agg(F.countDistinct("l_orderkey").alias("prs")).where("prs > 1")


@register("""SELECT o_orderkey AS number, CASE WHEN o_orderpriority LIKE '5%' THEN 'WRONG-BASE' WHEN o_orderstatus = 'P' THEN 'CI-FAIL' WHEN o_totalprice > 300000 THEN 'CHANGES-REQ' WHEN o_custkey % 7 = 0 THEN 'DRAFT'
 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') >= 1200 THEN 'STALE' WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_totalprice < 50000 THEN 'PENDING' ELSE 'READY' END AS status FROM orders""")
def pr_status(spark, sf):
    o = table(spark, sf, "orders")
    ci = F.when(F.col("o_orderstatus") == "P", "FAILURE").when(F.col("o_totalprice") < 50000, "PENDING").otherwise("SUCCESS")
    review = F.when(F.col("o_totalprice") > 300000, "CHANGES_REQUESTED").when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("NONE")
    age = F.when(F.date_diff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")) >= 1200, 14).otherwise(0)
    return D.pr_status(o.select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderpriority").startswith("5"), "dev").otherwise("main").alias("base"), ci.alias("ci"), review.alias("review"), (F.col("o_custkey") % 7 == 0).alias("draft"), age.alias("age_days")))


# --- retrieval

TERMS = ["the", "de", "tion", "and", "les"]
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@register(f"WITH w AS (SELECT DISTINCT doc_id, unnest({_TOK.replace('lower(text)', 'strip_accents(lower(text))')}) AS term FROM documents) SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))), 6) AS idf FROM w GROUP BY term")
def idf_terms(spark, sf):
    return R.document_frequency(table(spark, sf, "documents"), "text").withColumn("idf", F.round("idf", 6))


IDF = {"customer#": 1.5, "0001": 2.5, "building": 1.0}


def _scored_sql() -> str:
    cover = " + ".join(f"CASE WHEN contains(l, '{t}') THEN 1 ELSE 0 END" for t in IDF)
    strong = " + ".join(f"{w} * CASE WHEN l = '{t}' THEN 1000.0::DOUBLE WHEN starts_with(l, '{t}') THEN 100.0 ELSE 0.0 END" for t, w in IDF.items())
    weak = " + ".join(f"CASE WHEN NOT starts_with(l, '{t}') AND contains(l, '{t}') THEN {w}::DOUBLE ELSE 0.0 END + CASE WHEN contains(s, '{t}') THEN 0.5::DOUBLE * {w} ELSE 0.0 END" for t, w in IDF.items())
    return f"scored AS (SELECT id, label, round(({strong}) * power(({cover}) / {len(IDF)}.0::DOUBLE, 2) + {weak}, 6) AS score, CAST({cover} AS BIGINT) AS matched FROM (SELECT *, lower(label) AS l, lower(source_file) AS s FROM nodes) WHERE ({strong}) * ({cover}) + {weak} > 0)"


def _scored(spark, sf):
    return R.score(nodes(spark, sf), IDF).withColumn("score", F.round("score", 6))


@register(_sql("SELECT * FROM scored", _scored_sql()))
def score_query(spark, sf):
    return _scored(spark, sf)


@register(_sql("SELECT id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rn FROM scored) WHERE rn = 1 AND score >= 0.2 * (SELECT max(score) FROM scored) ORDER BY score DESC, length(label), id LIMIT 3", _scored_sql()))
def pick_seeds(spark, sf):
    return R.seeds(_scored(spark, sf))


@register(_sql("SELECT id, label, source_file, CAST(CASE WHEN lower(source_file) = 'customer#00000001' THEN 0 WHEN lower(label) = 'customer#00000001' THEN 1 WHEN starts_with(lower(label), 'customer#00000001') THEN 2 ELSE 3 END AS BIGINT) AS tier FROM nodes WHERE contains(lower(label), 'customer#00000001') OR lower(source_file) = 'customer#00000001'"))
def find_node_tiers(spark, sf):
    return R.tiers(nodes(spark, sf), "Customer#00000001")


@register("SELECT p_name AS name, 'p:'||p_partkey AS id, CAST(CASE WHEN lower(p_name) = 'widget' THEN 0 WHEN lower(p_name) LIKE 'widget%' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM part WHERE lower(p_name) LIKE '%widget%' ORDER BY rank, name, id LIMIT 200")
def symbol_search(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_name").alias("name"), key("p", "p_partkey").alias("id"))
    return symbols.search(own, "Widget").select("name", "id", F.col("rank").cast("long").alias("rank"))


@register(_sql("SELECT label, count(*) AS n, count(DISTINCT source_file) AS files, min(id) AS first_id FROM nodes GROUP BY label HAVING count(DISTINCT source_file) > 1"))
def node_ambiguity(spark, sf):
    return nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("files"), F.min("id").alias("first_id")).where("files > 1")


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(TERMS)))
    s = " + ".join(f"ln(1 + (docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for i in range(len(TERMS)))
    return f"c AS (SELECT doc_id, len(t) AS n, {tf} FROM (SELECT doc_id, {_TOK} AS t FROM documents)), z AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM c), bm AS (SELECT doc_id, round({s}, 6) AS score FROM c, z WHERE {s} > 0 ORDER BY score DESC, doc_id LIMIT 10)"


@register(f"WITH {_bm25_sql()} SELECT doc_id, score FROM bm")
def bm25_topk(spark, sf):
    return R.bm25(table(spark, sf, "documents"), "doc_id", "text", TERMS)


PROBE = [((i * 37) % 19 - 9) / 9 for i in range(64)]
_COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"{x!r}::DOUBLE" for x in PROBE) + "]), 6)"


@register(f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    return R.cosine_topk(table(spark, sf, "embeddings"), PROBE)


@register(f"SELECT vec_id, {_COS} AS score, label FROM embeddings WHERE label = 3 AND {_COS} >= 0.07 ORDER BY score DESC, vec_id LIMIT 5")
def memory_search(spark, sf):
    v = table(spark, sf, "embeddings").where("label = 3")
    q = F.array(*[F.lit(x) for x in PROBE])
    return v.select("vec_id", F.round(R.cosine(F.col("embedding"), q), 6).alias("score"), "label").where("score >= 0.07").orderBy(F.desc("score"), "vec_id").limit(5)


def _text_index(spark, sf):
    root = fresh(spark)
    index.put_texts(table(spark, sf, "documents"), root)
    return root


@register(f"WITH {_bm25_sql()} SELECT doc_id, score, source FROM bm JOIN documents USING (doc_id)")
def index_texts_topk(spark, sf):
    """All documents are indexed, then asked."""
    return index.search_texts(spark, _text_index(spark, sf), TERMS)


@register(f"WITH {_bm25_sql().replace('ORDER BY score DESC, doc_id LIMIT 10', '')} SELECT doc_id, score, source FROM bm JOIN documents USING (doc_id) WHERE source IN ('src3', 'src8') ORDER BY score DESC, doc_id LIMIT 10")
def index_texts_scoped(spark, sf):
    """Answers of two sources only; how rare a term is counts over all."""
    return index.search_texts(spark, _text_index(spark, sf), TERMS, scope=["src3", "src8"])


@register(f"SELECT vec_id, {_COS} AS score, CAST(label AS VARCHAR) AS source FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def index_vectors_topk(spark, sf):
    """All vectors are indexed by cell, a label as source; the cells that may hold one of the ten nearest are read."""
    root = fresh(spark)
    index.put_vectors(table(spark, sf, "embeddings"), root, source="label")
    return index.search_vectors(spark, root, PROBE, exact=True)


@register(f"WITH {_bm25_sql()}, v AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10), r AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS r FROM bm UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM v) SELECT doc_id, round(sum(r), 9) AS score, count(*) AS channels FROM r GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def rrf_fusion(spark, sf):
    v = R.cosine_topk(table(spark, sf, "embeddings"), PROBE).withColumnRenamed("vec_id", "doc_id")
    return R.fuse([bm25_topk(spark, sf), v], "doc_id")


@register(f"WITH {_bm25_sql()}, g AS (SELECT doc_id, 0.5::DOUBLE AS score FROM labels WHERE toxic = 0) SELECT doc_id, score FROM (SELECT * FROM bm UNION ALL SELECT * FROM g WHERE doc_id NOT IN (SELECT doc_id FROM bm)) ORDER BY score DESC, doc_id LIMIT 20")
def evidence_rank(spark, sf):
    graph = table(spark, sf, "labels").where("toxic = 0").select("doc_id", F.lit(0.5).alias("score"))
    found = settle(bm25_topk(spark, sf))
    return G.compose(graph.withColumnRenamed("doc_id", "id"), found.withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id").orderBy(F.desc("score"), "doc_id").limit(20)


# --- traversal

START = "n:3"
_HUB = "hub AS (SELECT greatest(50, max(degree)) AS h FROM (SELECT degree FROM (SELECT coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) AS rn, count(*) OVER () AS n FROM nodes LEFT JOIN deg USING (id)) WHERE rn = CAST(floor(n * 0.99) AS BIGINT) + 1))"


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@register(_sql("SELECT id, CAST(min(d) AS INTEGER) AS depth FROM w GROUP BY id", f"{_HUB}, st AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT 'o:7' AS id, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN st ON src = id WHERE d < 3 AND (d = 0 OR (SELECT degree FROM deg WHERE deg.id = w.id) < (SELECT h FROM hub)))", True))
def bfs_nodes(spark, sf):
    e, n = edges(spark, sf), nodes(spark, sf)
    return V.bfs(e, _seed(spark, "o:7"), 3, hub=V.hub_limit(e, n))


_BOTH = "st AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges))"


@register(_sql(f"SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT id FROM w) OR dst IN (SELECT id FROM w)", f"{_BOTH}, w AS (SELECT '{START}' AS id, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN st ON src = id WHERE d < 1)", True))
def subgraph_edges(spark, sf):
    return V.subgraph(edges(spark, sf), _seed(spark, START), 2)


def _impact_sql(start: str, relations: str) -> str:
    return _sql(
        f"SELECT m.id, CAST(m.d AS INTEGER) AS depth, min(e.dst) AS via, min(e.relation) AS relation FROM m JOIN edges e ON e.src = m.id AND e.relation IN ({relations}) JOIN m p ON p.id = e.dst AND p.d = m.d - 1 WHERE m.d > 0 GROUP BY m.id, m.d",
        f"st AS (SELECT DISTINCT src, dst FROM edges WHERE relation IN ({relations})), w AS (SELECT id, 0 AS d FROM ({start}) UNION SELECT src, d + 1 FROM w JOIN st ON dst = id WHERE d < 2), m AS (SELECT id, min(d) AS d FROM w GROUP BY id)",
        True,
    )


@register(_impact_sql(f"SELECT '{START}' AS id", "'located_in', 'placed_by'"))
def affected(spark, sf):
    return V.affected(edges(spark, sf), _seed(spark, START), ["located_in", "placed_by"]).select("id", "depth", "via", "relation")


@register(_impact_sql("SELECT 'o:7' AS id UNION SELECT dst FROM edges WHERE src = 'o:7' AND relation = 'contains'", "'contains'"))
def affected_members(spark, sf):
    """What depends on an order through the parts it holds: orders of the same parts."""
    return V.affected(edges(spark, sf), _seed(spark, "o:7"), ["contains"]).select("id", "depth", "via", "relation")


@register(_sql("SELECT id, CAST(min(d) AS INTEGER) AS depth FROM w WHERE id = 'r:1' GROUP BY id", "st AS (SELECT DISTINCT src, dst FROM edges), w AS (SELECT 'o:7' AS id, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN st ON src = id WHERE d < 8)", True))
def shortest_path_len(spark, sf):
    return V.path_length(edges(spark, sf), _seed(spark, "o:7"), "r:1")


@register(_sql("SELECT DISTINCT src, dst, relation FROM edges WHERE src <> dst AND src IN (SELECT id FROM nodes WHERE community = 7) AND dst IN (SELECT id FROM nodes WHERE community = 7)"))
def induced_edges(spark, sf):
    return V.induced(edges(spark, sf), nodes(spark, sf).where("community = 7"))


def _files(spark, sf):
    """Parts as files: within an order each line's part imports the next line's."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("src"))
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    both = li.join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst", F.lit("imports_from").alias("relation"), F.col("src").alias("source_file"))
    own = table(spark, sf, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id")).withColumn("source_file", F.col("id"))
    return V.file_graph(own, both)


_FILES = "e AS (SELECT DISTINCT 'p:'||a.l_partkey AS src, 'p:'||b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


@register(f"""WITH {_FILES}, f AS (SELECT src, dst FROM e WHERE src <> dst), c AS (SELECT src AS cycle, 1 AS length FROM e WHERE src = dst
UNION ALL SELECT a.src||'>'||a.dst, 2 FROM f a JOIN f b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src||'>'||a.dst||'>'||b.dst, 3 FROM f a JOIN f b ON a.dst = b.src JOIN f c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst)
SELECT cycle, CAST(length AS BIGINT) AS length FROM c ORDER BY length, cycle LIMIT 20""")
def import_cycles(spark, sf):
    """The report's twenty shortest cycles."""
    return V.cycles(_files(spark, sf), top=20)


@register(f"""WITH RECURSIVE {_FILES}, e2 AS (SELECT src, dst FROM e WHERE src <> dst), hub AS (SELECT src AS h FROM (SELECT src FROM e2 UNION ALL SELECT dst FROM e2) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
fw AS (SELECT h AS id FROM hub UNION SELECT dst FROM fw JOIN e2 ON src = id), bw AS (SELECT h AS id FROM hub UNION SELECT src FROM bw JOIN e2 ON dst = id),
big AS (SELECT id FROM fw INTERSECT SELECT id FROM bw), r AS (SELECT src, dst FROM e2 WHERE src NOT IN (SELECT id FROM big) AND dst NOT IN (SELECT id FROM big)),
p AS (SELECT src, dst FROM r UNION SELECT p.src, r.dst FROM p JOIN r ON p.dst = r.src),
o AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT id, component FROM o UNION ALL SELECT id, (SELECT min(id) FROM big) FROM big WHERE (SELECT count(*) FROM big) > 1""")
def strong_components(spark, sf):
    return V.strong_components(_files(spark, sf))


@register(_sql("SELECT DISTINCT id, component FROM w JOIN c USING (root)", "st AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT DISTINCT dst, src FROM edges WHERE src <> dst), w AS (SELECT 'r:'||r_regionkey AS id, r_regionkey AS root FROM region UNION SELECT b, root FROM w JOIN st ON a = id), c AS (SELECT root, min(id) AS component FROM w GROUP BY root)", True))
def components(spark, sf):
    return V.components(edges(spark, sf))


# --- communities


@register(_sql("SELECT community, n, round(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE coalesce(k, 0) / (n * (n - 1) / 2.0::DOUBLE) END, 9) AS cohesion FROM (SELECT community, count(*) AS n FROM nodes WHERE community IS NOT NULL GROUP BY community) LEFT JOIN (SELECT x.community AS community, count(*) AS k FROM (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst) e JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE x.community = y.community GROUP BY 1) USING (community)"))
def cohesion(spark, sf):
    return C.cohesion(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT community, label, degree FROM (SELECT community, label, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS rn FROM nodes LEFT JOIN deg USING (id) WHERE community IS NOT NULL) WHERE rn = 1"))
def hub_labels(spark, sf):
    return C.hub_labels(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT community, count(*) AS n, substr(sha256(string_agg(id || chr(0), '' ORDER BY id)), 1, 16) AS signature FROM nodes WHERE community IS NOT NULL GROUP BY community"))
def community_sigs(spark, sf):
    return C.signatures(nodes(spark, sf))


_X = "x AS (SELECT e.*, s.community AS sc, d.community AS dc, s.source_file AS sf, d.source_file AS df, s.file_type AS st, d.file_type AS dt FROM edges e JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst)"


@register(_sql("SELECT least(sc, dc) AS a, greatest(sc, dc) AS b, count(*) AS n FROM x WHERE sc <> dc GROUP BY 1, 2", _X))
def cross_community(spark, sf):
    return C.crossings(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT a, b, src, dst, relation FROM (SELECT least(sc, dc) AS a, greatest(sc, dc) AS b, src, dst, relation, row_number() OVER (PARTITION BY least(sc, dc), greatest(sc, dc) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, src, dst, relation) AS rn FROM x WHERE sc <> dc) WHERE rn = 1", _X))
def bridges(spark, sf):
    return C.bridges(nodes(spark, sf), edges(spark, sf))


@register(_sql("""SELECT src, dst, relation, CAST(CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN st <> dt THEN 2 ELSE 0 END + CASE WHEN string_split(sf, '/')[1] <> string_split(df, '/')[1] THEN 2 ELSE 0 END + CASE WHEN sc <> dc THEN 1 ELSE 0 END + CASE WHEN least(a.degree, b.degree) <= 2 AND greatest(a.degree, b.degree) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS score
 FROM x JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND sf <> df AND string_split(sf, '/')[-1] LIKE '%.%' AND string_split(df, '/')[-1] LIKE '%.%'""", _X))
def surprise_scores(spark, sf):
    return C.surprises(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) <= 1"))
def isolated_nodes(spark, sf):
    return C.isolated(nodes(spark, sf), edges(spark, sf))


@register(_sql(f"SELECT community, count(*) FILTER ({FILE}) AS n FROM nodes WHERE community IS NOT NULL GROUP BY community HAVING count(*) FILTER ({FILE}) < (SELECT count(*) FILTER ({FILE}) / count(DISTINCT community) FROM nodes WHERE community IS NOT NULL)"))
def thin_communities(spark, sf):
    """Thin here: below the mean."""
    n = nodes(spark, sf).where("community is not null")
    mean = n.agg(F.count_if(~G.is_concept(F.col("source_file"))) / F.countDistinct("community")).first()[0]
    return C.thin(n, mean)


@register(_sql("SELECT community, CAST(sum(n) AS BIGINT) AS crossing, count(*) AS neighbours, rank() OVER (ORDER BY sum(n) DESC) AS rank FROM (SELECT least(sc, dc) AS a, greatest(sc, dc) AS b, count(*) AS n FROM x WHERE sc <> dc GROUP BY 1, 2), LATERAL (SELECT unnest([a, b]) AS community) GROUP BY community", _X))
def community_meta_graph(spark, sf):
    return C.meta_graph(nodes(spark, sf), edges(spark, sf))


# --- entity resolution

_NORM = "trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def _labels(spark, sf):
    return table(spark, sf, "part").select(key("p", "p_partkey").alias("id"), X.norm_label(F.col("p_name")).alias("norm"), "p_brand", "p_size")


@register(f"SELECT 'p:'||p_partkey AS id, {_NORM} AS norm FROM part")
def label_norm(spark, sf):
    return _labels(spark, sf).select("id", "norm")


@register(f"WITH n AS (SELECT 'p:'||p_partkey AS id, {_NORM} AS norm FROM part), c AS (SELECT id, unnest(string_split(norm, '')) AS ch, length(norm) AS n FROM n), f AS (SELECT id, ch, count(*) / max(n) AS p FROM c GROUP BY id, ch) SELECT id, round(-sum(p * log2(p)), 6) AS entropy FROM f GROUP BY id")
def label_entropy(spark, sf):
    return _labels(spark, sf).select("id", F.round(X.entropy(F.col("norm")), 6).alias("entropy"))


@register(f"SELECT 'p:'||p_partkey AS id, unnest(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) AS shingle FROM (SELECT *, replace({_NORM}, ' ', '') AS s FROM part) WHERE length(s) > 3")
def shingles(spark, sf):
    return _labels(spark, sf).where(F.length(F.replace("norm", F.lit(" "), F.lit(""))) > 3).select("id", F.explode(X.shingles(F.col("norm"))).alias("shingle"))


_BLOCK = f"n AS (SELECT 'c:'||c_custkey AS id, trim(regexp_replace(lower(c_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm, c_nationkey||'|'||c_mktsegment AS block FROM customer)"


_OPENINGS = "l AS (SELECT min(doc_id) AS id, norm FROM (SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents) WHERE length(norm) >= 12 GROUP BY norm), d AS (SELECT *, list_sort(list_transform(regexp_extract_all(norm, '[0-9]+'), lambda x: regexp_replace(x, '^0+(.)', '\\1'))) AS digits FROM l)"


def _openings(spark, sf):
    norm = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 60)), "[^a-z0-9]+", " "))  # DuckDB compares bytes
    return table(spark, sf, "documents").select("doc_id", norm.alias("norm")).where(F.length("norm") >= 12).groupBy("norm").agg(F.min("doc_id").alias("id"))


@register(f"WITH {_OPENINGS} SELECT x.id AS a, y.id AS b, round(jaro_winkler_similarity(x.norm, y.norm), 6) AS score FROM d x JOIN d y ON substr(x.norm, 1, 8) = substr(y.norm, 1, 8) AND x.id < y.id AND x.digits = y.digits WHERE round(jaro_winkler_similarity(x.norm, y.norm), 6) >= 0.9")
def fuzzy_pairs(spark, sf):
    """Labels of documents that begin alike; blocks of eight characters are small by nature."""
    return E.fuzzy_pairs(_openings(spark, sf), F.left("norm", F.lit(8)), 0.9)


@register("WITH d AS (SELECT 'c:'||c_custkey AS id, list_sort(list_transform(regexp_extract_all(c_name, '[0-9]+'), lambda x: regexp_replace(x, '^0+(.)', '\\1'))) AS digits FROM customer) SELECT array_to_string(digits, ',') AS digits, count(*) AS n, min(id) AS first_id FROM d GROUP BY ALL")
def variant_guard(spark, sf):
    c = table(spark, sf, "customer").select(key("c", "c_custkey").alias("id"), F.array_join(E.digits(F.col("c_name")), ",").alias("digits"))
    return c.groupBy("digits").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@register(_sql("SELECT norm, source_file, min_by(id, length(id) || ':' || id) AS survivor, count(*) AS n FROM (SELECT id, source_file, trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM nodes) GROUP BY norm, source_file HAVING count(*) > 1"))
def exact_label_merge(spark, sf):
    return E.exact_merge(nodes(spark, sf))


@register()
def minhash_candidates(spark, sf):
    return E.candidates(_openings(spark, sf))


# --- documents, memory, chat


@register("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def doc_word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f\\x0B]+")).cast("long").alias("words"))


_B = "[\\x20\\x09-\\x0D]"
_CHUNKS = f"""t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^{_B}+', ''), '{_B}+$', '') AS body FROM documents), u AS (SELECT *, length(body) AS n FROM t),
cut AS (SELECT doc_id, body, n, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST(0 AS BIGINT) AS nxt FROM u WHERE n > 0 UNION ALL SELECT doc_id, body, n, start, stop, CASE WHEN stop >= n THEN n ELSE aft + length(regexp_extract(substr(body, aft + 1), '^{_B}+')) END FROM (SELECT *, greatest(stop - 200, start + 1) AS aft FROM (SELECT doc_id, body, n, nxt AS start, CASE WHEN hard < n AND back > 0 AND hard + 1 - back > nxt + 200 THEN hard + 1 - back ELSE hard END AS stop FROM (SELECT *, instr(reverse(substr(body, nxt + 2, hard - nxt)), ' ') AS back FROM (SELECT *, least(nxt + 2000, n) AS hard FROM cut WHERE nxt < n)))))"""


@register(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, start, stop AS \"end\", md5(regexp_replace(regexp_replace(substr(body, start + 1, stop - start), '^{_B}+', ''), '{_B}+$', '')) AS chunk, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS seq FROM cut WHERE stop > 0")
def chunk_documents(spark, sf):
    return D.chunk(table(spark, sf, "documents")).withColumn("chunk", F.md5("chunk"))


def _before_end(mark: str, chars: int) -> str:
    """Where the last ``mark`` of ``w`` begins, 0 or less if nowhere past its first character."""
    return f"CASE WHEN contains(w, {mark}) THEN length(w) - instr(reverse(w), reverse({mark})) - {chars - 1} ELSE 0 END"


_SLICES = f"""cut AS (SELECT doc_id, text, n, 0::BIGINT AS seq, 0::BIGINT AS start, 0::BIGINT AS stop FROM (SELECT doc_id, text, length(text) AS n FROM documents) WHERE n > 0
UNION ALL SELECT doc_id, text, n, seq + 1, stop, CAST(CASE WHEN n - stop <= 2000 THEN n WHEN h > 0 THEN stop + h + 1 WHEN b > 0 THEN stop + b + 2 WHEN l > 0 THEN stop + l + 1 ELSE stop + 2000 END AS BIGINT)
FROM (SELECT *, {_before_end("chr(10)||'#'", 2)} AS h, {_before_end("chr(10)||chr(10)", 2)} AS b, {_before_end("chr(10)", 1)} AS l FROM (SELECT *, substr(text, stop + 1, 2000) AS w FROM cut WHERE stop < n)))"""


@register(f'WITH RECURSIVE {_SLICES} SELECT doc_id, seq - 1 AS seq, start, stop AS "end" FROM cut WHERE seq > 0')
def slice_documents(spark, sf):
    return D.slices(table(spark, sf, "documents"))


@register("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("text_md5"))


@register("SELECT id, ord, CASE WHEN coalesce(trim(id), '') = '' THEN 'missing_id' WHEN rn > 1 THEN 'duplicate_id' WHEN length(label) > 2000 THEN 'too_long' WHEN strlen(label) > 262144 THEN 'too_big' END AS reason FROM (SELECT CAST(conv_id AS VARCHAR) AS id, turn AS ord, text AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)")
def normalize_reject(spark, sf):
    return D.rejects(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("label"), F.col("turn").alias("ord")))


_OUT = "CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'error' THEN 'dead_end' WHEN 'signup' THEN 'corrected' ELSE 'none' END"
_LESSON = f"l AS (SELECT 'c:'||user_id AS node, {_OUT} AS outcome, power(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6::DOUBLE, 0) / 30) AS w FROM events), s AS (SELECT *, CASE WHEN outcome = 'useful' THEN 1 WHEN outcome = 'none' THEN 0 ELSE -1 END AS g FROM l)"


def _events(spark, sf):
    e = table(spark, sf, "events")
    o = F.when(F.col("event_type") == "purchase", "useful").when(F.col("event_type") == "error", "dead_end").when(F.col("event_type") == "signup", "corrected").otherwise("none")
    return e.select(key("c", "user_id").alias("node"), o.alias("outcome"), "ts")


@register(f"WITH {_LESSON} SELECT node, score, pos, neg, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN neg > 0 THEN 'avoid' WHEN pos >= 2 THEN 'preferred' WHEN pos > 0 THEN 'tentative' ELSE 'none' END AS status FROM (SELECT node, round(sum(g * w), 6) AS score, count(*) FILTER (g > 0) AS pos, count(*) FILTER (g < 0) AS neg FROM s GROUP BY node)")
def lessons(spark, sf):
    return D.lessons(_events(spark, sf), "2024-02-01")


@register(f"WITH {_LESSON} SELECT outcome, count(*) AS n, round(sum(w), 4) AS weight FROM s GROUP BY outcome")
def lesson_decay(spark, sf):
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400e6
    return _events(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum(X.decay(age, 30.0)), 4).alias("weight"))


@register(_sql("SELECT path, count(*) AS total FROM (SELECT unnest(list_transform(range(0, len(string_split(source_file, '/'))), lambda i: array_to_string(list_slice(string_split(source_file, '/'), 1, i), '/'))) AS path FROM nodes) GROUP BY path"))
def tree_rollup(spark, sf):
    return D.tree(nodes(spark, sf).select(F.col("source_file").alias("path")))


@register("SELECT conv_id, turn, role, seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE seq > n - 3")
def chat_trim(spark, sf):
    return D.trim_chat(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role", "seq")


@register("SELECT source AS workspace, count(DISTINCT doc_id) AS nodes, count(DISTINCT lang) AS kinds, count(l.doc_id) AS rated FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id) GROUP BY source".replace("count(DISTINCT doc_id)", "count(DISTINCT d.doc_id)"))
def workspace_stats(spark, sf):
    rated = table(spark, sf, "labels").select(F.col("doc_id").alias("rated_id"))
    d = table(spark, sf, "documents").join(rated, F.col("doc_id") == F.col("rated_id"), "left")
    return d.groupBy(F.col("source").alias("workspace")).agg(F.countDistinct("doc_id").alias("nodes"), F.countDistinct("lang").alias("kinds"), F.count("rated_id").alias("rated"))


@register("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k")
def debounce_sessions(spark, sf):
    return batch_sessions(table(spark, sf, "events"), 3600)


# --- lifecycle, federation, web


_PHASE = "CASE WHEN doc_id % 10 = 1 THEN 'deleted' WHEN doc_id % 10 = 2 THEN 'new' WHEN doc_id % 10 = 3 THEN 'changed' ELSE 'unchanged' END"


@register(f"SELECT CAST(doc_id AS VARCHAR) AS path, {_PHASE} AS change FROM documents")
def incremental_scan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"), (F.col("doc_id") % 10).alias("k"))
    new = d.where("k <> 1").withColumn("hash", F.when(F.col("k") == 3, F.md5("hash")).otherwise(F.col("hash")))
    return corpus.changes(d.where("k <> 2"), new)


@register("SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 10 = 1 THEN 'remove' WHEN doc_id % 10 = 2 THEN 'add' WHEN doc_id % 10 = 3 THEN 'replace' ELSE 'keep' END AS action FROM documents")
def reconcile_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.md5("text").alias("content_hash"), (F.col("doc_id") % 10).alias("k"))
    incoming = d.where("k <> 1").withColumn("content_hash", F.when(F.col("k") == 3, F.md5("content_hash")).otherwise(F.col("content_hash")))
    return rag.reconcile(d.where("k <> 2"), incoming)


@register("SELECT source AS source_id, count(*) AS n, count(*) FILTER (lang = 'en') AS expected, count(*) = count(*) FILTER (lang = 'en') AS ok FROM documents GROUP BY source")
def stage_counts(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "source_id")
    return rag.verified(d, d.groupBy("source_id").agg(F.count_if(F.col("lang") == "en").alias("expected")))


@register("SELECT conv_id AS answer_id, count(*) AS unresolved FROM conversations WHERE conv_id * 7 + turn NOT IN (SELECT item_id FROM benchmark) GROUP BY conv_id")
def citation_check(spark, sf):
    cited = table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("cited"))
    return rag.unresolved_citations(cited, table(spark, sf, "benchmark").select(F.col("item_id").alias("id")))


@register(_sql("SELECT 'a::'||src AS src, 'a::'||dst AS dst, relation, count(*) AS n FROM edges WHERE relation IN ('in_region', 'located_in') GROUP BY ALL UNION ALL SELECT 'b::'||src, 'b::'||dst, relation, count(*) FROM edges WHERE relation NOT IN ('in_region', 'located_in') GROUP BY ALL"))
def merge_graphs(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    own = F.col("relation").isin("in_region", "located_in")
    _, both = federation.merge_graphs([("a", n.where("file_type = 'code'"), e.where(own)), ("b", n, e.where(~own))])
    return both.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))


@register(_sql("SELECT 'a::'||id AS id, 'a' AS repo, label, community FROM nodes WHERE file_type = 'code' UNION ALL SELECT 'b::'||id, 'b', label, community + (SELECT max(community) + 1 FROM nodes WHERE file_type = 'code') FROM nodes"))
def merge_graph_nodes(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    both, _ = federation.merge_graphs([("a", n.where("file_type = 'code'"), e), ("b", n, e)])
    return both.select("id", "repo", "label", "community")


@register(_sql("SELECT s.community AS a, d.community AS b, relation, count(*) AS n FROM edges LEFT JOIN nodes s ON s.id = src LEFT JOIN nodes d ON d.id = dst GROUP BY ALL"))
def section_edges(spark, sf):
    return rag.sections(nodes(spark, sf), edges(spark, sf))


@register(_sql("SELECT id, CASE WHEN i = 0 THEN 'entry' WHEN o = 0 THEN 'leaf' ELSE 'normal' END AS role FROM (SELECT id, max(o) AS o, max(i) AS i FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges WHERE relation IN ('contains', 'supplied_by') UNION ALL SELECT dst, 0, 1 FROM edges WHERE relation IN ('contains', 'supplied_by')) GROUP BY id)"))
def call_roles(spark, sf):
    return symbols.call_roles(edges(spark, sf).where("relation in ('contains', 'supplied_by')").withColumn("relation", F.lit("calls")))


@register("WITH l AS (SELECT 'x:'||l_partkey AS label, 'o:'||l_orderkey||'/'||l_partkey AS id FROM lineitem), k AS (SELECT label, min(id) AS keep, count(DISTINCT id) AS n FROM l GROUP BY label) SELECT keep AS id, label, n AS merged FROM k")
def external_collapse(spark, sf):
    li = table(spark, sf, "lineitem")
    ext = li.select(F.concat(key("o", "l_orderkey"), F.lit("/"), F.col("l_partkey").cast("string")).alias("id"), key("x", "l_partkey").alias("label"), F.lit("").alias("source_file")).distinct()
    loops = ext.select(F.col("id").alias("src"), F.col("label").alias("dst"))
    left, moved = rag.collapse_externals(ext, loops)
    per = moved.groupBy(F.col("src").alias("k"), F.col("dst").alias("kl")).agg(F.count("*").alias("merged"))
    return left.join(per, (F.col("id") == F.col("k")) & (F.col("label") == F.col("kl"))).select("id", "label", "merged")


@register("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://(www\\.)?(twitter|x)\\.com/') THEN 'tweet' WHEN regexp_matches(url, '(?i)^https?://(www\\.)?arxiv\\.org/') THEN 'arxiv' WHEN regexp_matches(url, '(?i)^https?://(www\\.)?(youtube\\.com|youtu\\.be)/') THEN 'youtube' WHEN regexp_matches(url, '(?i)\\.pdf($|\\?)') THEN 'pdf' WHEN regexp_matches(url, '(?i)\\.(png|jpe?g|gif|webp|svg)($|\\?)') THEN 'image' ELSE 'web' END AS kind FROM pages")
def url_kinds(spark, sf):
    return table(spark, sf, "pages").select("page_id", corpus.url_kind(F.col("url")).alias("kind"))


@register("SELECT source AS scope, lang, count(*) AS files, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source, lang")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("scope"), "lang").agg(F.count("*").alias("files"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))


_PAIRS = "pairs AS (SELECT old, new, count(*) AS n FROM x GROUP BY ALL)"
_GREEDY = f"""WITH RECURSIVE x AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS old, c_custkey % 31 AS new FROM customer), {_PAIRS},
r AS (SELECT 0 AS k, []::BIGINT[] AS uo, []::BIGINT[] AS un, NULL::BIGINT AS o, NULL::BIGINT AS w UNION ALL SELECT k + 1, list_append(uo, best.b), list_append(un, best.c), best.b, best.c FROM (SELECT k, any_value(uo) AS uo, any_value(un) AS un, min(struct_pack(a := -p.n, b := p.old, c := p.new)) AS best FROM r, pairs p WHERE NOT list_contains(uo, p.old) AND NOT list_contains(un, p.new) GROUP BY k)),
got AS (SELECT w AS new, o AS number FROM r WHERE w IS NOT NULL),
fresh AS (SELECT new, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS place FROM x WHERE new NOT IN (SELECT new FROM got) GROUP BY new),
free AS (SELECT i AS number, row_number() OVER (ORDER BY i) AS place FROM range(31) t(i) WHERE i NOT IN (SELECT number FROM got))
SELECT id, number AS community FROM x JOIN (SELECT * FROM got UNION ALL SELECT new, number FROM fresh JOIN free USING (place)) USING (new)"""


@register(_GREEDY)
def stable_ids(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("community"))
    return cluster.stable(c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 31).alias("community")), old)


_QUESTIONS = """SELECT 'ambiguous' AS kind, concat_ws(' ', src, relation, dst) AS about, count(*) AS n FROM edges WHERE confidence = 'AMBIGUOUS' GROUP BY src, dst, relation HAVING count(*) > 1
UNION ALL SELECT 'inferred', id, count(*) FROM (SELECT id FROM nodes JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 5) JOIN edges ON id IN (src, dst) WHERE confidence = 'INFERRED' GROUP BY id HAVING count(*) >= 2
UNION ALL SELECT 'isolated', 'nodes', count(*) FROM nodes LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) <= 1
UNION ALL SELECT 'loose', CAST(community AS VARCHAR), n FROM (SELECT community, count(*) AS n FROM nodes WHERE community IS NOT NULL GROUP BY community HAVING count(*) >= 5) LEFT JOIN (SELECT x.community, count(*) AS k FROM (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst) e JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE x.community = y.community GROUP BY 1) USING (community) WHERE coalesce(k, 0) / (n * (n - 1) / 2.0::DOUBLE) < 0.15"""


@register(_sql(_QUESTIONS))
def suggested_questions(spark, sf):
    """All generators but that of bridges, whose betweenness has its own query."""
    return C.questions(nodes(spark, sf), edges(spark, sf))


def _embed_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in vectors.STOP)
    cut = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND strlen(w) - {len(e)} >= 3 THEN left(w, -{len(e)})" for e in vectors.ENDINGS) + " ELSE w END"
    return f"""WITH t AS (SELECT doc_id, list_transform(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains([{stop}], w)), lambda w: {cut}), lambda w: CASE WHEN ends_with(w, 'e') AND strlen(w) > 3 THEN left(w, -1) ELSE w END) AS k FROM documents),
each AS (SELECT doc_id, unnest(k) AS tok FROM t),
f AS (SELECT doc_id, tok AS f, 1.0::DOUBLE AS w FROM each UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])), 1.0 FROM t UNION ALL SELECT doc_id, '#' || substr(tok, i, 3), 0.25 FROM (SELECT doc_id, tok, unnest(range(1, length(tok) - 1)) AS i FROM each WHERE strlen(tok) >= 4)),
h AS (SELECT f, list_reduce(list_prepend(CAST({vectors.START} AS BIGINT), list_transform(range(0, strlen(f)), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))), lambda x, y: (xor(x, y) * {vectors.FACTOR}) % 4294967296) % 512 AS bucket FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT doc_id, bucket, 1 + ln(sum(w)) AS w FROM f JOIN h USING (f) GROUP BY ALL)
SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM b"""


@register(_embed_sql())
def embed_documents(spark, sf):
    return vectors.weights(table(spark, sf, "documents"), "doc_id").withColumn("weight", F.round("weight", 6))


@register(_sql("SELECT community, intra, degree, round(2.0::DOUBLE * intra / m2 - power(degree / m2, 2), 9) AS q FROM (SELECT c AS community, CAST(sum(i) AS BIGINT) AS intra, count(*) AS degree, sum(count(*)) OVER () AS m2 FROM (SELECT sc AS c, CASE WHEN sc = dc THEN 1 ELSE 0 END AS i FROM x WHERE sc IS NOT NULL AND dc IS NOT NULL UNION ALL SELECT dc, 0 FROM x WHERE sc IS NOT NULL AND dc IS NOT NULL) GROUP BY c)", _X))
def modularity(spark, sf):
    return C.modularity(nodes(spark, sf), edges(spark, sf))


@register()
def label_propagation(spark, sf):
    return C.propagate(edges(spark, sf))


from . import code, more, upkeep  # noqa: E402,F401  register their queries in the tables above
