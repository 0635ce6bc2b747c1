"""Lexical and vector retrieval, and their fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.store import settle


def document_frequency(docs: DataFrame, text: str, terms: list[str] | None = None) -> DataFrame:
    """``term, df, idf`` with idf = ln(1 + n / (1 + df)), terms without accents; only of ``terms`` where given."""
    words = docs.select(F.explode(F.array_distinct(T.tokens(F.col(text), blind=True))).alias("term"))
    if terms is not None:
        words = words.where(F.col("term").isin([T.fold(t) for t in terms]))
    n = docs.agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))  # n is one row


def score(nodes: DataFrame, idf: dict[str, float]) -> DataFrame:
    """``id, score, matched``: tiers per term (exact 1000, prefix 100, inside 1; source 0.5), weighed by idf.

    Exact and prefix matches are scaled by the square of the share of terms they cover. Labels and terms are compared without accents.
    """
    label, source = T.folded(F.col("label")), F.lower("source_file")
    strong, weak, hits = F.lit(0.0), F.lit(0.0), F.lit(0)
    for term, w in ((T.fold(t), w) for t, w in idf.items()):
        tier = F.when(label == term, 1000.0).when(label.startswith(term), 100.0).otherwise(0.0)
        strong = strong + tier * w
        weak = weak + F.when((tier == 0) & label.contains(term), w).otherwise(0.0) + F.when(source.contains(term), 0.5 * w).otherwise(0.0)
        hits = hits + F.when(label.contains(term), 1).otherwise(0)
    cover = hits / len(idf)
    out = nodes.select("id", "label", (strong * cover * cover + weak).alias("score"), hits.cast("long").alias("matched"))
    return out.where("score > 0")


def seeds(scored: DataFrame, k: int = 3, share: float = 0.2) -> DataFrame:
    """At most ``k`` of the best, one per label, none below ``share`` of the best."""
    one = scored.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("label").alias("n"), "id")).alias("x")).select("label", F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))
    best = scored.agg(F.max("score").alias("best"))
    return one.crossJoin(F.broadcast(best)).where(F.col("score") >= share * F.col("best")).orderBy(F.desc("score"), F.length("label"), "id").limit(k).select("id", "label", "score")


def tiers(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes by lookup tier: 0 source file, 1 exact label, 2 prefix, 3 inside."""
    label, q = T.folded(F.col("label")), T.fold(query)
    tier = F.when(F.lower("source_file") == query.lower(), 0).when(label == q, 1).when(label.startswith(q), 2).when(label.contains(q), 3)
    return nodes.select("id", "label", "source_file", tier.cast("long").alias("tier")).where("tier is not null")


def bm25(docs: DataFrame, doc_id: str, text: str, terms: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` documents. One pass over the texts, split once each, counts lengths and the few terms asked for; the counts are kept."""

    def counts(toks: Column) -> Column:
        return F.struct(F.size(toks).alias("n"), *[F.size(F.filter(toks, _is(t))).alias(f"t{i}") for i, t in enumerate(terms)])

    once = F.element_at(F.transform(F.array(T.tokens(F.col(text))), counts), 1)  # binds the tokens
    counted = settle(docs.select(F.col(doc_id).alias("doc_id"), once.alias("c")).select("doc_id", "c.*"))
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"t{i}")
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = counted.crossJoin(F.broadcast(totals)).select("doc_id", F.round(total, 6).alias("score")).where("score > 0")  # totals: one row
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def _is(term: str):
    return lambda x: x == term


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector or unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors; the query vector is a literal, each task keeps its best."""
    q = F.array(*[F.lit(float(x)) for x in np.asarray(query, float)])
    return vectors.select(F.col(vec_id), F.round(cosine(F.col(embedding), q), 6).alias("score")).orderBy(F.desc("score"), vec_id).limit(k)


def fuse(channels: list[DataFrame], key: str, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``key``, ``score``), each at most a few hundred rows."""
    out = None
    for c in channels:
        r = c.select(key, (1.0 / (constant + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("r"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(key).agg(F.round(F.sum("r"), 9).alias("score"), F.count("*").alias("channels")).orderBy(F.desc("score"), key).limit(k)
