"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, embeddings, langid, linededup, mixing, ngram, packing, pii, quality, secrets, simhash, whitening
from .common import checked_broadcast, documents, held_in
from .oracle import ORACLE  # noqa: F401  part of this module's interface


def _of_kind(k: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("rated"), quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    # the sample is drawn before the texts are fetched
    chosen = checked_broadcast(labels.where("grade is not null").orderBy(F.xxhash64("rated")).limit(quality.SAMPLE))
    rated = docs.join(chosen, F.col("doc_id") == F.col("rated")).select("doc_id", "text", "grade")
    return quality.classify(docs, rated).select("doc_id", "expected_grade", "tail", "kept")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), exact=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_in("doc_id", 7) == 2)
    found = ngram.score(docs, docs.where("not held_out").select("text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), limit=3)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    counts = [_of_kind(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live")
    owners = F.coalesce(F.array_max(F.transform("spans", lambda x: x["n_owners"])), F.lit(0)).cast("long").alias("max_owners")
    repositories = F.coalesce(F.array_max(F.transform("spans", lambda x: x["n_repositories"])), F.lit(0)).cast("long").alias("max_repositories")
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), live, owners, repositories)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] < pii.BASE)
    counts = [_of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[: pii.BASE])]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base, pii.KINDS), 256).alias("base_sha256"), secrets.digest(F.col("spans"), pii.KINDS).alias("spans"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_in("doc_id", 4) == 2)
    found = langid.identify(docs.select("doc_id", "text", "held_out"), docs.where("not held_out").select("text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.leaks(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(documents(spark, sf_dir).select("doc_id", "text"), packing.public_tokenizer())
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = codes.train(vectors)
    coded = codes.with_group_errors(codes.encode(vectors, books).drop("embedding"), "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_quality": op2_quality,
    "op3_linededup": op3_linededup,
    "op4_lm": op4_lm,
    "op5_embeddings": op5_embeddings,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_langid": op9_langid,
    "op10_decontaminate": op10_decontaminate,
    "op11_whiten": op11_whiten,
    "op12_pack": op12_pack,
    "op13_codes": op13_codes,
}
