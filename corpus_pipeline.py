"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from lodestar.llm import decontaminate, langid, linededup, mixing, shingles
from lodestar.llm.common import documents, held_in, stage, unused
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language ID, fingerprints and mixing cannot be put in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None
#: A text whose best cosine is below LEAST_SCORE * (1 - exp(-n / SCALE)), n being its characters, resembles no language that was learnt.
#: Of 2,429 held-out texts of sf0.1 one is below (a word repeated, 0.24). Pieces of 10, 30, 80, 400 and 5,000 characters of such texts score
#: over 0.02, 0.08, 0.16, 0.14 and 0.36 in 99.5 % of cases; random letters and base64 of 120, 400 and 5,000 reach 0.16, 0.20 and 0.25.
LEAST_SCORE, SCALE = 0.27, 200.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; ``lang`` stays as it was.

    Null texts and texts without letters go; repeated rows and rows of one id are judged each by its text.
    """
    taught = docs.where(held_in("doc_id", 4) != 2).select("text", "lang")
    found, name = langid.predictor(*langid.learn(taught)), unused(docs, "lang")
    told = F.col(f"{name}.score") >= LEAST_SCORE * (1 - F.exp(-F.length("text") / SCALE))
    return docs.withColumn(name, found("text")).where((F.col(f"{name}.lang_pred") != "und") & told).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars`` is counted anew where the text has changed. Exact repeats go whatever their length.

    Every row stays: a text whose lines all stood earlier becomes empty, a null text stays null.
    """
    out = linededup.dedup_lines(docs, exact=1)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest id, then row; null ids come last.

    SimHash fingerprints of the shingles propose through their pivot distance tables, MinHash bands what lies beyond the fingerprints'
    reach, and the whole shingle sets decide. Texts without words are copies of one another.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    # rows are told apart by number: ids may repeat or be null
    own = stage(docs.select(whole).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = stage(shingles.groups(own.select("row", F.col("doc.text").alias("text"))), "groups").withColumnRenamed("row", "r")
    told = own.select("row", F.col("doc.doc_id").alias("id")).join(groups, F.col("row") == F.col("r"))
    told = stage(told.select("row", "component", F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("place")), "told")
    first = told.groupBy("component").agg(F.min("place").alias("first")).select(F.col("component").alias("c"), F.col("first.row").alias("kept"))
    gone = stage(told.join(first, F.col("component") == F.col("c")).where("row <> kept").select(F.col("row").alias("gone")), "copies")
    return own.join(gone, F.col("row") == F.col("gone"), "left_anti").select("doc.*")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none, and stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(docs, items).where(F.size("leaks") == 0).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with how many copies it takes of each; those without words are never taken, a null source is one of its own."""
    return mixing.mix(docs, carry=True).where("copies > 0")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("clean_of_benchmark", clean_of_benchmark), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
