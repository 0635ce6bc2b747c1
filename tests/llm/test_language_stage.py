import base64
import random

import corpus_pipeline
from pyspark.sql import functions as F

FINNISH = (
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava "
    "toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin "
)


def test_noise_goes_and_clean_texts_stay(spark):
    rnd = random.Random(3)
    noise = []
    for n in (300, 1000, 5000):
        for _ in range(5):
            noise.append(" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n // 6)))
            noise.append(base64.b64encode(rnd.randbytes(n * 3 // 4)).decode())
        noise.append((FINNISH * 20)[:n])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1 - i, t, None, "noise", len(t)) for i, t in enumerate(noise)], docs.schema)
    got = corpus_pipeline.language(spark, docs.unionByName(extra), "").select("doc_id").collect()
    kept = {r.doc_id for r in got}
    assert not [i for i in kept if i < 0]
    clean = docs.where(F.length("text") >= 100).withColumn("w", F.split("text", r"\s+")).where(F.size(F.array_distinct("w")) >= 0.2 * F.size("w"))
    clean = {r.doc_id for r in clean.select("doc_id").collect()}
    assert len(clean) > 800 and clean <= kept
