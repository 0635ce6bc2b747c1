import random

import numpy as np
from lodestar.llm import quality
from pyspark.sql import functions as F


def test_learns_ordered_grades(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        g = i % 3
        words = [f"w{rnd.randrange(300)}" for _ in range(30)] + {0: ["awful"] * 2, 1: ["meh%%", "so%%"], 2: []}[g]
        rnd.shuffle(words)
        rows.append((i, " ".join(words), g))
    df = spark.createDataFrame(rows + [(900, None, 2), (901, "", None)], "doc_id long, text string, grade int")
    got = quality.classify(df.withColumn("kept", F.lit("clash")), df.where("doc_id < 400")).where("doc_id >= 400").collect()
    held = [r for r in got if r.doc_id < 600]
    mean = [np.mean([r.expected_grade for r in held if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    best = sorted(held, key=lambda r: -r.tail)[: len(held) // 3]
    assert np.mean([r.grade == 2 for r in best]) > 0.9
    assert len(got) == 202 and all(0 <= r.tail <= 1 for r in got)


def test_features_against_plain():
    texts = ["The cat  the CAT", None, "", "dog!!"]
    at, rows = quality.features(texts)
    assert np.diff(rows).tolist() == [2 + 2, 0, 0, 2]


def test_gradient_lowers_loss():
    at = np.array([1, 2, 1, 3, 2])
    model = quality.Ordinal(3).fit(at, np.array([0, 1, 2, 3, 4, 5]), np.array([0, 1, 0, 2, 1]), steps=300, least=1)
    p = model.tails(model.weights[at])
    assert p[0, 0] < 0.3 and p[3, 1] > 0.6 and model.thresholds[0] < model.thresholds[1]


def test_no_ratings(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("grade", F.lit(None).cast("int"))
    assert quality.classify(df, df).count() == 1
