import random

import corpus_pipeline
import numpy as np
from lodestar.llm import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rnd, words, least, most):
    """A copy with so many words replaced that its similarity lies in the range."""
    while True:
        out = list(words)
        while similarity(" ".join(words), " ".join(out)) > most:
            out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**9)}"
        if similarity(" ".join(words), " ".join(out)) >= least:
            return " ".join(out)


def test_near_copies_of_every_similarity(spark):
    rnd = random.Random(4)
    rows, copies, clean = [], set(), set()
    for k in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(120, 400))]
        rows.append((10 * k, " ".join(words)))
        for j, (least, most) in enumerate([(0.8, 0.85), (0.85, 0.9), (0.9, 0.95)]):
            rows.append((10 * k + 1 + j, edited(rnd, words, least, most)))
            copies.add(10 * k + 1 + j)
        rows.append((10 * k + 5, edited(rnd, words, 0.55, 0.72)))
        clean |= {10 * k, 10 * k + 5}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == clean


def test_rows_not_ids_decide(spark):
    copy = "one text of quite enough words to be compared with others"
    rows = [(1, copy), (1, copy), (None, copy), (5, copy), (5, "a clean text which shares its id with a copy of another one")]
    rows += [(None, "this text has only rows without an id to its name")] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, copy), (5, rows[4][1]), (0, rows[5][1])])


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK", 6)
    rnd = random.Random(8)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    base = [[f"v{rnd.randrange(300)}" for _ in range(rnd.randint(20, 120))] for _ in range(8)]
    for _ in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(3)}"
        texts.append(" ".join(w))
    got = {r.row: r.component for r in shingles.groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                root[find(a)] = find(b)
    assert len(got) == len(texts)
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in got for b in got if find(a) == find(b)}
    assert shingles.groups(spark.createDataFrame([], "row long, text string")).count() == 0


def test_odds_of_a_band():
    rnd = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        x = rnd.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = np.sort(x[:162]), np.sort(x[18:])
        missed += not set(shingles.bands(a)) & set(shingles.bands(b))
    assert missed == 0
