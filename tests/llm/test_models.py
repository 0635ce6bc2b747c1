"""Predictions of language and quality, recomputed in plain Python from the fitted models."""

import math
import random

import numpy as np
import pytest
from lodestar.llm import langid, quality
from lodestar.llm.textnp import Words, mix64


def test_language_predictions(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 2)
    rnd = random.Random(5)
    parts = {"en": ["the", "of", "ing"], "fr": ["le", "ère", "eau"], "de": ["der", "ung", "ß"], "xx": ["zq", "qz", "é"], "yy": ["the", "of", "ing"]}
    rows = [(k, " ".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 30))), lang) for k, lang in enumerate(sorted(parts) * 8)]
    rows += [(900, None, "en"), (901, "12 !!", None), (902, "the", None), (903, "ÀÉ the", None), (904, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, df.where("doc_id < 30")).collect()}
    letters = langid.letters().astype(int).tolist()
    size = len(letters[0])

    def klass(c):
        if "a" <= c.lower() <= "z" and c.isascii():
            return ord(c.lower()) - 96
        low = c.lower() if len(c.lower()) == 1 else c
        return 27 + ord(low) % (langid.CLASSES - 27) if c.isalpha() else 0

    def bundle(text):
        symbols = []
        for s in [0, *map(klass, text), 0]:
            if s or not symbols or symbols[-1]:
                symbols.append(s)
        out = [0] * size
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            for k in range(size):
                out[k] += letters[a][k - 2] * letters[b][k - 1] * letters[c][k]
        return out

    langs = sorted({lang for k, _, lang in rows if k < 30})
    prototypes = [np.sum([bundle(t) for k, t, x in rows if k < 30 and x == lang], axis=0) for lang in langs]
    for k, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        v = np.array(bundle(t), float)
        cos = [float(p @ v / np.linalg.norm(p) / max(np.linalg.norm(v), 1e-12)) for p in prototypes]
        best = max(cos)
        assert got[k].score == pytest.approx(min(1, max(0, best)), abs=1e-5), (k, t)
        assert cos[langs.index(got[k].lang_pred)] >= best - 1e-5


def test_expected_grades():
    rnd = random.Random(2)
    model = quality.Ordinal(3)
    model.weights = np.random.default_rng(1).standard_normal(1 << quality.BITS)
    model.thresholds = np.array([-0.4, 0.7])
    texts = [" ".join(rnd.choice(["Alpha", "beta", "é", "ab", "x", "gamma-ray", "THE"]) for _ in range(rnd.randint(0, 12))) for _ in range(40)] + [None, "", " \n"]
    mask = (1 << quality.BITS) - 1
    for text, score in zip(texts, model.score(texts), strict=True):
        features = set()
        for w in (text or "").encode().lower().split():
            features.add(int(Words([w.decode()]).hash[0]) & mask)
            tail = int.from_bytes(w[-3:], "big")
            features.add(int(mix64(np.array([tail + 0x7A11], np.uint64))[0]) & mask)
        want = sum(model.weights[f] for f in features) / math.sqrt(max(len(features), 1))
        assert score == pytest.approx(want)
        tails = [1 / (1 + math.exp(t - want)) for t in model.thresholds]
        assert model.tails(np.array([score]))[0].tolist() == pytest.approx(tails) and sum(tails) == pytest.approx(model.tails(np.array([score])).sum())


def test_fitting_is_a_maximum():
    """No small step of a weight or a threshold raises the balanced likelihood that is climbed, beyond the ridge."""
    rnd = np.random.default_rng(3)
    n, at, rows, grade = 300, [], [0], []
    for _ in range(n):
        g = int(rnd.integers(0, 3))
        own = sorted({int(x) for x in rnd.integers(0, 12, 4)} | {20 + g if rnd.random() < 0.6 else 20 + int(rnd.integers(0, 3))})
        at += own
        rows.append(len(at))
        grade.append(g)
    at, rows, grade = np.array(at), np.array(rows), np.array(grade)
    model = quality.Ordinal(3).fit(at, rows, grade, steps=800)

    def likelihood(weights, thresholds):
        size = np.diff(rows)
        score = np.bincount(np.repeat(np.arange(n), size), weights[at], n) / np.sqrt(size)
        p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-(score[:, None] - thresholds))), np.zeros((n, 1))])
        balance = 1 / np.bincount(grade, minlength=3)[grade]
        return float((np.log(p[np.arange(n), grade] - p[np.arange(n), grade + 1]) * balance / balance.sum()).sum()) - 5e-6 * float((weights**2).sum())

    best = likelihood(model.weights, model.thresholds)
    for k in sorted(set(at.tolist())):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert likelihood(w, model.thresholds) <= best + 2e-4
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[22] > model.weights[21] > model.weights[20]
