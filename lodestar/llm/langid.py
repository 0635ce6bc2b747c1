"""Language identification with hyperdimensional profiles.

Every letter class has a fixed random vector of +1/-1. A letter trigram is bound as rot2(first) * rot1(second) * third, where
rotK permutes the components cyclically; a text's vector is the bundle (sum) of its trigrams, a language prototype the bundle
of all its training texts. The prediction is the prototype of largest cosine. Bundling is linear, so texts are first counted
by trigram and each distinct trigram's vector is used once, weighted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused
from .textnp import batches_of

#: Letter classes: 0 is whatever is no letter, 1-26 are a-z, the rest are the other letters by code point.
CLASSES, DIM = 40, 512
#: Prototypes that a text is compared with at once; a prototype has 2 KB, and all are shipped to every worker.
BLOCK = 4096
_state: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Letter class of every code point."""
    if "classes" not in _state:
        out = np.zeros(0x110000, np.uint8)
        points = [c for c in range(0x80, 0x110000) if chr(c).isalpha()]
        low = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in points])
        out[points] = 27 + low % (CLASSES - 27)
        for c in range(26):
            out[65 + c] = out[97 + c] = c + 1
        _state["classes"] = out
    return _state["classes"]


def letters() -> np.ndarray:
    """The random vector of each letter class."""
    return np.random.default_rng(977).choice(np.array([-1, 1], np.int8), (CLASSES, DIM))


def bound(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes."""
    v = letters()
    return (np.roll(v, 2, 1)[codes // CLASSES**2] * np.roll(v, 1, 1)[codes // CLASSES % CLASSES] * v[codes % CLASSES]).astype(np.float32)


def trigrams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of a batch, with where each text's codes begin and end, and whether it has a letter."""
    raw = [t or "" for t in texts]
    joined = "  ".join(raw)
    sym = classes()[np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 2 for x in raw], out=starts[1:])
    edge = np.zeros(len(sym), bool)
    edge[starts[:-1]] = True  # runs of what is no letter shrink to one, but the ends of a text stay
    keep = (sym > 0) | edge
    keep[1:] |= sym[:-1] > 0
    place = np.concatenate(([0], np.cumsum(keep)))
    s = sym[keep].astype(np.int32)
    codes = (s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:] if len(s) > 2 else np.zeros(0, np.int32)
    begin, end = place[starts[:-1]], np.maximum(place[starts[1:]] - 2, place[starts[:-1]])
    has = np.add.reduceat(sym > 0, starts[:-1]) > 0 if len(raw) else np.zeros(0, bool)
    return codes, np.stack([begin, end], 1), has


def _count(parts):
    held: dict[str, np.ndarray] = {}

    def rows():
        out = [pd.DataFrame({"lang": lang, "code": (at := np.flatnonzero(n)).astype(np.int32), "n": n[at]}) for lang, n in held.items()]
        held.clear()
        return out

    for pdf in parts:
        for piece in batches_of(pdf["text"]):
            codes, spans, _ = trigrams(piece)
            for lang, at in pdf.loc[piece.index].groupby("lang").indices.items():
                if lang not in held:
                    if len(held) >= 64:
                        yield from rows()
                    held[lang] = np.zeros(CLASSES**3, np.int64)
                own = [codes[a:b] for a, b in spans[at] if b > a]
                if own:
                    held[lang] += np.bincount(np.concatenate(own), minlength=CLASSES**3)
    yield from rows()


def _bundle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(DIM)
    for a in range(0, len(pdf), 4096):
        total += pdf["n"].to_numpy(np.float64)[a : a + 4096] @ bound(pdf["code"].to_numpy(np.int64)[a : a + 4096])
    return pd.DataFrame({"lang": [key[0]], "vector": [total / max(np.linalg.norm(total), 1e-12)]})


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit prototypes.

    ``labelled``: ``text``, ``lang``; nulls in either teach nothing, nor do texts without letters; repeated rows count as often as
    they occur. An empty table gives no languages, and then every prediction is ``und``.
    """
    small_batches(labelled.sparkSession)
    counts = labelled.select("text", "lang").where("lang is not null and text is not null").mapInPandas(_count, "lang string, code int, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInPandas(_bundle, "lang string, vector array<double>").collect()  # a row per language
    rows.sort(key=lambda r: r.lang)
    return [r.lang for r in rows], np.array([r.vector for r in rows], np.float32).reshape(-1, DIM)


class Vectors:
    """Trigram vectors made when first needed; at most CLASSES**3 rows of DIM floats."""

    def __init__(self):
        self.row = np.full(CLASSES**3, -1, np.int32)
        self.of = np.zeros((0, DIM), np.float32)
        self.used = 0

    def get(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row[codes] < 0]
        if len(new):
            if self.used + len(new) > len(self.of):
                more = np.zeros((min(CLASSES**3, max(4096, self.used + len(new), len(self.of) * 3 // 2)), DIM), np.float32)
                more[: self.used] = self.of[: self.used]
                self.of = more
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.of[self.used : self.used + len(new)] = bound(new.astype(np.int64))
            self.used += len(new)
        return self.of[self.row[codes]]


def predict_batch(texts, langs: list[str], prototypes: np.ndarray, vectors: Vectors) -> tuple[list[str], list[float]]:
    codes, spans, has = trigrams(texts)
    pred, score = [], []
    for (a, b), ok in zip(spans, has, strict=True):
        if not ok or not langs or b <= a:
            pred.append("und")
            score.append(0.0)
            continue
        n = np.bincount(codes[a:b])
        at = np.flatnonzero(n)
        v = np.zeros(DIM, np.float32)
        for x in range(0, len(at), 2048):
            v += n[at[x : x + 2048]].astype(np.float32) @ vectors.get(at[x : x + 2048])
        v /= max(float(np.linalg.norm(v)), 1e-12)
        k, best = 0, -np.inf
        for x in range(0, len(langs), BLOCK):
            cos = prototypes[x : x + BLOCK] @ v
            if cos.max() > best:  # of equal ones the first in code point order
                k, best = x + int(np.argmax(cos)), float(cos.max())
        pred.append(langs[k])
        score.append(min(1.0, max(0.0, best)))
    return pred, score


def predictor(langs: list[str], prototypes: np.ndarray):
    """A column function: struct of ``lang_pred`` (``und`` for null texts and texts without letters) and ``score`` (0 to 1)."""

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for s in parts:
            pred, score = [], []
            for piece in batches_of(s):
                p, c = predict_batch(piece, langs, prototypes, vectors)
                pred += p
                score += c
            yield pd.DataFrame({"lang_pred": pd.Series(pred, dtype=object), "score": pd.Series(score, dtype=float)})

    return run


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learnt from ``labelled`` (``text``, ``lang``).

    Null texts and texts without letters are ``und`` with score 0. Texts are read whole, however long. Of languages of equal cosine the
    first in code point order is given; a cosine below 0 counts as 0. Columns of ``docs`` named like ours are replaced, all others stay.
    """
    model = predictor(*learn(labelled))
    small_batches(docs.sparkSession)
    name = unused(docs, "lang")
    out = docs.withColumn(name, model(F.col(f"`{text}`")))
    return out.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)
