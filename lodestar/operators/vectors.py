"""Hashing embedder: stems, pairs of stems and trigrams of characters are hashed into buckets; tokens are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slicing import bounded_batches

#: Words that are dropped, endings that are cut (the first that applies), the hash's start and factor, weights.
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by", "at", "be", "this", "that", "are", "was", "will", "if", "not")
ENDINGS = ("ing", "edly", "ed", "es", "s")
START, FACTOR = 2166136261, 16777619
WORD, TRIGRAM = 1.0, 0.25
DIM = 512
#: Texts that a worker looks at at once.
TEXTS = 256


def _without_ending(word: Column) -> Column:
    """The word without the first of the endings that leaves it three bytes."""
    out = word
    for end in reversed(ENDINGS):
        fits = word.endswith(end) & (F.octet_length(word) - len(end) >= 3)
        out = F.when(fits, F.left(word, F.length(word) - len(end))).otherwise(out)
    return out


def _without_e(word: Column) -> Column:
    return F.when(word.endswith("e") & (F.octet_length(word) > 3), F.left(word, F.length(word) - 1)).otherwise(word)


def words(text: Column) -> Column:
    """Stems of the runs of letters and digits that have two bytes or more and are no stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    kept = F.filter(runs, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP))
    return F.transform(F.transform(kept, _without_ending), _without_e)


def fnv1a(parts: list[bytes], start: np.ndarray | None = None) -> np.ndarray:
    """The 32-bit FNV-1a hashes of byte strings, all at once, a byte of each a step; ``start`` goes on from the hashes of what stands before them."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(-size, kind="stable")
    data, begin = np.frombuffer(b"".join(parts), np.uint8), (np.cumsum(size) - size)[order]
    h = np.full(len(parts), START, np.uint32) if start is None else start[order].astype(np.uint32)
    left = np.searchsorted(-size[order], -np.arange(size.max(initial=0)))  # how many are longer than each number of bytes
    for k, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ data[begin[:n] + k]) * np.uint32(FACTOR)
    out = np.empty_like(h)
    out[order] = h
    return out


def _sums(stems: pa.ListArray, dim: int) -> np.ndarray:
    """Summed weights by text and bucket: stems and pairs of neighbours weigh 1, trigrams of stems of four bytes or more 0.25."""
    size = np.asarray(stems.value_lengths().fill_null(0), np.int64)
    told = stems.flatten().dictionary_encode()
    names, at, text = told.dictionary.to_pylist(), np.asarray(told.indices, np.int64), np.repeat(np.arange(len(stems)), size)
    data, k = [x.encode() for x in names], len(names)
    own = fnv1a(data) % dim
    grams = [[("#" + x[i : i + 3]).encode() for i in range(len(x) - 2)] if len(y) >= 4 else [] for x, y in zip(names, data, strict=True)]
    many = np.fromiter(map(len, grams), np.int64, k)
    gram = fnv1a([g for one in grams for g in one]) % dim
    seen, times = np.unique(text * k + at, return_counts=True)
    n = many[seen % k] if k else many
    ends = np.cumsum(n)
    which = gram[np.repeat((np.cumsum(many) - many)[seen % k] - ends + n, n) + np.arange(ends[-1])] if k and ends[-1] else gram[:0]
    next_to = np.flatnonzero(text[1:] == text[:-1])
    pair, back = np.unique(at[next_to] * k + at[next_to + 1], return_inverse=True)
    spaced = fnv1a([x + b" " for x in data])
    both = fnv1a([data[j] for j in (pair % k).tolist()], spaced[pair // k]) % dim if len(pair) else own[:0]
    place = np.concatenate([text * dim + own[at], text[next_to] * dim + both[back], np.repeat(seen // max(k, 1), n) * dim + which])
    weight = np.concatenate([np.full(len(at) + len(next_to), WORD), np.repeat(times, n) * TRIGRAM])
    return np.bincount(place.astype(np.int64), weight, len(stems) * dim).reshape(len(stems), dim)


def embedded(text: Column, dim: int = DIM) -> Column:
    """Dense unit vectors: 1 + ln of a bucket's summed weights; a text without features, or a null one, has the zero vector."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(stems: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(stems), TEXTS):
            sums = _sums(stems.slice(k, TEXTS), dim)
            w = np.where(sums > 0, 1 + np.log(np.where(sums > 0, sums, 1)), 0.0)
            size = np.sqrt((w * w).sum(axis=1))[:, None]
            out.append(w / np.where(size > 0, size, 1))
        flat = np.concatenate([np.zeros((0, dim)), *out])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * dim, pa.int32()), pa.array(flat.ravel()))

    return run(words(text))


def embed(docs: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """``key, embedding``: a row per text, which never leaves its task."""
    bounded_batches(docs)
    return docs.select(F.col(key), embedded(F.col(text), dim).alias("embedding"))


def weights(docs: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """``key, bucket, weight`` of the buckets that a text fills."""
    each = embed(docs, key, text, dim).select(key, F.posexplode("embedding").alias("bucket", "weight"))
    return each.where("weight <> 0").withColumn("bucket", F.col("bucket").cast("long"))


def remote(call: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64):
    """A column function that embeds texts through ``call``, a batch at a time in the workers; a batch that fails, or a vector of another length, is zero."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for a in range(0, len(s), batch):
                texts = [x or "" for x in s.iloc[a : a + batch]]
                try:
                    got = call(texts)
                except Exception:  # noqa: BLE001  an outage gives vectors that match nothing
                    got = []
                got = got if len(got) == len(texts) else [[]] * len(texts)
                out += [[float(x) for x in v] if len(v) == dim else [0.0] * dim for v in got]
            yield pd.Series(out, dtype=object)

    return run
