"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may occur in a document with up to k = floor(error_rate * n) word edits. Cut the item in k + 1 pieces:
whatever the edits, one piece occurs unchanged. Documents are streamed once; rolling hashes of all word windows are looked up
in the table of pieces, each hit gives a window of the document, and the window is verified with Myers' bit-parallel
approximate matching. The item table is taken in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused
from .textnp import Words, batches_of

_MUL = np.uint64(0x100000001B3)
#: Words of test items that one pass ships to the workers (8 bytes each, and as much for pieces).
BLOCK_WORDS = 2_000_000


def folded(texts) -> Words:
    """Words of the comparison: runs of letters and digits in lower case."""
    return Words([t.lower() if t else "" for t in texts], folded=True)


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance between ``pattern`` and any part of ``text`` (both are lists of word hashes)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best = score
    return best


class Items:
    """A block of test items with the sorted table of their pieces."""

    def __init__(self, ids: list[int], texts: list[str], error_rate: float, least_words: int):
        w = folded(texts)
        h = w.hash
        self.ids, self.words, self.budget = [], [], []
        hashes, owner, offset, length = [], [], [], []
        for i, a, b in zip(ids, w.doc[:-1], w.doc[1:], strict=True):
            n = int(b - a)
            if n < least_words:
                continue
            k = int(n * error_rate)
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                acc = 0
                for v in h[a + x : a + y].tolist():
                    acc = (acc * int(_MUL) + v) & 0xFFFFFFFFFFFFFFFF
                hashes.append(acc)
                owner.append(len(self.ids))
                offset.append(x)
                length.append(y - x)
            self.ids.append(i)
            self.words.append(h[a:b].copy())
            self.budget.append(k)
        at = np.lexsort((np.array(hashes, np.uint64), np.array(length, np.int64)))
        self.hash, self.owner, self.offset, self.length = (np.array(x, t)[at] for x, t in ((hashes, np.uint64), (owner, np.int64), (offset, np.int64), (length, np.int64)))
        self.bits = max(16, int(np.ceil(np.log2(len(hashes) + 1))) + 8)

    def by_length(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """For each piece length: where its pieces are, and a bitmap of their low hash bits."""
        for n in np.unique(self.length):
            part = slice(*np.searchsorted(self.length, [n, n + 1]))
            seen = np.zeros(1 << self.bits, bool)
            seen[self.hash[part] & np.uint64(len(seen) - 1)] = True
            yield int(n), part, seen


def find(items: Items, tables: list, texts) -> list[list[tuple[int, int]]]:
    """For each text the (item id, edit distance) of every item that occurs in it within its budget."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    w = folded(texts)
    h = w.hash
    if not len(h):
        return out
    doc_of = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))
    spots = []
    acc, done = np.zeros(len(h), np.uint64), 0
    for n, part, seen in tables:
        while done < n and len(acc):
            acc = (acc[: len(h) - done] * _MUL) + h[done:]
            done += 1
        if len(h) < n:
            break
        at = np.flatnonzero(seen[acc & np.uint64(len(seen) - 1)])
        at = at[doc_of[at] == doc_of[at + n - 1]]
        table = items.hash[part]
        lo, hi = np.searchsorted(table, acc[at], "left"), np.searchsorted(table, acc[at], "right")
        for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
            for j in range(part.start + a, part.start + b):
                spots.append((doc_of[p], items.owner[j], p - items.offset[j]))
    last = None
    for d, i, start in sorted(set(spots)):
        k, pattern = items.budget[i], items.words[i]
        lo, hi = max(w.doc[d], start - k), min(w.doc[d + 1], start + len(pattern) + k)
        if last and last[:2] == (d, i) and lo <= last[3]:
            last = (d, i, last[2], max(hi, last[3]))
        else:
            _verify(items, h, last, out)
            last = (d, i, lo, hi)
    _verify(items, h, last, out)
    return out


def _verify(items: Items, h: np.ndarray, window, out) -> None:
    if window is None:
        return
    d, i, lo, hi = window
    got = myers(items.words[i].tolist(), h[lo:hi].tolist())
    if got <= items.budget[i]:
        out[d].append((items.ids[i], got))


def _blocks(items: DataFrame, error_rate: float, least_words: int) -> Iterator[Items]:
    ids, texts, words = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        words += len((row.text or "").split())
        if words >= BLOCK_WORDS:
            yield Items(ids, texts, error_rate, least_words)
            ids, texts, words = [], [], 0
    if ids:
        yield Items(ids, texts, error_rate, least_words)


def _matches(shipped):
    @F.pandas_udf("array<struct<item_id:long,distance:int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = shipped.value
        tables = list(items.by_length())
        for s in parts:
            got = []
            for piece in batches_of(s):
                for found in find(items, tables, piece):
                    best: dict[int, int] = {}
                    for i, dist in found:
                        best[i] = min(dist, best.get(i, dist))
                    got.append([{"item_id": i, "distance": x} for i, x in sorted(best.items())])
            yield pd.Series(got)

    return run


def report(items: DataFrame, error_rate: float = 0.2, least_words: int = 4) -> DataFrame:
    """``item_id, n_words, budget, status`` of every item: ``matched``, ``too_short`` (fewer than ``least_words`` words) or ``no_id``."""
    n = F.coalesce(F.size(F.filter(F.split(F.lower("text"), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), lambda w: w != "")), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    status = F.when(F.col("item_id").isNull(), "no_id").when(n < least_words, "too_short").otherwise("matched")
    return items.select("item_id", n.alias("n_words"), F.floor(n * error_rate).cast("long").alias("budget"), status.alias("status"))


def leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.2, least_words: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, distance), one entry per item found in the document, by item id.

    ``items`` has ``item_id`` (not null) and ``text``. Items of fewer than ``least_words`` words (null and empty texts among
    them) are too short to tell a leak from chance and never match; ``report`` names them. Of repeated item ids the nearest
    match is given. A null or empty text has no leaks; texts are searched whole, however long. Repeated rows each get their row,
    an empty table gives none; of ``docs`` a column named ``leaks`` is replaced, all others stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = []
    for k, block in enumerate(_blocks(items.select(F.col("item_id").cast("long"), "text").where("item_id is not null").orderBy("item_id"), error_rate, least_words)):
        if block.ids:
            found.append(unused(docs, f"leaks_{k}"))
            docs = docs.withColumn(found[-1], _matches(spark.sparkContext.broadcast(block))(F.col(f"`{text}`")))
    empty = F.array().cast("array<struct<item_id:bigint,distance:int>>")
    return docs.withColumn("leaks", F.concat(*found) if len(found) > 1 else F.col(found[0]) if found else empty).drop(*found)
