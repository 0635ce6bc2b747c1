"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Counting sends sorted, pre-summed arrays of hashes, not words: one row per batch and shard. A shard is a range of hashes of the
first word, so that all that follows a word meets in one place; the few words that make up more than a fraction of the corpus
are dealt by the second word instead and their totals are added up afterwards. Each shard writes its arrays to a file in the
shared folder; scoring workers map those files and search them with whole batches of sorted keys.

A word is 64 bits of hash in the unigram arrays. A bigram key is 64 bits: 28 of the first word, besides those that choose the
shard, and 36 of the second. Among a million words about 7 pairs share the second part, among 3 million words in 32 shards about 500 pairs
share the first.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, new_folder, release, small_batches, unused
from .textnp import Words, batches_of, mix64, sum_by_doc

END, BEGIN = (mix64(np.array([x], np.uint64))[0] for x in (0xE0D, 0xB06))
FLUSH = 1 << 22
SHARD_TOKENS = 1 << 22
#: Files of arrays that a worker keeps mapped; a shard has one for each of its three tables.
OPEN = 256
FILE_OF = {"word": "words", "count": "words", "second": "seconds", "second_n": "seconds"} | dict.fromkeys(("pair", "pair_n", "pair_over", "first", "stats"), "pairs")
_U = np.uint64


def _path(folder: str, name: str) -> tuple[object, str]:
    """File system (None: a folder that every worker mounts) and path."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        return None, f"{at.path}/{name}"
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    return system, path


def put(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays to one file: the length of a list of (name, type, shape, place), the list, then the arrays at multiples of 64."""
    at, told, flat = 0, [], []
    for key, x in arrays.items():
        x = np.ascontiguousarray(x)
        told.append([key, x.dtype.str, x.shape, at])
        flat.append(x.tobytes() + bytes(-x.nbytes % 64))
        at += len(flat[-1])
    head = json.dumps(told).encode()
    head += b" " * (-(len(head) + 8) % 64)
    data = len(head).to_bytes(8, "little") + head + b"".join(flat)
    system, path = _path(folder, name)
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)  # a task that runs twice writes the same
    else:
        with system.open_output_stream(path) as out:
            out.write(data)


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped from the shared folder; from a remote store it is first copied to an unlinked temporary file."""
    system, path = _path(folder, name)
    if system is None:
        return _arrays(np.memmap(path, np.uint8, "r"))
    with tempfile.NamedTemporaryFile(suffix=".arrays") as f, system.open_input_stream(path) as src:
        while block := src.read(1 << 24):
            f.write(block)
        f.flush()
        return _arrays(np.memmap(f.name, np.uint8, "r"))


def _arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    n = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for key, kind, shape, at in json.loads(raw[8:n].tobytes()):
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[key] = raw[n + at : n + at + size].view(kind).reshape(shape)
    return out


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their (summed) counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end for every text, the hashes of the words before them, and where each text's tokens begin."""
    w = Words(texts)
    h, n = w.hash, len(w.doc) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(w.doc))
    begin = w.doc + np.arange(n + 1)
    tokens = np.full(len(h) + n, END, _U)
    tokens[at] = h
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begin[:-1]] = BEGIN
    return tokens, before, begin


class Layout:
    """Shards, and the words whose followers are dealt by the follower."""

    def __init__(self, bits: int, hot: np.ndarray):
        self.bits, self.shards, self.hot = bits, 1 << bits, np.sort(hot)

    def word(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int32)

    def pair(self, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key."""
        at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
        hot = self.hot[at] == before
        shard = np.where(hot, self.shards + (h & _U(self.shards - 1)).astype(np.int32), self.word(before)).astype(np.int32)
        return shard, self.first(before) << _U(36) | h >> _U(28)

    def first(self, h: np.ndarray) -> np.ndarray:
        return (h << _U(self.bits)) >> _U(36)


def _rows(shard: np.ndarray, keys: np.ndarray) -> Iterator[dict]:
    order = np.argsort(shard, kind="stable")
    shard, keys = shard[order], keys[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        if b > a:
            k, n = summed(keys[a:b])
            yield {"shard": int(shard[a]), "keys": k.tobytes(), "counts": n.astype(np.uint32).tobytes()}


def _counter(layout: Layout, pairs: bool):
    def run(parts):
        held, size = [], 0

        def flush():
            return pd.DataFrame(list(_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))))

        for pdf in parts:
            for piece in batches_of(pdf["text"]):
                tokens, before, _ = _tokens(piece)
                held.append(layout.pair(before, tokens) if pairs else (layout.word(tokens), tokens))
                size += len(tokens)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, _U) for x in pdf["keys"]])
    return summed(keys, np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64))


PAYLOAD = "shard int, keys binary, counts binary"


def _words(folder: str, hot: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = _merged(pdf)
        put(folder, f"words-{key[0]}", word=k, count=n)
        return pd.DataFrame({"shard": [key[0]], "types": [len(k)], "tokens": [int(n.sum())], "hot": [k[n > hot].view(np.int64).tolist()]})

    return run


def _pairs(folder: str, layout: Layout):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        k, n = _merged(pdf)
        over = np.flatnonzero(n >= 65535)
        held = {"pair": k, "pair_n": np.minimum(n, 65535).astype(np.uint16), "pair_over": np.stack([over, n[over]])}
        first = k >> _U(36)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        stats = np.stack([np.add.reduceat(x, starts) for x in (n, n == 1, n == 2, n > 2)]).astype(np.int64)
        if shard < layout.shards:
            held |= {"first": first[starts].astype(np.uint32), "stats": stats}
        put(folder, f"pairs-{shard}", **held)
        # one row per shard of the second word: how many different first words precede it
        second, times = summed(k & _U((1 << 36) - 1))
        to = (second >> _U(36 - layout.bits)).astype(np.int32)
        cuts = np.searchsorted(to, np.arange(layout.shards + 1))
        rows = [{"shard": s, "keys": second[a:b].tobytes(), "counts": times[a:b].astype(np.uint32).tobytes()} for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        sizes = [int((n == x).sum()) for x in (1, 2, 3, 4)]
        hot = first[starts].view(np.int64).tolist() if shard >= layout.shards else []
        rows.append({"shard": -1 - shard, "keys": np.array(sizes + [len(k)], np.int64).tobytes(), "counts": (np.array(hot, np.int64).tobytes() + (stats.tobytes() if hot else b""))})
        return pd.DataFrame(rows)

    return run


def _followers(folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = _merged(pdf)
        put(folder, f"seconds-{key[0]}", second=k, second_n=n)
        return pd.DataFrame({"n": [[int((n == x).sum()) for x in (1, 2, 3, 4)]], "types": [len(k)], "total": [int(n.sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0 to 3 and more; where the counts of counts give none, half, one and one and a half."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2 if n3 else out[2]
        out[3] = 3 - 4 * y * n4 / n3 if n3 and n4 else out[3]
    return np.clip(out, 0, [0, 1, 2, 3])


class Model:
    """What workers need to score: the folder of arrays and the totals."""

    def __init__(self, folder: str, layout: Layout, tokens: int, types: int):
        self.folder, self.layout, self.tokens, self.types = folder, layout, tokens, types
        self.d2 = self.d1 = discounts(0, 0, 0, 0)
        self.word_shards: set[int] = set()
        self.pair_shards: set[int] = set()
        self.second_shards: set[int] = set()
        self.hot: dict[int, np.ndarray] = {}
        self.total, self.second_types = 0, np.zeros(4)
        self._open: dict[str, dict[str, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def array(self, name: str, shard: int) -> np.ndarray:
        """An array of a shard. At most OPEN files stay mapped, those that were used last."""
        file = f"{FILE_OF[name]}-{shard}"
        held = self._open.pop(file, None)
        if held is None:
            while len(self._open) >= OPEN:
                del self._open[next(iter(self._open))]
            held = mapped(self.folder, file)
        self._open[file] = held
        return held[name]

    def _search(self, shards: np.ndarray, keys: np.ndarray, known: set[int], table: str, read) -> None:
        """Calls ``read(shard, rows of the batch, places in the table)`` for the keys that the table holds."""
        order = np.argsort(shards, kind="stable")
        cuts = np.flatnonzero(np.diff(shards[order])) + 1
        for part in np.split(order, cuts):
            if len(part) and (s := int(shards[part[0]])) in known:
                part = part[np.argsort(keys[part])]
                held, want = self.array(table, s), keys[part]
                at = np.searchsorted(held, want)
                at[at == len(held)] = 0
                ok = held[at] == want
                read(s, part[ok], at[ok])

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        self._search(self.layout.word(h), h, self.word_shards, "word", lambda s, rows, at: out.__setitem__(rows, self.array("count", s)[at]))
        return out

    def unigram(self, h: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with the uniform one."""
        n = np.zeros(len(h), np.int64)
        self._search(self.layout.word(h), h >> _U(28), self.second_shards, "second", lambda s, rows, at: n.__setitem__(rows, self.array("second_n", s)[at]))
        if not self.total:
            return np.full(len(h), 1 / (self.types + 1))
        rest = float(self.d1[1:] @ self.second_types[1:]) / self.total
        return np.maximum(n - self.d1[np.minimum(n, 3)], 0) / self.total + rest / (self.types + 1)

    def context(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total of the followers of each word, and the mass left by discounting."""
        stats = np.zeros((4, len(h)))
        key = self.layout.first(h).astype(np.uint32)
        self._search(self.layout.word(h), key, {s for s in self.pair_shards if s < self.layout.shards}, "first", lambda s, rows, at: stats.__setitem__((slice(None), rows), self.array("stats", s)[:, at]))
        at = np.minimum(np.searchsorted(self.layout.hot, h), len(self.layout.hot) - 1)
        for i in np.flatnonzero(self.layout.hot[at] == h):
            stats[:, i] = self.hot.get(int(h[i]), np.zeros(4))
        total = stats[0]
        return total, np.divide(self.d2[1:] @ stats[1:], total, out=np.ones(len(h)), where=total > 0)

    def score(self, texts) -> pd.DataFrame:
        tokens, before, begin = _tokens(texts)
        u, back = np.unique(tokens, return_inverse=True)
        c = self.word_counts(u)
        base = np.log10((c + 1) / (self.tokens + (self.types + 1)))
        low = self.unigram(u)[back]
        v, back_v = np.unique(before, return_inverse=True)
        total, left = (x[back_v] for x in self.context(v))
        n = np.zeros(len(tokens), np.int64)

        def read(s: int, rows: np.ndarray, at: np.ndarray) -> None:
            got = self.array("pair_n", s)[at].astype(np.int64)
            if (full := got == 65535).any():
                place, value = self.array("pair_over", s)
                got[full] = value[np.searchsorted(place, at[full])]
            n[rows] = got

        shard, key = self.layout.pair(before, tokens)
        self._search(shard, key, self.pair_shards, "pair", read)
        high = np.divide(np.maximum(n - self.d2[np.minimum(n, 3)], 0), total, out=np.zeros(len(n)), where=total > 0)
        p = high + np.where(total > 0, left, 1.0) * low
        return pd.DataFrame({"n_tokens": np.diff(begin), "n_known": sum_by_doc((c > 0)[back], begin).astype(np.int64), "base_score": sum_by_doc(base[back], begin), "score": sum_by_doc(np.log10(p), begin)})


def train(texts: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Model of the column ``text`` (null: empty). Every row is counted in full.

    The number of shards (a power of two, at least 32) follows the corpus, so that a shard has ``shard_tokens`` tokens at most on
    average, whatever the size; a word is dealt by its followers if it would fill an eighth of a shard.
    """
    spark = texts.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "ngram")
    texts = texts.select("text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1
    tokens = texts.agg(F.sum(size.cast("long"))).first()[0] or 0
    bits = max(5, ((tokens - 1) // shard_tokens).bit_length()) if tokens else 5
    shards = 1 << bits
    layout = Layout(bits, np.array([BEGIN], _U))
    rows = texts.mapInPandas(_counter(layout, False), PAYLOAD).groupBy("shard").applyInPandas(_words(folder, tokens / (8 * shards)), "shard int, types long, tokens long, hot array<long>").collect()
    types = sum(r.types for r in rows)
    hot = [w for r in rows for w in r.hot]  # fewer than 8 * shards
    layout = Layout(bits, np.unique(np.append(np.array(hot, np.int64).view(_U), BEGIN)))
    model = Model(folder, layout, sum(r.tokens for r in rows), types)
    model.word_shards = {r.shard for r in rows}
    release(spark)
    told = texts.mapInPandas(_counter(layout, True), PAYLOAD).groupBy("shard").applyInPandas(_pairs(folder, layout), PAYLOAD)
    path = f"{new_folder(spark, 'followers')}"
    told.write.option("compression", "none").parquet(path)
    release(spark)
    told = spark.read.schema(PAYLOAD).parquet(path)
    sizes = np.zeros(4, np.int64)
    first_of = {int(layout.first(np.array([h], _U))[0]): int(h) for h in layout.hot}
    for r in told.where("shard < 0").collect():  # a row per shard
        s = -1 - r.shard
        model.pair_shards.add(s)
        sizes += np.frombuffer(r["keys"], np.int64)[:4]
        if s >= shards:
            flat = np.frombuffer(r["counts"], np.int64)
            n = len(flat) // 5
            for word, stat in zip(flat[:n].tolist(), flat[n:].reshape(4, n).T, strict=True):
                model.hot[first_of[word]] = model.hot.get(first_of[word], np.zeros(4)) + stat
    model.d2 = discounts(*sizes.tolist())
    out = told.where("shard >= 0").groupBy("shard").applyInPandas(lambda key, pdf: _followers(folder)(key, pdf).assign(shard=key[0]), "n array<long>, types long, total long, shard int").collect()
    release(spark)
    model.second_shards = {r.shard for r in out}
    sizes = np.sum([r.n for r in out], axis=0) if out else np.zeros(4, int)
    model.d1 = discounts(*[int(x) for x in sizes])
    model.total = sum(r.total for r in out)
    kinds = sum(r.types for r in out)
    model.second_types = np.array([0, sizes[0], sizes[1], kinds - sizes[0] - sizes[1]], float)
    return model


def scorer(model: Model, spark):
    """A column function: struct of n_tokens, n_known, base_score and score (log10) of a text."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<n_tokens:long,n_known:long,base_score:double,score:double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for s in parts:
            got = [own.score(piece) for piece in batches_of(s)]
            yield pd.concat(got, ignore_index=True)

    return run


def score(docs: DataFrame, training: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, n_known, train_tokens, base_score, score`` and ``perplexity`` (10 to the mean negative log).

    Null texts count as empty: one token, the end. Texts are read whole, however long. Repeated training rows count as often as they
    occur; an empty training table gives the uniform model. Columns of ``docs`` named like ours are replaced, all others stay.
    """
    model = train(training)
    small_batches(docs.sparkSession)
    name = unused(docs, "lm")
    out = docs.withColumn(name, scorer(model, docs.sparkSession)(F.col(f"`{text}`")))
    out = out.withColumns({c: F.col(name)[c] for c in ("n_tokens", "n_known", "base_score", "score")}).drop(name)
    return out.withColumns({"train_tokens": F.lit(model.tokens).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})
