"""Packing of tokenised documents into sequences of a fixed capacity: large-item matching, then best fit.

Tasks tokenise texts and cut what is longer than a sequence. How many pieces have which length is a table of no more rows than a
sequence has tokens; the plan is made on it, for all pieces at once, and a run of equal sequences is one row of it:

* pieces above a third of the capacity meet at most two to a sequence: the largest takes the largest partner that still fits;
* the others, largest first, each go to the sequence with the smallest gap that takes them, or open a new one.

A piece's turn among those of its length follows from counts by task, so that no length, however common, is sorted in one place; the plan
then says where the piece of that turn lies.

Defined cases: a null text counts as empty, and an empty text is a piece of the closing id alone; every row is packed, rows of equal or null
ids too; an empty table gives no rows. Very long texts are tokenised in slices that end at ASCII blanks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, small_batches, stage, unused

CAPACITY = 2048
#: Words whose ids a worker remembers, and their parts, about (more only within a text); the longest word, in bytes, that it does.
WORDS, LONGEST = 500_000, 64
#: Words that are parted here, and their parts as the tokenizer has them, in lower case. Its pattern, for these letters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
PIECE = ("piece", "start", "length", "ids", "task", "turn")


class Encoder:
    """Ids of texts by a tokenizer that drops white space and never joins what it parts: normal form, lower case, runs of letters, single digits, runs of other signs.

    A text is parted at ASCII blanks. Words are remembered with their ids; new words of plain Latin letters are parted further, and of those
    parts only new ones are encoded, all at once. Other new words (other letters, control characters, what may be a special token) are encoded as they are.
    """

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        whole = zlib.decompress(model).decode()
        self.own = Tokenizer.from_str(whole)
        # the same merges without what new parts no longer need: normal form, lower case, special tokens, parting by signs
        bare = json.loads(whole) | {"normalizer": None, "added_tokens": [], "post_processor": None}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        ends = [i for token, i in self.own.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.own.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.parts: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.forget()

    def forget(self) -> None:
        if len(self.parts) > WORDS:
            self.parts = {}
        self.place: dict[bytes, int] = {}
        self.last, self.flat = array("q", [0]), array("I")  # where the ids of each word end, and all ids

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def _own(self, text: str) -> bytes:
        return np.array(self.encode(text), np.uint32).tobytes()

    def _new_parts(self, parts: list[str]) -> None:
        ids = np.array(self.bare.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) == len(parts):
            self.parts.update(zip(parts, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        else:
            self.parts.update((p, self._own(p)) for p in parts)

    def learn(self, words: set[bytes]) -> None:
        whole = [w for w in words if w.isalpha()]  # ASCII letters alone: a word is its one part
        lower = b" ".join(whole).lower().decode().split()
        told = [(w, PART.findall(text.lower()) if PLAIN.fullmatch(text) and "<|" not in text else None, text) for w in words.difference(whole) for text in (w.decode(),)]
        new = {p for _, parts, _ in told if parts for p in parts}.union(lower).difference(self.parts)
        if new:
            self._new_parts(list(new))
        ids = list(map(self.parts.__getitem__, lower))
        ids += [self._own(text) if parts is None else b"".join(map(self.parts.__getitem__, parts)) for _, parts, text in told]
        self.place.update(zip([*whole, *(w for w, _, _ in told)], range(len(self.place), len(self.place) + len(ids)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.flat.itemsize
        self.last.frombytes((self.last[-1] + np.cumsum(sizes)).tobytes())
        self.flat.frombytes(b"".join(ids))

    def _words(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > WORDS:
            self.forget()
        k = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(k < 0).tolist()
        if new:
            self.learn({words[j] for j in new})
            k[new] = [self.place[words[j]] for j in new]
        last = np.frombuffer(self.last, np.int64)
        begin, size = last[k], last[k + 1] - last[k]
        ends = np.cumsum(size)
        return np.frombuffer(self.flat, np.uint32)[np.repeat(begin - ends + size, size) + np.arange(ends[-1])] if len(ends) and ends[-1] else np.zeros(0, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        out, words = [], text.encode().split()
        for k in range(0, len(words), 100_000):
            own, at = words[k : k + 100_000], 0
            if max(map(len, own)) > LONGEST:
                for j, word in enumerate(own):
                    if len(word) > LONGEST:
                        out += [self._words(own[at:j]), np.array(self.encode(word.decode()), np.uint32)]
                        at = j + 1
            out.append(self._words(own[at:]))
        return np.concatenate([*out, np.zeros(0, np.uint32)])


_encoders: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """A worker's encoder; it keeps what it remembers from task to task."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def cut(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, close: int = 0) -> DataFrame:
    """A row per piece: the other columns of ``docs`` (but those named as a result's), piece, start, length and ``ids`` (little-endian 32-bit).

    ``tokenizer``: path of the tokenizer's file on the driver, sent to the tasks by broadcast (it doesn't grow with the data). ``task`` and ``turn``
    number the pieces of one length within a task, for ``place``. The table is settled, as the numbers must not change.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        model = spark.sparkContext.broadcast(zlib.compress(f.read()))
    small_batches(spark)
    kept = [c for c in docs.columns if c != text and c.lower() not in PIECE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(model.value), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows, out = [], []
            for k, own in enumerate(batch.column(len(kept))):
                ids = np.append(encoder.ids(own.as_py() or ""), np.uint32(close)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append(k)
                    out.append((n, start, len(part), part.tobytes(), task, seen[len(part)]))
                    seen[len(part)] += 1
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)] if out else []
            if out:
                yield pa.record_batch([*(batch.column(i).take(pa.array(rows)) for i in range(len(kept))), *columns], [*kept, *PIECE])

    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(unused(docs, "text")))
    schema = T.StructType([docs.schema[c] for c in kept] + T.StructType.fromDDL("piece int, start long, length long, ids binary, task long, turn long").fields)
    return stage(own.mapInArrow(run, schema), "pieces")


def plan(count: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where pieces go, by how many there are of each length.

    Rows (length, first turn, first sequence, pieces of this row to a sequence, offset): the pieces of a length from the first turn on, up to the next
    row's, fill the sequences in order. The work depends on the number of lengths, not of pieces.
    """
    left = {s: n for s, n in count.items() if n > 0}
    turn: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: first sequence and number of sequences
    sizes: list[int] = []  # the gaps there are, in order
    made = 0

    def put(length: int, first: int, each: int, offset: int, pieces: int) -> None:
        rows.append((length, turn[length], first, each, offset))
        turn[length] += pieces
        left[length] -= pieces

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    partners = list(large)
    for s in reversed(large):
        while left[s]:
            while partners and not left[partners[-1]]:
                partners.pop()
            k = bisect_left(partners, capacity - s + 1) - 1
            while k >= 0 and (not left[partners[k]] or partners[k] == s and left[s] < 2):
                k -= 1
            other = partners[k] if k >= 0 else 0
            if other == s:
                n = left[s] // 2
                put(s, made, 2, 0, 2 * n)
            elif other:
                n = min(left[s], left[other])
                put(s, made, 1, 0, n)
                put(other, made, 1, s, n)
                if not left[other]:
                    del partners[k]
            else:
                n = left[s]
                put(s, made, 1, 0, n)
            leave(capacity - s - other, made, n)
            made += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(sizes, s)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del sizes[k]
            else:
                gap, first, n = capacity, made, -(-left[s] // (capacity // s))
                made += n
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, first, each, capacity - gap, full * each)
                leave(gap - each * s, first, full)
            last = min(left[s], each) if full < n else 0
            if last:
                put(s, first + full, last, capacity - gap, last)
                leave(gap - last * s, first + full, 1)
            leave(gap, first + full + bool(last), n - full - bool(last))
    return np.array(rows, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``task`` and ``turn`` go."""
    spark = pieces.sparkSession
    counts = stage(pieces.groupBy(F.col("task").alias("t"), F.col("length").alias("l")).agg(F.count("*").alias("n")), "counts")
    total = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # as many rows as there are lengths at most
    rows = plan(total, capacity)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    held: object = spark.sparkContext.broadcast(rows[order])
    # a length has one row per task here, whatever the number of its pieces
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("l").orderBy("t").rowsBetween(W.unboundedPreceding, -1))).drop("n")

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def where(length: pa.Array, turn: pa.Array) -> pa.Array:
        own, size, t = held.value, np.asarray(length, np.int64), np.asarray(turn, np.int64)
        base = int(own[:, 1].max(initial=0)) + int(t.max(initial=0)) + 1
        if base < 1 << 50:
            k = np.searchsorted(own[:, 0] * base + own[:, 1], size * base + t, "right") - 1
        else:
            k = np.array([bisect_left(own[:, :2].tolist(), [s, x + 1]) - 1 for s, x in zip(size.tolist(), t.tolist(), strict=True)], np.int64)
        _, first, sequence, each, offset = own[k].T
        return pa.StructArray.from_arrays([pa.array(sequence + (t - first) // each), pa.array(offset + (t - first) % each * size)], ["sequence_id", "offset"])

    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("task", "turn")]
    told = pieces.join(checked_broadcast(before), (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    told = told.select(*kept, where(F.col("length"), F.col("turn") + F.coalesce("before", F.lit(0))).alias("__at"))
    return told.select(*kept, "__at.sequence_id", "__at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, input_ids, document)``: the packed ids, and for each token the number of its piece in the sequence, from 0, for masks that keep documents apart."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "n_tokens": [len(ids)], "input_ids": [ids], "document": [np.repeat(np.arange(len(pdf)), pdf["length"])]})

    return placed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, input_ids array<long>, document array<long>")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
