"""SimHash near-duplicates: whole-text fingerprints, joined through pivot distance tables.

Each fingerprint's Hamming distances to many reference fingerprints (*pivots*) are tabulated, over all bits and over groups of bits. As
``|d(x, p) - d(y, p)| <= d(x, y)`` for each pivot p, over any group of bits, a pair whose largest coordinate difference exceeds what the
group allows is discarded. Two fingerprints within 3 bits differ in at most three of five blocks; so in at least one pair of blocks they
do not differ at all, and none of that table's coordinates may differ either: the tables of the ten pairs of blocks give the
candidates, as rows of equal coordinates. Candidates whose coordinates over all 64 bits differ by more than the limit are discarded
next, and the few survivors are verified on the fingerprints themselves. A task emits a spanning forest of the links it found, never
the pairs, so a group of n near copies costs n rows. Exact copies are one fingerprint from the start.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage
from .components import components

#: Bit blocks (first bit, width) that cut 64 bits in five.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Rows of one key that a task compares at once; a larger group is cut into chunks, and each pair of chunks is one group.
CHUNK = 2048
PIVOTS = 24


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed random ones, the first being zero."""
    out = np.random.default_rng(20240607).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % np.uint64(2)
    out[0] = 0
    return out


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles in order of place; fewer than ``width`` words are one shingle, none have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over word shingles; texts without words have 0."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero if there are none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 18):
        ones += np.unpackbits(h[a : a + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(parts: "pd.Series") -> "pd.Series":
    return pd.Series(np.array([fingerprint(x) for x in parts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a long column ``fp`` (the 64 bits as a signed integer)."""
    small_batches(docs.sparkSession)
    return docs.withColumn("fp", _fingerprints(F.col(text)))


def forest(key: np.ndarray, fp: np.ndarray, limit: int, table_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``limit`` bits between rows of equal key, as a spanning forest (positions of child and root).

    Rows must be sorted by key and then by the distance to the first pivot.
    """
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root[:0], root[:0]
    table = np.bitwise_count(fp[:, None] ^ table_of[None, :]).astype(np.int8)
    first = np.arange(n)
    live = first
    for step in range(1, n):
        live = live[live + step < n]
        other = live + step
        # sorted by the first coordinate: once it is too far, it stays too far for this row
        near = (key[live] == key[other]) & (table[other, 0] - table[live, 0] <= limit)
        live, other = live[near], other[near]
        if not len(live):
            break
        a, b = live, other
        for p in range(1, table.shape[1]):
            ok = np.abs(table[a, p] - table[b, p]) <= limit
            if not ok.all():
                a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= limit
        a, b = a[ok], b[ok]
        ra, rb = root[a], root[b]
        while len(a):
            apart = ra != rb
            if not apart.any():
                break
            lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(root, hi, lo)
            while True:
                flat = root[root]
                if (flat == root).all():
                    break
                root = flat
            ra, rb = root[a], root[b]
    child = np.flatnonzero(root != first)
    return child, root[child]


def _links(limit: int):
    table_of = pivots()

    def run(parts):
        def close(frames):
            x = pd.concat(frames, ignore_index=True)
            fp = x["fp"].to_numpy(np.int64).view(np.uint64)
            keys = x["g"].to_numpy(np.int64)
            order = np.lexsort((np.bitwise_count(fp ^ table_of[0]), keys))
            c, r = forest(keys[order], fp[order], limit, table_of)
            node = x["node"].to_numpy(np.int64)[order]
            return pd.DataFrame({"u": node[c], "v": node[r]}).drop_duplicates()

        held, rows = [], 0
        for pdf in parts:  # sorted by g: all but the last group of what is held are complete
            held.append(pdf)
            rows += len(pdf)
            if rows >= 1 << 17:
                x = pd.concat(held, ignore_index=True)
                last = x["g"].to_numpy() == x["g"].iloc[-1]
                if not last.all():
                    yield close([x[~last]])
                    held, rows = [x[last]], int(last.sum())
                else:
                    held = [x]
        if held:
            yield close(held)

    return run


def _coordinates(i: int, j: int) -> Column:
    """Hash of the distances to all pivots over the bits of two blocks."""
    mask = sum(((1 << width) - 1) << at for at, width in (BLOCKS[i], BLOCKS[j]))
    signed = [x - (1 << 64) if x >> 63 else x for x in (mask, *(int(p) & mask for p in pivots()))]
    own = F.col("fp").bitwiseAND(F.lit(signed[0]).cast("long"))
    return F.xxhash64(F.lit(i), F.lit(j), *[F.bit_count(own.bitwiseXOR(F.lit(p).cast("long"))) for p in signed[1:]])


def link_forest(prints: DataFrame, limit: int = 3) -> DataFrame:
    """Spanning edges (u, v) between nodes whose fingerprints differ in at most ``limit`` = 3 or fewer bits.

    ``prints`` has one row per distinct fingerprint: ``fp`` and ``node``, both long.
    """
    if not 0 <= limit <= 3:
        raise ValueError("five blocks of which two agree prove at most 3 differing bits")

    keys = [_coordinates(i, j) for i, j in combinations(range(5), 2)]
    rows = stage(prints.select("fp", "node", F.explode(F.array(*keys)).alias("key")), "blocks")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # groups above CHUNK: rows are dealt to chunks by a hash, and a row goes to each pair of chunks that holds its own
    rows = rows.join(sizes.select(F.col("key").alias("k2"), "n"), F.col("key") == F.col("k2"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("node"), chunks)
    rows = rows.select("fp", "node", "key", chunks.alias("c"), mine.cast("int").alias("m"))
    rows = rows.select("fp", "node", "key", "m", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))).alias("o"))
    group = F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o"))
    rows = rows.select("fp", "node", group.alias("g"))
    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(_links(limit), "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``; fingerprints link at ``limit`` or fewer differing bits.

    A null or empty text has fingerprint zero and links like any other; texts are read whole, however long. Rows with a null id link
    as well; a component's number is the smallest id in it that is not null (null if there is none). Repeated rows stay
    repeated, an empty table gives no rows, and further columns are not looked at.
    """
    prints = stage(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", "fp"), "fp")
    # a class is all rows of one fingerprint, which is also its number in the graph
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(link_forest(classes.select("fp", F.col("fp").alias("node")), limit))
    labels = classes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), "least", F.coalesce("component", "fp").alias("group"))
    labels = stage(labels, "labels")
    first = labels.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component_id"))
    labels = stage(labels.join(first, F.col("group") == F.col("g")).select("f", "component_id"), "named")
    return prints.join(labels, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
