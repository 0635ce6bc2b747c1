"""Compression of vectors to short codes (product quantisation) in whole numbers.

A vector is cut into equal consecutive parts; every part position has a codebook of as many entries as are asked for, and the code names
the nearest entry of each. Vectors lie in blocks of columns: a block is a NumPy array of one row per dimension, so that the distances of a part to
all entries add up dimension by dimension over contiguous memory. A round folds the blocks of a task into tensors of sums and
counts (``np.add.at``), and RDD.treeAggregate merges them, so that the driver gets one tensor of the codebooks' size. All is
whole numbers: the result doesn't depend on partitions or their order.

Defined cases: rows left out and padded vectors as in ``fixedpoint`` (the length is padded to a multiple of the parts). The codebooks
start from the rows of smallest id (null ids last, equal ids by vector); fewer rows than entries give as many entries as rows. Repeated
rows each count and get their code. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stage, unused
from .fixedpoint import doubles, rows_in_block, usable, whole, width_of

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Tensors that one task of the reduction tree merges, about.
FAN = 32


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance by part and row. ``block``: dimension by row; ``books``: part, entry, dimension within the part."""
    parts, entries, width = books.shape
    code, far = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(width):
            gap = block[p * width + d][None] - books[p, :, d][:, None]
            gap *= gap
            distance += gap
        code[p] = distance.argmin(axis=0)  # the first of equals
        far[p] = np.take_along_axis(distance, code[p][None], axis=0)[0]
    return code, far


def _tally(got: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block's parts to the sums and counts of the entries they are nearest to."""
    sums, counts = got
    code, _ = assign(block, books)
    for p, own in enumerate(code):
        np.add.at(counts[p], own, 1)
        for d in range(books.shape[2]):
            np.add.at(sums[p, :, d], own, block[p * books.shape[2] + d])
    return sums, counts


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def blocks(df: DataFrame, vector: str, width: int) -> DataFrame:
    """The vectors as blocks of columns, some thousand vectors in each."""
    most = rows_in_block(width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(0), width).astype(np.int32)
            own = [np.ascontiguousarray(x[k : k + most].T).tobytes() for k in range(0, len(x), most)]
            yield pa.record_batch([pa.array(own, pa.binary())], ["block"])

    return df.select(doubles(vector).alias("v")).mapInArrow(pack, "block binary")


def train(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks by part, entry and dimension: ``rounds`` rounds of assignment and replacement by floored means; unused entries stay."""
    df = usable(df, vector)
    width = -(-width_of(df, vector) // parts) * parts
    first = df.select(F.col(f"`{id_column}`").alias("id"), doubles(vector).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = whole(pa.array([r.v for r in first], pa.list_(pa.float64())), width).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not books.size:
        return books
    packed = stage(blocks(df, vector, width), "blocks").rdd.map(lambda r: np.frombuffer(r.block, np.int32).reshape(width, -1).astype(np.int64))
    depth = max(2, int(np.ceil(np.log(max(2, packed.getNumPartitions())) / np.log(FAN))))
    for _ in range(rounds):
        held = books
        sums, counts = packed.treeAggregate((np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)), lambda got, block, b=held: _tally(got, block, b), _merge, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def encode(df: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``df`` with ``code`` (two hexadecimal digits a part, 256 entries at most) and ``error``, the squared distance to what the code stands for.

    Columns of ``df`` that bear these names go.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("code", "error")]
    if not books.size:
        return usable(df, vector).select(*kept, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    if books.shape[1] > 256:
        raise ValueError("a code has two hexadecimal digits a part: 256 entries at most")
    width = books.shape[0] * books.shape[2]
    most = rows_in_block(width)

    @F.arrow_udf("struct<code: string, error: bigint>")
    def told(v: pa.Array) -> pa.Array:
        x = whole(v, width)
        code, error = [], []
        for k in range(0, len(x), most):
            own, far = assign(np.ascontiguousarray(x[k : k + most].T), books)
            code += [r.tobytes().hex() for r in np.ascontiguousarray(own.T.astype(np.uint8))]
            error.append(far.sum(axis=0))
        return pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *error]))], ["code", "error"])

    name = unused(df, "told")
    return usable(df, vector).withColumn(name, told(doubles(vector))).select(*kept, f"{name}.code", f"{name}.error")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector of whole numbers that a code stands for."""
    return np.concatenate([books[p, k] for p, k in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_group_errors(coded: DataFrame, by: str, name: str = "label_error") -> DataFrame:
    """``coded``, with the sum of ``error`` over the rows of equal ``by``, nulls together: summed before the shuffle, so that a common value costs no more than others."""
    key, total = unused(coded, "key"), unused(coded, "total")
    coded = stage(coded, "codes")
    sums = coded.groupBy(F.col(f"`{by}`").alias(key)).agg(F.sum("error").alias(total))
    rest = [F.col(f"`{c}`") for c in coded.columns if c != name]
    return coded.join(checked_broadcast(sums), F.col(f"`{by}`").eqNullSafe(F.col(key))).select(*rest, F.col(total).alias(name))
