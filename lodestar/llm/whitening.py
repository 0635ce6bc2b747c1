"""Whitening of embeddings without their covariance matrix: a QR factorisation of a tall table (TSQR).

The distinct vectors are centred by exact sums. Every task folds its rows, block by block, into one triangular factor R; factors of
neighbouring tasks are stacked and factorised again, up a tree, until one is left. With X = QR the right singular vectors of R are the
eigenvectors of X'X, and the squares of its singular values the eigenvalues, without the loss of half the digits that forming X'X costs.
What a task or the driver holds is a square of the vectors' length, whatever the number of rows.

Defined cases: rows left out and padded vectors as in ``fixedpoint``; repeated vectors count once in the fit, and each of their rows
gets its result. Ids are not looked at: null and repeated ones are as good as any. Components without variance aren't returned (none at
all for a single distinct vector), and an empty table gives no rows. Among equal eigenvalues the components are any orthonormal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .fixedpoint import doubles, rows_in_block, usable, whole, width_of

#: Factors that one task of the tree merges.
FAN = 16
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of ``width`` components, whose sums are ``floor`` * n + ``rest``; unit components in columns, eigenvalues, and how far from one the whitened covariance is."""

    width: int
    n: int
    floor: np.ndarray
    rest: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x less the floor of the mean: small whole numbers."""
        return x - self.floor

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x) - np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over components of (n x - S) squared, exact: with S = floor n + rest it is n² Σy² - 2 n Σ y rest + Σ rest²."""
        y, rest = self.offsets(x), np.array(self.rest, object)
        if int(np.abs(y).max(initial=0)) * sum(self.rest) < 1 << 62:
            rest = rest.astype(np.int64)
        else:
            y = y.astype(object)
        n, last = self.n, sum(r * r for r in self.rest)
        return [n * n * a - 2 * n * b + last for a, b in zip((y * y).sum(axis=1).tolist(), (y @ rest).tolist(), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The packed vectors of a task, some thousands at a time."""
    most = rows_in_block(width)
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            own = batch.column(0).slice(k, most)
            yield np.frombuffer(b"".join(own.to_pylist()), np.int32).reshape(len(own), width).astype(np.int64)


def distinct_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Each distinct vector of whole numbers once, packed; copies are dropped before the shuffle and after it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([r.tobytes() for r in whole(batch.column(0), width).astype(np.int32)], pa.binary())], ["x"])

    return df.select(doubles(vector).alias("v")).mapInArrow(pack, "x binary").distinct()


def _totals(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums over all rows of what ``of`` sums over a block; a task hands on one row per position."""
    exact = kind == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, width):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64() if exact else pa.float64())], ["at", "s"])

    found = fit.mapInArrow(run, f"at int, s {kind}").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)") if exact else F.col("s")).alias("s"))
    return [int(r.s) if exact else r.s for r in sorted(found.collect(), key=lambda r: r.at)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular_factor(fit: DataFrame, model: Whitening) -> np.ndarray:
    """R of the centred vectors: a factor per task, merged ``FAN`` at a time."""
    width = model.width

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for x in _blocks(batches, width):
            r = _triangle(np.vstack([r, model.centred(x)]))
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["leaf", "r"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf")
        r = np.zeros((0, width))
        for own in pdf["r"]:
            r = _triangle(np.vstack([r, np.frombuffer(own).reshape(-1, width)]))
        return pd.DataFrame({"leaf": [int(pdf["leaf"].iloc[0]) // FAN], "r": [r.tobytes()]})

    factors, left = fit.mapInArrow(leaf, "leaf long, r binary"), fit.rdd.getNumPartitions()
    while left > 1:
        factors = factors.groupBy((F.col("leaf") / FAN).cast("long").alias("g")).applyInPandas(merge, "leaf long, r binary")
        left = -(-left // FAN)
    # one row; a table of one task has its only factor already
    found = [np.frombuffer(row.r).reshape(-1, width) for row in factors.collect()]
    return _triangle(np.vstack(found)) if found else np.zeros((0, width))


def fit(df: DataFrame, vector: str = "embedding", most: int = 4) -> Whitening | None:
    """The whitening of the distinct vectors of ``df``, by its ``most`` largest components; None if there are no vectors."""
    df = usable(df, vector)
    width = width_of(df, vector)
    if not width:
        return None
    own = stage(distinct_vectors(df, vector, width), "distinct")
    *sums, n = _totals(own, width, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    floor, rest = np.array([s // n for s in sums], np.int64), tuple(s % n for s in sums)
    model = Whitening(width, n, floor, rest, np.zeros((width, 0)), np.zeros(0), 0.0)
    _, size, right = np.linalg.svd(triangular_factor(own, model), full_matrices=False)
    full = size > size.max(initial=0) * max(n, width) * np.finfo(float).eps
    found = right[full][:most]
    found *= np.where(np.take_along_axis(found, np.abs(found).argmax(axis=1)[:, None], axis=1) < 0, -1, 1)  # either sign is right; reruns agree
    values = size * size / n
    model = Whitening(width, n, floor, rest, np.ascontiguousarray(found.T), values[full][:most], float(values.sum()))
    if not len(found):
        return model
    mean = np.array(_totals(own, width, lambda x: model.project(x).sum(axis=0), "double")) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return (w.T @ w).ravel()

    covariance = np.array(_totals(own, width, products, "double")).reshape(len(found), -1) / n
    return Whitening(width, n, floor, rest, model.components, model.values, model.trace, float(np.abs(covariance - np.eye(len(found))).max()))


def transform(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The columns of ``df`` (but the vector and those that bear a result's name), with a row per usable vector and component.

    ``deviation`` is decimal(38,0), null where it has more digits.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != vector and c.lower() not in RESULT]
    if model is None or not model.components.shape[1]:
        none = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return df.where(F.lit(False)).select(*kept, F.from_json(F.lit("{}"), none).alias("r")).select(*kept, "r.*")

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def told(v: pa.Array) -> pa.Array:
        kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
        x = whole(v, model.width)
        far = [Decimal(d) if d < 10**38 else None for d in model.deviations(x)]
        w = model.project(x)
        parts = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
        return pa.StructArray.from_arrays([pa.array(far, pa.decimal128(38, 0)), parts], fields=list(kind))

    own = usable(df, vector).select(*kept, told(doubles(vector)).alias("r"))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    own = own.select(*kept, "r.deviation", F.posexplode("r.whitened").alias("at", "w"))
    return own.select(
        *kept, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), share[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )


def whiten(df: DataFrame, vector: str = "embedding", most: int = 4) -> DataFrame:
    return transform(df, fit(df, vector, most), vector)
