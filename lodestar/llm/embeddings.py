"""Near-duplicate vectors by cosine: a pigeonhole join over subspaces.

Unit vectors with cosine c are at squared distance 2 - 2c. Rotated by a fixed random rotation and cut in blocks, two such vectors
are, in at least one block, no farther apart than that block's proportional share of the squared distance. So each block is
range-joined by itself: a tree of splits over the block's coordinates, at the medians of a bounded sample, cuts it in leaves;
a vector lives in one leaf and visits those of lower number that its radius reaches, so that each pair in range meets once. In a
leaf residents are held and visitors streamed past them, first compared within the block as one matrix product, then in full and in
double precision. A pair is counted in the first block that admits it, and no pair is written: a leaf gives a count per vector and a
spanning forest of its links. Equal vectors are one vector. Vectors travel packed, a row per leaf and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage
from .components import components

#: Coordinates of a block.
WIDTH = 16
#: Vectors that the splits are chosen from at most (any splits give exact results; these make leaves even).
SAMPLE = 16_384
#: Vectors wanted in a leaf, and the bounds of the tree's depth.
LEAF, SHALLOW, DEEP = 4096, 4, 12
#: Visitors that meet a leaf's residents at once.
CHUNK = 4096


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))[0]


def units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # very large or small components must not overflow when squared
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _blocks(dim: int) -> list[slice]:
    return [slice(a, min(a + WIDTH, dim)) for a in range(0, dim, WIDTH)]


def _budget(part: slice, dim: int, least: float) -> float:
    """A block's share of the squared distance, with room for rounding."""
    return (2 - 2 * least) * (part.stop - part.start) / dim * (1 + 1e-9) + 1e-9


class Splits:
    """A binary tree over one block: node k has the children 2k + 1 (below the split) and 2k + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        held = [sample]
        for k in range(len(self.axis)):
            own = held[k]
            if len(own):
                self.axis[k] = int(np.argmax(own.var(axis=0)))
                self.at[k] = np.median(own[:, self.axis[k]])
            below = own[:, self.axis[k]] < self.at[k] if len(own) else np.zeros(0, bool)
            held += [own[below], own[~below]]
            held[k] = None

    def leaves(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and leaf of every leaf within ``radius`` of a row, and whether it is the row's own."""
        row, node, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        off = np.zeros(x.shape)  # how far each row lies outside its node's box, by coordinate
        far2 = np.zeros(len(x))
        for _ in range(self.depth):
            axis = self.axis[node]
            gap = x[row, axis] - self.at[node]
            up = (gap >= 0).astype(np.int64)
            grown = far2 + gap * gap - off[np.arange(len(row)), axis] ** 2
            cross = np.flatnonzero(grown <= radius * radius)
            off2 = off[cross].copy()
            off2[np.arange(len(cross)), axis[cross]] = np.abs(gap[cross])
            row, home = np.append(row, row[cross]), np.append(home, np.zeros(len(cross), bool))
            node = np.append(2 * node + 1 + up, 2 * node[cross] + 2 - up[cross])
            off, far2 = np.concatenate([off, off2]), np.append(far2, grown[cross])
        return row, node - ((1 << self.depth) - 1), home


TILE = "dim int, block int, leaf int, visits boolean, node binary, n binary, vector binary"


def _place(trees: dict[int, list[Splits]], least: float, kind: type):
    """Packs vectors by block and leaf: residents of their own leaf, visitors of the lower leaves within reach."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for dim, own in pdf.groupby(pdf["vector"].map(len)):
                raw = np.array(own["vector"].tolist(), np.float64)
                turned = units(raw) @ rotation(dim)
                node, n, raw = own["node"].to_numpy(np.int64), own["n"].to_numpy(np.int64), raw.astype(kind)
                out = []
                for b, part in enumerate(_blocks(dim)):
                    row, leaf, home = trees[dim][b].leaves(turned[:, part], np.sqrt(_budget(part, dim, least)) + 1e-9)
                    mine = np.empty(len(raw), np.int64)
                    mine[row[home]] = leaf[home]
                    wanted = leaf <= mine[row]  # a pair meets in the lower of its two leaves
                    row, leaf, home = row[wanted], leaf[wanted], home[wanted]
                    order = np.lexsort((~home, leaf))
                    row, leaf, home = row[order], leaf[order], home[order]
                    cuts = np.flatnonzero((np.diff(leaf) != 0) | (home[1:] != home[:-1])) + 1
                    for x, y in zip([0, *cuts], [*cuts, len(row)], strict=True):
                        at = row[x:y]
                        out.append((dim, b, int(leaf[x]), not home[x], node[at].tobytes(), n[at].tobytes(), raw[at].tobytes()))
                yield pd.DataFrame(out, columns=["dim", "block", "leaf", "visits", "node", "n", "vector"])

    return run


class Leaf:
    """The residents of one leaf of one block; visitors are met as they come."""

    def __init__(self, dim: int, block: int, least: float, kind: type):
        self.dim, self.block, self.least, self.kind = dim, block, least, kind
        self.blocks = _blocks(dim)
        self.part, self.budget = self.blocks[block], [_budget(p, dim, least) for p in self.blocks]
        self.turn = rotation(dim)
        self.rows: list = []
        self.ready = False

    def unpack(self, r) -> tuple[np.ndarray, ...]:
        unit = units(np.frombuffer(r.vector, self.kind).reshape(-1, self.dim))
        return np.frombuffer(r.node, np.int64), np.frombuffer(r.n, np.int64), unit, unit @ self.turn

    def hold(self, r) -> None:
        self.rows.append(self.unpack(r))

    def settle(self) -> None:
        """All residents are there: compares them with one another."""
        self.ready = True
        if not self.rows:
            return
        self.node, self.n, self.unit, self.turned = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows = []
        self.links, self.root = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        self.left = self._left(self.turned)
        right = self._right(self.turned)
        for a in range(0, len(self.node), 1024):
            for i, j in self._near(slice(a, a + 1024), self.turned[a:], self.unit[a:], right[a:]):
                later = i < j + a
                self._link(i[later], j[later] + a)

    def _left(self, turned: np.ndarray) -> np.ndarray:
        own = turned[:, self.part]
        return np.hstack([own, (own * own).sum(axis=1)[:, None], np.ones((len(own), 1))]).astype(np.float32)

    def _right(self, turned: np.ndarray) -> np.ndarray:
        own = turned[:, self.part]
        return np.hstack([-2 * own, np.ones((len(own), 1)), (own * own).sum(axis=1)[:, None]]).astype(np.float32)

    def _near(self, rows: slice, turned, unit, right) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (resident, other) that this block is the first to admit and whose cosine suffices."""
        first = rows.start
        for c in range(0, len(right), CHUNK):
            # squared distances in single precision and with slack; whoever passes is compared in double
            i, j = np.divmod(np.flatnonzero(self.left[rows] @ right[c : c + CHUNK].T <= np.float32(self.budget[self.block] + 1e-5)), len(right[c : c + CHUNK]))
            i, j = i + first, j + c
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                ok = (self.unit[p] * unit[q]).sum(axis=1) >= self.least
                p, q = p[ok], q[ok]
                ok = _apart(self.turned[p], turned[q], self.part) <= self.budget[self.block]
                for earlier in range(self.block):
                    ok &= _apart(self.turned[p], turned[q], self.blocks[earlier]) > self.budget[earlier]
                yield p[ok], q[ok]

    def _link(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.links, p, self.n[q])
        np.add.at(self.links, q, self.n[p])
        _unite(self.root, p, q)

    def meet(self, r) -> Iterator[pd.DataFrame]:
        """Visitors, a packed row of them; gives their counts and a link of each to the residents' forest."""
        if not self.ready:
            self.settle()
        if not hasattr(self, "node"):
            return
        node, n, unit, turned = self.unpack(r)
        right, links, held = self._right(turned), np.zeros(len(node), np.int64), len(self.node)
        root = np.append(self.root, held + np.arange(len(node)))
        for a in range(0, held, 1024):
            for p, q in self._near(slice(a, a + 1024), turned, unit, right):
                np.add.at(self.links, p, n[q])
                np.add.at(links, q, self.n[p])
                _unite(root, p, q + held)
        self.root = root[:held]  # roots are the smallest positions, hence residents wherever there is one
        got = np.flatnonzero(links)
        if len(got):
            yield pd.DataFrame({"u": node[got], "v": np.int64(-1), "n": links[got]})
            yield pd.DataFrame({"u": node[got], "v": self.node[root[held + got]], "n": np.int64(0)})

    def close(self) -> Iterator[pd.DataFrame]:
        if not self.ready:
            self.settle()
        if not hasattr(self, "node"):
            return
        got = np.flatnonzero(self.links)
        if len(got):
            yield pd.DataFrame({"u": self.node[got], "v": np.int64(-1), "n": self.links[got]})
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        if len(child):
            yield pd.DataFrame({"u": self.node[child], "v": self.node[self.root[child]], "n": np.int64(0)})


def _compare(least: float, kind: type):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, name = None, None
        for pdf in parts:  # sorted by leaf, residents first
            for r in pdf.itertuples(index=False):
                if (r.dim, r.block, r.leaf) != name:
                    if leaf:
                        yield from leaf.close()
                    name = (r.dim, r.block, r.leaf)
                    leaf = Leaf(r.dim, r.block, least, kind)
                if r.visits:
                    yield from leaf.meet(r)
                else:
                    leaf.hold(r)
        if leaf:
            yield from leaf.close()

    return run


def _apart(x: np.ndarray, y: np.ndarray, part: slice) -> np.ndarray:
    diff = x[:, part] - y[:, part]
    return (diff * diff).sum(axis=1)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root[:] = flat
        a, b = a[apart], b[apart]


def _trees(sets: DataFrame) -> dict[int, list[Splits]]:
    """Splits of every block of every length of vector, from the SAMPLE vectors of smallest hash of each length."""
    out = {}
    for r in sets.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect():  # a row per length of vector
        depth = min(DEEP, max(SHALLOW, (r.n // LEAF).bit_length()))
        rows = sets.where(F.size("vector") == r.dim).orderBy("tag").limit(SAMPLE).select("vector").collect()
        turned = units(np.array([x.vector for x in rows])) @ rotation(r.dim)
        out[r.dim] = [Splits(turned[:, part], depth) for part in _blocks(r.dim)]
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of different length never link; null, empty and zero vectors and those with null or non-finite components link with
    nothing. Repeated rows of one id are separate vectors for ``n_links``. Rows with a null id link like any other; their
    component is the smallest id reached that is not null (null if there is none), and they are never kept. An empty
    table gives no rows; further columns are not looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    own = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    good = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are one number
    own = own.withColumn("vector", F.when(good, F.transform("vector", lambda x: x + F.lit(0.0))))
    sets = own.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    sets = stage(sets.withColumns({"node": F.monotonically_increasing_id(), "tag": F.xxhash64("vector")}), "vectors")
    packed = sets.select("node", "n", "vector").mapInPandas(_place(_trees(sets), least, kind), TILE)
    packed = packed.repartition("dim", "block", "leaf").sortWithinPartitions("dim", "block", "leaf", "visits")
    found = stage(packed.mapInPandas(_compare(least, kind), "u long, v long, n long"), "links")
    links = found.where("v = -1 and n > 0").groupBy("u").agg(F.sum("n").alias("links"))
    joined = components(found.where("n = 0").select("u", "v")).withColumnRenamed("node", "k")
    told = sets.join(links, F.col("node") == F.col("u"), "left").join(joined, F.col("node") == F.col("k"), "left")
    told = stage(told.select(F.col("vector").alias("same"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("group")), "told")
    first = told.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component"))
    told = told.join(first, F.col("group") == F.col("g")).select("same", "links", "component")
    out = own.join(told, F.col("vector") == F.col("same"), "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
