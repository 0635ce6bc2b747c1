"""Near copies by the Jaccard similarity of word shingle sets: SimHash fingerprints and MinHash bands propose, the whole sets decide.

Texts of one shingle set are one class. Two classes are candidates if the fingerprints of their shingles are within 3 bits, found through
the pivot distance tables of ``simhash``, or if one of BANDS bands of ROWS minima agrees: a pair of similarity s is missed by the bands
with odds ``(1 - s**ROWS) ** BANDS``, 9e-7 at 0.8 and less above. The bands are there because fingerprints of similarity 0.8 differ by some
ten bits, and as many as 20, a radius at which no pivot discards anything. Candidates are gathered by component and verified through
inverted indexes of their shingles, so whatever is linked has the wanted similarity. A component of many texts is dealt to chunks:
first each chunk is compared within itself and with the component's hub, and only texts that are then not in the component's largest
group are compared with all others, chunk by chunk. A task emits a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, small_batches, stage
from .components import components
from .simhash import link_forest, majority, shingle_hashes

WIDTH, BANDS, ROWS = 5, 35, 5
#: Texts of one component that a task compares at once.
CHUNK = 1024
_FACTORS = np.random.default_rng(5081).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles, in order; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, width))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band; an empty set has none."""
    if not len(own):
        return []
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for a in range(0, len(own), 1024):
        np.minimum(least, (own[a : a + 1024, None] * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def _sketcher(width: int):
    @F.pandas_udf("struct<node:long,fp:long,keys:array<long>>")
    def run(texts: "pd.Series") -> "pd.DataFrame":
        nodes, prints, keys = [], [], []
        for t in texts:
            h = shingle_hashes(t, width)
            own = np.unique(h)
            nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
            prints.append(majority(h))
            keys.append(np.array(bands(own), np.uint64).view(np.int64))
        return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "fp": np.array(prints, np.uint64).view(np.int64), "keys": pd.Series(keys, dtype=object)})

    return run


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of similarity ``least`` or more as a spanning forest (positions), breadth first."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    shingle = np.unique(flat, return_inverse=True)[1]
    by = owner[np.argsort(shingle, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(shingle)))) if len(flat) else np.zeros(1, np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    free, left, out = np.ones(n, bool), n, []
    for start in range(n):
        if not free[start]:
            continue
        free[start], left, queue = False, left - 1, [start]
        while queue and left:
            x = queue.pop()
            own = shingle[first[x] : first[x + 1]]
            a, long = begin[own], begin[own + 1] - begin[own]
            at = np.repeat(a - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(long.sum())
            both = np.bincount(by[at], minlength=n)
            hit = np.flatnonzero(free & (both >= least * (size + size[x] - both) - 1e-9))
            free[hit] = False
            left -= len(hit)
            out += [(x, int(y)) for y in hit]
            queue += hit.tolist()
    return out


def _verify(least: float, width: int):
    def run(parts):
        def close(x):
            found = forest([shingle_set(t, width) for t in x["text"]], least)
            node = x["node"].to_numpy(np.int64)
            return pd.DataFrame({"u": node[[a for a, _ in found]], "v": node[[b for _, b in found]]}) if found else None

        held = []
        for pdf in parts:  # sorted by g: all but the last group of what is held are complete
            for _, x in pdf.groupby("g", sort=False):
                if held and held[0]["g"].iloc[0] != x["g"].iloc[0]:
                    if (done := close(pd.concat(held))) is not None:
                        yield done
                    held = []
                held.append(x)
        if held and (done := close(pd.concat(held))) is not None:
            yield done

    return run


def _candidates(prints: DataFrame) -> DataFrame:
    """``u, v``: links between classes that may be near copies, each to the hub of what they share."""
    keyed = stage(prints.select("node", F.explode("keys").alias("key")).distinct(), "keyed")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").select(F.col("key").alias("k"), "hub")
    by_band = keyed.join(hubs, F.col("key") == F.col("k")).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    of_print = stage(prints.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("most")), "prints")
    alike = prints.join(of_print.where("hub <> most").select(F.col("fp").alias("f"), "hub"), F.col("fp") == F.col("f")).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    return by_band.unionByName(alike).unionByName(link_forest(of_print.select("fp", F.col("hub").alias("node"))))


def _compared(own: DataFrame, dealt: DataFrame, least: float, width: int) -> DataFrame:
    """Links within the groups ``g`` to which ``dealt`` (``r, node, g``) sends texts."""
    sent = own.join(checked_broadcast(stage(dealt, "dealt")), F.col("row") == F.col("r")).select("g", "node", "text")
    return sent.repartition("g").sortWithinPartitions("g").mapInPandas(_verify(least, width), "u long, v long")


def groups(docs: DataFrame, least: float = 0.8, width: int = WIDTH, row: str = "row", text: str = "text") -> DataFrame:
    """``row, component`` per row of ``docs``: rows of one component are linked by similarity ``least`` or more.

    ``row`` is a long that no two rows share. Null texts and texts without words are copies of one another; texts are read whole,
    however long. Equal texts are one class however often they occur. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    prints = stage(own.withColumn("s", _sketcher(width)("text")).select("row", "s.node", "s.fp", "s.keys"), "sketches")
    near = components(_candidates(prints))
    sizes = near.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "c")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = near.join(checked_broadcast(stage(sizes, "sizes")), F.col("component") == F.col("c")).select(F.col("node").alias("k"), "component", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("m"))
    one = stage(prints.groupBy("node").agg(F.min("row").alias("r")).join(stage(dealt, "chunks"), F.col("node") == F.col("k")).drop("k"), "candidates")
    # a component bears the number of one of its texts, the hub, which goes to all chunks
    to = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("m"))
    first = one.select("r", "node", "component", F.explode(to).alias("o")).select("r", "node", F.xxhash64("component", "o").alias("g"))
    links = stage(_compared(own, first, least, width), "within")
    found = components(links)
    large = one.where("chunks > 1")
    if not large.isEmpty():
        told = stage(large.join(found.select(F.col("node").alias("k"), F.col("component").alias("part")), F.col("node") == F.col("k"), "left").withColumn("part", F.coalesce("part", "node")).drop("k"), "parts")
        parts = told.groupBy("component", "part").agg(F.count("*").alias("n"))
        most = parts.groupBy(F.col("component").alias("c")).agg(F.max(F.struct("n", "part")).alias("x"), F.sum("n").alias("all"))
        most = stage(most.select("c", F.col("x.part").alias("main"), F.ceil((F.col("all") - F.col("x.n")) / CHUNK).cast("int").alias("sheets")).where("sheets > 0"), "main")
        told = told.join(checked_broadcast(most), F.col("component") == F.col("c"))
        group = lambda q, m: F.xxhash64("component", q, m).alias("g")
        mine = F.pmod(F.xxhash64("node", F.lit("sheet")), F.col("sheets")).cast("int")
        rest = told.where("part <> main").select("r", "node", "component", mine.alias("q"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select("r", "node", group("q", "o"))
        all_ = told.select("r", "node", "component", "m", F.explode(F.sequence(F.lit(0), F.col("sheets") - 1)).alias("q")).select("r", "node", group("q", "m"))
        across = stage(_compared(own, rest.unionByName(all_).distinct(), least, width), "across")
        found = components(links.unionByName(across))
    found = checked_broadcast(found.withColumnRenamed("node", "k"))
    return prints.select("row", "node").join(found, F.col("node") == F.col("k"), "left").select("row", F.coalesce("component", "node").alias("component"))
