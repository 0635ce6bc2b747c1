"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. All its documents get the whole copies that the target allows (target / size, rounded
down); what is left is filled by a sample of fixed size, measured in words: documents are ranked by their random odds
U / (1 - U) divided by their inclusion odds, and taken in that order whenever they fit in what is still open. Inclusion odds rise
with the ``power`` of a document's length. Then the document whose length is nearest to what is missing is added if it brings the
source nearer to its target; both steps are repeated until no document does.

Ranks are never sorted in one place: a pass takes the documents up to the first that doesn't fit, found by summing words by
(source, cell of the rank) and ordering only the one cell that holds the cut. Documents beyond it are looked at in the next pass, from
which those that no longer fit are left out; so a very long document never ends a source's sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, stage

#: Cells of the rank key for each doubling of it.
CELLS = 512


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weights repeat over sources by code point, null last.

    The budget ``share`` * total is dealt by weight, no source above ``most`` times its size; what is cut off is dealt again by
    weight among the others, until none is above. Every round is one small aggregation, however many sources there are.
    """
    at = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id())
    at = stage(at, "sources")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("p").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("p").alias("p2"), "first")
    k = (F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("first")) % len(weights)
    weighed = at.join(F.broadcast(starts), F.col("p") == F.col("p2"))  # one row per partition
    weighed = weighed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("long").alias("w"))
    weighed = stage(weighed.withColumn("most", F.col("source_size") * F.lit(float(most))), "weights")
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, count = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("most") < F.col("w") * level
        row = weighed.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("cut"), F.sum(F.when(~full, F.col("w")).otherwise(0)).alias("w"), F.count_if(full).alias("n")).first()
        if row.n == count or not row.w:
            break
        count, level = row.n, (budget - row.cut) / row.w
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("w") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def _fits(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """``rid`` of the documents that come, in order of their rank, before the first that doesn't fit.

    ``left``: documents not taken yet (``rid, doc_id, source, size, key, cell``). ``gaps``: ``source, gap``; documents above the
    gap are passed over.
    """
    gap = checked_broadcast(gaps.select(F.col("source").alias("s"), "gap"))
    own = left.join(gap, F.col("source").eqNullSafe(F.col("s"))).where("size <= gap").drop("s")
    cells = own.groupBy("source", "gap", "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source", "gap").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cut = cells.withColumn("upto", upto).where("upto > gap").groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    cut = checked_broadcast(stage(cut.select(F.col("source").alias("s"), F.col("x.cell").alias("at"), F.col("x.before").alias("before")), "cut"))
    own = own.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    edge = own.where("cell = at").withColumn("upto", F.col("before") + F.sum("size").over(order)).where("upto <= gap")
    return own.where("at is null or cell < at").select("rid").unionByName(edge.select("rid"))


def _nearest(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """``rid`` of one document per source: that of the size nearest to the gap, if it is nearer than none."""
    gap = checked_broadcast(gaps.select(F.col("source").alias("s"), "gap"))
    near = left.join(gap, F.col("source").eqNullSafe(F.col("s"))).where("abs(gap - size) < abs(gap)")
    return near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("d"), "key", "doc_id", "rid")).alias("x")).select(F.col("x.rid").alias("rid"))


def _sampled(ranked: DataFrame, goal: DataFrame) -> DataFrame:
    """``rid`` of the sample: both steps in turn until nothing is added."""
    gaps = stage(goal.select("source", F.col("rest").alias("gap")), "gaps")
    left, taken, step = ranked, None, 0
    while True:
        more = stage((_fits if step % 2 == 0 else _nearest)(left, gaps), "more")
        taken = more if taken is None else taken.unionByName(more)
        left = ranked.join(checked_broadcast(taken.withColumnRenamed("rid", "r")), F.col("rid") == F.col("r"), "left_anti")
        got = ranked.join(checked_broadcast(more.withColumnRenamed("rid", "r")), F.col("rid") == F.col("r"), "left_semi").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("words"))
        gaps = gaps.join(got, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"))
        gaps = checked_broadcast(stage(gaps, "gaps"))
        step += 1
        if step % 2 == 0:
            near = left.join(gaps.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            if near.where("abs(gap - size) < abs(gap)").isEmpty():
                return taken


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    power: float = 0.5,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``.

    Whole documents are taken, 0, 1 or more times: ``taken = copies * size``. ``most`` bounds both a source's target and a
    document's copies. Null texts have size 0 and are never taken; a null source is a source of its own, the last. Draws
    depend on ``seed`` and the id, so reruns agree; repeated rows are separate documents with equal keys, ties go by id, size and row. A very
    long text is taken whole where it fits and passed over where it doesn't; an empty table gives no rows. With ``carry`` all
    columns of ``docs`` follow (then the result is joined back by position, not by id); of two columns of one name ours is given.
    """
    size = words(text)
    keep = [F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] if carry else []
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *keep)
    base = stage(base.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = stage(goal.withColumn("copies0", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")), "targets")
    goal = goal.withColumn("rest", F.col("target") - F.col("copies0") * F.col("source_size"))
    g = checked_broadcast(goal.withColumnRenamed("source", "s"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    part = F.col("rest") / F.col("source_size")
    odds = part / (1 - part) * F.pow(F.col("size").cast("double"), F.lit(power))
    rank = F.col("u") / (1 - F.col("u")) / odds
    ranked = base.drop("doc").join(g, F.col("source").eqNullSafe(F.col("s"))).withColumn("u", u)
    ranked = ranked.where("size > 0 and rest > 0").select("rid", "doc_id", "source", "size", rank.alias("key"))
    ranked = stage(ranked.withColumn("cell", F.floor(F.log2("key") * CELLS).cast("long")), "ranked")
    extra = stage(_sampled(ranked, goal).select(F.col("rid").alias("r2")), "extra")
    out = base.join(g, F.col("source").eqNullSafe(F.col("s"))).join(extra, F.col("rid") == F.col("r2"), "left")
    copies = F.when(F.col("size") > 0, F.col("copies0") + F.col("r2").isNotNull().cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", copies)
    cols = ["doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"]
    if carry:
        ours = ["size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"]
        cols = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "copies")] + ours
    return out.select(*cols)
