"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

A line is dropped if it repeats, exactly or within ``edits`` edits, a line that stands earlier in the corpus (by document id,
then line number). Exact repeats are found by hash. For near ones every distinct line is cut in ``edits + 1`` segments: a line
within ``edits`` edits holds one of them unchanged, at a place that the lengths bound. Lines are indexed by (length, segment,
hash of the segment) and probe that index with the few substrings that may match (the multi-match-aware selection). Lines that
meet under a key are compared in a left semi join whose condition holds two parity sketches, then a bit-parallel edit distance
over the band of ``2 * edits + 1`` diagonals: it stops at the first earlier line, so a group of n variants gives n rows at most.

Lines of one make, such as those of a log, share whole segments by the thousand. All keys are counted, and one that is that common tells nothing: its lines are looked at without that segment and without what they all begin and end with, what is left is cut in
segments in its turn, and so on until the keys are rare. So a common key costs in proportion to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, drop_folder, new_folder, release, stage

#: Bits that a position's line number and the text's hash take beside the document id.
_LINE, _HASH = 1 << 28, 1 << 32
#: A key is common if its lines make over PAIRS pairs.
PAIRS = 1 << 20
DEC = "decimal(38,0)"


def _number(x: int) -> Column:
    return F.lit(str(x)).cast(DEC)


def _units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``unit`` orders documents by id (null last) and tells apart rows of one id with different texts."""
    low = F.pmod(F.xxhash64(F.col(text)), F.lit(_HASH)).cast(DEC)
    return docs.withColumn("unit", (F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).cast("decimal(20,0)").cast(DEC) * _number(_HASH)).cast(DEC) + low)


def _mask(places: DataFrame) -> DataFrame:
    """``unit, mask``: an array with '1' at the line numbers listed in ``places`` (``ord``)."""
    line = F.pmod("ord", _number(_LINE)).cast("int")
    unit = ((F.col("ord") - F.pmod("ord", _number(_LINE))) / _number(_LINE)).cast(DEC)
    at = places.select(unit.alias("u"), line.alias("line")).groupBy("u").agg(F.sort_array(F.collect_list("line")).alias("at"))
    bits = F.transform("at", lambda x, j: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get(F.col("at"), j - 1), F.lit(-1)) - 1), F.lit("1")))
    return at.select("u", F.split(F.array_join(bits, ""), "").alias("mask"))


def probe_offsets(edits: int, delta: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings by which a line probes lines shorter by ``delta``."""
    out = []
    for i in range(edits + 1):
        left, right = i, edits - i
        lo = max(-left, delta - right, -((edits - delta) // 2))
        hi = min(left, delta + right, (edits + delta) // 2)
        out += [(i, s) for s in range(lo, hi + 1)]
    return out


def _keys(texts: DataFrame, edits: int, rest: bool = False) -> DataFrame:
    """``id, key, role`` of ``id, line, n``: role 1 in the index, 2 as probe; with ``rest`` also the line without the segment.

    Of k = edits + 1 segments of a line of m characters the last m % k are longer by one. The exploded list is a constant, so that
    one short expression makes all keys. Where ``texts`` have a group ``g`` and a ``part``, keys differ by group and rows have that role only.
    """
    k = edits + 1
    wanted = [(0, i, 0, 1) for i in range(k)] + [(delta, i, s, 2) for delta in range(k) for i, s in probe_offsets(edits, delta)]
    names = ("delta", "segment", "shift", "role")
    list_ = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, w, strict=True)]) for w in wanted])
    deep = "g" in texts.columns
    own = ["id", "line", "n", "g", "part"] if deep else ["id", "line", "n"]
    rows = texts.select(*own, F.explode(list_).alias("w")).select(*own, "w.*")
    rows = rows.where("part = role and n >= delta") if deep else rows
    m = F.col("n") - F.col("delta")
    short = F.lit(k) - m % k  # segments without the further character
    base = F.floor(m / k).cast("int")
    start = F.col("segment") * base + F.greatest(F.col("segment") - short, F.lit(0)) + 1 + F.col("shift")
    length = base + (F.col("segment") >= short).cast("int")
    rows = rows.select(*own, "segment", m.alias("m"), F.col("role").cast("byte").alias("role"), start.alias("start"), length.alias("length"))
    piece = F.substring("line", F.col("start"), F.col("length"))
    key = F.xxhash64("g", "segment", "m", piece) if deep else F.xxhash64("segment", "m", piece)
    left = [F.concat(F.left("line", F.col("start") - 1), F.substring("line", F.col("start") + F.col("length"), F.col("n"))).alias("line")] if rest else []
    return rows.where("start >= 1 and start + length - 1 <= n").select("id", key.alias("key"), "role", *left)


def _met(keys: DataFrame, every: bool = False) -> DataFrame:
    """``h, many``: keys under which lines that differ meet in both roles, and whether they make over PAIRS pairs; counted before the shuffle, whatever a key holds.

    Where ``every`` line has both roles it also probes its own place in the index, so that two lines meet only under keys of three rows or more: a
    count is enough (and lets through a line that repeats within itself, which meets nothing).
    """
    both = F.sum(F.when(F.col("role") == 1, F.lit(1).cast("long")).otherwise(F.lit(1 << 32))).alias("both")
    n1, n2 = F.col("both").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("both", 32)
    if every:
        found = keys.groupBy("key").agg(both).where((n1 > 0) & (n1 + n2 > 2))
    else:
        found = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), both).where((F.col("lo") != F.col("hi")) & (n1 > 0) & (n2 > 0))
    return found.select(F.col("key").alias("h"), (n1.cast("double") * n2 > PAIRS).alias("many"))


def _alike(a: Column, b: Column) -> Column:
    """How many characters two strings begin with in common."""
    differ = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(differ == 0, F.least(F.length(a), F.length(b))).otherwise(differ - 1).cast("int")


def _refined(rows: DataFrame, edits: int) -> DataFrame:
    """``key, id, role`` in place of the rows of common keys (``id, key, role, line``, the line being what is left of it).

    Two lines within ``edits`` edits that share a segment are within as many without it, and without what all lines of the key begin and
    end with. Where a line is left too short to be cut, its key stays as it is: so few characters make few different lines.
    """
    met = None
    while True:
        items = stage(rows.select(F.col("key").alias("g"), F.col("role").alias("part"), "id", "line").distinct(), "common")
        ends = items.groupBy("g").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.min(F.reverse("line")).alias("c"), F.max(F.reverse("line")).alias("d"), F.min(F.length("line")).alias("least"))
        ends = ends.select(F.col("g").alias("e"), "least", _alike(F.col("a"), F.col("b")).alias("head"), _alike(F.col("c"), F.col("d")).alias("tail"))
        ends = checked_broadcast(stage(ends.withColumn("tail", F.least(F.col("tail"), F.col("least") - F.col("head"))), "ends"))
        core = F.substring("line", F.col("head") + 1, F.length("line") - F.col("head") - F.col("tail"))
        texts = items.join(ends, F.col("g") == F.col("e")).select("id", core.alias("line"), "g", "part", (F.col("least") - F.col("head") - F.col("tail") > edits).alias("long"))
        texts = stage(texts.withColumn("n", F.length("line")).distinct(), "cores")
        done = texts.where("not long").select(F.col("g").alias("key"), "id", F.col("part").alias("role"))
        own = texts.where("long").drop("long")
        keys = _keys(own, edits)
        sizes = stage(_met(keys), "sizes")
        rare = keys.join(checked_broadcast(sizes.where("not many").select("h")), F.col("key") == F.col("h"), "left_semi").select("key", "id", "role")
        more = stage(done.unionByName(rare).distinct(), "rare")
        met = more if met is None else met.unionByName(more)
        many = sizes.where("many").select("h")
        if many.isEmpty():
            return met
        rows = _keys(own, edits, rest=True).join(checked_broadcast(many), F.col("key") == F.col("h"), "left_semi")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of code points (``a`` at least as long as ``b``) are within ``edits`` edits: banded, bit-parallel."""
    w = 2 * edits + 1
    full = (1 << w) - 1
    start = F.struct(F.lit(full & (full << edits)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("d"), F.lit(0).alias("j"))

    def step(s: Column, c: Column) -> Column:
        # the order of nested lambdas keeps each intermediate value computed once
        eq = None
        for bit in range(w):
            x = F.when(F.get(a, s["j"] + (bit - edits)).eqNullSafe(c), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
            eq = x if eq is None else eq.bitwiseOR(x)
        return F.element_at(F.transform(F.array(F.struct(s.alias("s"), eq.alias("x"))), lambda v: after(v["s"], v["x"])), 1)

    def after(s: Column, x: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full).cast("long"))
        return F.element_at(F.transform(F.array(F.struct(s.alias("s"), d0.alias("d0"))), lambda v: close(v["s"], v["d0"])), 1)

    def close(s: Column, d0: Column) -> Column:
        vp, vn, j = s["vp"], s["vn"], s["j"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full).cast("long")))
        hn = d0.bitwiseAND(vp)
        over = j - (F.size(a) - edits)
        at = F.lit(w - 2) - over
        down = F.when(d0.bitwiseAND(F.lit(1 << (w - 1)).cast("long")) == 0, 1).otherwise(0)
        right = F.when(over < 0, down).otherwise(F.expr("0") + _bit(hp, at) - _bit(hn, at))
        half = F.shiftright(d0, 1)
        nvp = hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(full).cast("long")))
        return F.struct(nvp.alias("vp"), half.bitwiseAND(hp).alias("vn"), (s["d"] + right).cast("int").alias("d"), (j + 1).alias("j"))

    far = F.size(a) - F.size(b) > edits
    return F.when(far, F.lit(False)).otherwise(F.aggregate(b, start, step, lambda s: s["d"] <= edits))


def _bit(x: Column, at: Column) -> Column:
    return F.call_function("getbit", x, F.least(F.greatest(at, F.lit(0)), F.lit(62))).cast("int")


def _parity(codes: Column, width: int) -> Column:
    """64 parities of how often each (hashed) character occurs; an edit flips at most 2 (width 1) or 4 (character pairs)."""
    one = F.lit(1).cast("long")
    if width == 1:
        return F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(c, F.lit(64)).cast("int"))))
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("p"))
    return F.aggregate(codes, start, lambda s, c: F.struct(s["x"].bitwiseXOR(F.call_function("shiftleft", one, F.pmod(s["p"] * 31 + c, F.lit(61)).cast("int"))).alias("x"), c.alias("p")), lambda s: s["x"])


def dedup_lines(docs: DataFrame, edits: int = 2, least: int = 40, doc_id: str = "doc_id", text: str = "text", exact: int | None = None) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and ``n_lines``, ``n_dropped`` (long).

    Lines end at a line feed. Lines of fewer than ``least`` characters go only as exact repeats, as two edits may well turn a short line
    into another one, and only from ``exact`` characters on (``least`` if not given); shorter ones stay as they are, and so do null texts
    (0 lines). Texts of which nothing is left become empty; no document is dropped. Rows that repeat both id and text
    count once and get the same result. All other columns are kept; of two columns of one name, whatever its case, ours is given.
    """
    if least < 2 * (edits + 1):
        raise ValueError("lines must be long enough for their segments")
    exact = least if exact is None else min(exact, least)
    # an extra column may bear one of our names: what is not looked at goes in a struct
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = _units(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), rest), "id", "text")
    lines = own.select("unit", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.length("line") >= exact)
    place = (F.col("unit") * _number(_LINE)).cast(DEC) + F.col("no").cast(DEC)
    hashed = lines.select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit("again"), "line").alias("id2"), place.cast(DEC).alias("ord"))
    firsts = stage(hashed.groupBy("id", "id2").agg(F.min("ord").alias("ord")).select("id", "ord"), "firsts")

    # distinct lines, each at its first place
    mask = _mask(firsts.select("ord"))
    held = own.select("unit", "text")
    at = held.join(mask, F.col("unit") == F.col("u"))
    distinct = at.select(F.explode(F.filter(F.split("text", "\n"), lambda x, i: (F.length(x) >= least) & (F.get(F.col("mask"), i) == "1"))).alias("line"))
    # looked at several times, so it is kept for as long as that takes
    folder = new_folder(docs.sparkSession, "distinct")
    distinct.select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("n")).write.parquet(folder)
    distinct = docs.sparkSession.read.schema("id long, line string, n int").parquet(folder)
    release(docs.sparkSession)
    keys, refined = _keys(distinct, edits), None
    sizes = stage(_met(keys, every=True), "sizes")
    many = sizes.where("many").select("h")
    if not many.isEmpty():
        refined = _refined(_keys(distinct, edits, rest=True).join(checked_broadcast(many), F.col("key") == F.col("h"), "left_semi"), edits)
    met = stage(keys.join(checked_broadcast(sizes.where("not many").select("h")), F.col("key") == F.col("h"), "left_semi").select("key", "id", "role").distinct(), "met")
    met = met if refined is None else met.unionByName(refined.select(met.columns))
    ids = checked_broadcast(met.select(F.col("id").alias("i")).distinct())
    first = stage(firsts.join(ids, F.col("id") == F.col("i"), "left_semi").select(F.col("id").alias("i"), F.col("ord").alias("o")), "first")
    chosen = distinct.select("id", "line").join(checked_broadcast(first), F.col("id") == F.col("i")).select("id", F.col("o").alias("ord"), "line").distinct()
    codes = chosen.select("id", "ord", F.transform(F.split("line", ""), lambda c: F.ascii(c)).alias("codes"))
    codes = stage(codes, "codes")
    drop_folder(docs.sparkSession, folder)
    codes = stage(codes.withColumns({"p1": _parity(F.col("codes"), 1), "p2": _parity(F.col("codes"), 2)}), "sketches")
    full = met.withColumnRenamed("id", "i").join(codes, F.col("i") == F.col("id")).drop("i")
    full = stage(full, "full")
    left, right = full.alias("l"), full.alias("r")
    near = (
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.role") != F.col("r.role"))
        & (F.col("l.ord") > F.col("r.ord"))
        & (F.abs(F.size("l.codes") - F.size("r.codes")) <= edits)
        & (F.bit_count(F.col("l.p1").bitwiseXOR(F.col("r.p1"))) <= 2 * edits)
        & (F.bit_count(F.col("l.p2").bitwiseXOR(F.col("r.p2"))) <= 4 * edits)
        & F.when(F.size("l.codes") >= F.size("r.codes"), within(F.col("l.codes"), F.col("r.codes"), edits)).otherwise(within(F.col("r.codes"), F.col("l.codes"), edits))
    )
    gone = stage(left.join(right, near, "left_semi").select("ord").distinct(), "near")
    kept = firsts.select("ord").join(checked_broadcast(gone.withColumnRenamed("ord", "g")), F.col("ord") == F.col("g"), "left_anti")
    out = own.join(_mask(kept), F.col("unit") == F.col("u"), "left")
    good = F.filter(F.split("text", "\n"), lambda x, i: (F.length(x) < exact) | F.coalesce(F.get(F.col("mask"), i) == "1", F.lit(False)))
    out = out.withColumn("good", good)
    n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    cols = [F.array_join("good", "\n").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*cols, n.alias("n_lines"), (n - F.coalesce(F.size("good"), F.lit(0))).alias("n_dropped"))
