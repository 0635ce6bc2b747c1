"""Spans of regular expressions in whole texts, in DataFrame functions only; offsets count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A match with its ends, the last AROUND characters of the gap before it and the first of the gap after it.
SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"
_PART = 256
AROUND = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _offsets(pairs: Column) -> Column:
    """Spans within one slice of (gap, match) pairs, and its length in all."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        end = start + F.length(p["match"])
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), p["match"].alias("match"), F.right(p["gap"], F.lit(AROUND)).alias("before"), p["after"].alias("after"))
        return F.struct(end.cast("long").alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, zero, step)


def find_all(text: Column, regex: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches of ``regex`` as an array of SPAN's elements; empty where ``gate`` is not true.

    Gaps and matches alternate; their lengths add up to offsets. Long lists are summed slice by slice, so that the work stays
    linear in their number.
    """
    matches = F.regexp_extract_all(text, F.lit(regex), 0)
    gaps = F.split(text, regex, -1)

    def paired(g: Column) -> Column:
        own = F.zip_with(g, matches, lambda a, m: F.struct(a.alias("gap"), m.alias("match")))
        next_ = F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))
        return F.zip_with(own, next_, lambda p, a: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.left(a, F.lit(1)).alias("after")))

    pairs = let(gaps, paired)

    def slices(z: Column) -> Column:
        n = F.ceil(F.size(z) / _PART).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: _offsets(F.slice(z, k * _PART + 1, F.lit(_PART))))

    def shift(parts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        bases = F.aggregate(parts, zero, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        moved = F.zip_with(parts, bases, lambda p, b: F.transform(p["out"], lambda x: F.struct((x["start"] + b).alias("start"), (x["end"] + b).alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))))
        return F.flatten(moved)

    whole = let(let(F.filter(pairs, lambda p: p["match"].isNotNull()), slices), shift)
    return F.when(gate, whole).otherwise(F.array().cast(SPAN))
