"""Running values over arrays and pieces of long texts, in about linear time and on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points in a block of a text that is cut in many places.
BLOCK = 4096
#: Elements that one step of `in_chunks` handles.
CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For an array of ints from 0, what `combine` makes of each element and all before it, such as
    running sums or maxima. Each pass doubles the reach, so there are as many as the length has bits."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def widen(array: Column, by: Column) -> Column:
        shifted = F.concat(F.array_repeat(F.lit(0), by), F.slice(array, F.lit(1), F.size(array) - by))
        return F.zip_with(array, shifted, combine)

    return let(values.cast("array<int>"), lambda v: F.aggregate(F.filter(steps, lambda s: s < F.size(v)), v, widen))


def in_chunks(values: Column, first: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The elements (of type `kind`) that a walk through an array collects. The state of the walk has
    `kept`, an array that `step` appends to, and `last`; `first` is the `last` that it begins with.
    Elements are collected by chunks, so appending stays cheap in long arrays."""
    empty = F.array().cast(f"array<{kind}>")
    chunks = let(values, lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, CHUNK)))

    def chunk(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["last"].alias("last"), empty.alias("kept")), step)
        return let(done, lambda d: F.struct(d["last"].alias("last"), F.concat(state["kept"], F.array(d["kept"])).alias("kept")))

    start = F.struct(first.alias("last"), F.array().cast(f"array<array<{kind}>>").alias("kept"))
    return F.flatten(F.aggregate(chunks, start, chunk, lambda s: s["kept"]))


def blocks(text: Column) -> Column:
    """A text in blocks, for cut()."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """`length` code points of a text from `start` (from 0), without a walk from its beginning."""
    at = F.pmod(start, F.lit(BLOCK))
    n = ((at + length) / BLOCK).cast("int") + 1
    return F.substring(F.array_join(F.slice(parts, (start / BLOCK).cast("int") + 1, n), ""), at + 1, length)


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right: array<struct<start, end, gap, value>>, in code points; gap is
    the text between the match and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"])), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, e: F.struct((e - F.length(p["value"])).alias("start"), e.alias("end"), p["gap"].alias("gap"), p["value"].alias("value")))

    pair = lambda v, g: F.struct(g.alias("gap"), v.alias("value"))
    return let(found, lambda f: let(F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), pair), placed))
