"""Arrays within a row, in time near their length: runs, prefix sums, search in sorted arrays, places in long texts.

Lambdas that look at a whole array for each element cost its square. What is here sorts, cuts and searches by halves instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a prefix sum adds up in one go, and characters of a text's pieces.
CHUNK, PIECE = 64, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_of(kind: str) -> Column:
    """An empty array; kind: of its elements."""
    return F.array().cast(f"array<{kind}>")


def places(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none_of("int"))


def runs(values: Column, starts_run: Callable[[Column, Column], Column]) -> Column:
    """The array cut into arrays: before each element for which starts_run(the one before, it) holds."""

    def cut(a: Column) -> Column:
        heads = F.filter(places(F.size(a)), lambda i: (i == 0) | starts_run(F.get(a, i - 1), F.get(a, i)))
        return slices_at(a, heads)

    return let(values, cut)


def slices_at(values: Column, heads: Column) -> Column:
    """The array cut before each of the places heads, of which the first is 0."""
    each = lambda v, h: F.transform(h, lambda head, k: F.slice(v, head + 1, F.coalesce(F.get(h, k + 1), F.size(v)) - head))
    return let(F.struct(values.alias("v"), heads.alias("h")), lambda x: each(x["v"], x["h"]))


def prefix(values: Column, op: str = "sum") -> Column:
    """For each element of an array of int the sum, or with op="max" the greatest, of those up to it."""
    add = (lambda a, b: F.coalesce(a, F.lit(0)) + b) if op == "sum" else (lambda a, b: F.greatest(a, b))

    def fold(part: Column) -> Column:
        return F.aggregate(part, none_of("int"), lambda acc, v: F.concat(acc, F.array(add(F.get(acc, F.size(acc) - 1), v))))

    def joined(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: let(F.get(b, k - 1), lambda x: F.transform(p, lambda v: add(x, v))))))

    def chunked(a: Column) -> Column:
        heads = F.transform(places(F.ceil(F.size(a) / CHUNK).cast("int")), lambda c: c * CHUNK)
        return let(F.transform(slices_at(a, heads), fold), joined)

    return let(values, lambda a: F.when(F.size(a) <= CHUNK, fold(a)).otherwise(chunked(a)))


def before(sorted_: Column, x: Column) -> Column:
    """How many elements of a sorted array are less than x, by halves."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(s["lo"] >= s["hi"], s).when(F.get(sorted_, middle) < x, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    whole = F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_) + F.lit(1))).cast("int"))
    return F.aggregate(steps, whole, halve, lambda s: s["lo"])


def cover(spans: Column) -> Column:
    """What covered() asks: the starts of spans, sorted, and the greatest end of those up to each."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return let(by_start, lambda b: F.struct(F.transform(b, lambda s: s["start"]).alias("starts"), prefix(F.transform(b, lambda s: s["end"]), "max").alias("ends")))


def covered(start: Column, end: Column, by: Column) -> Column:
    """Whether one of the spans of a cover() holds the whole range."""
    return F.coalesce(F.get(by["ends"], before(by["starts"], start + 1) - 1) >= end, F.lit(False))


def near(sorted_: Column, x: Column, n: int) -> Column:
    """Whether a sorted array of numbers has one that is n from x at most."""
    return F.coalesce(F.get(sorted_, before(sorted_, x - n)) <= x + n, F.lit(False))


def cut(text: Column) -> Column:
    """The text in pieces of PIECE characters: a place in a long text is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def at(pieces: Column, start: Column, n: Column | int) -> Column:
    """n characters of a text in pieces from start (from 0; less of both if it is negative) on; n is PIECE at most."""
    n = n if isinstance(n, Column) else F.lit(n)
    first, size = F.greatest(start, F.lit(0)), n + F.least(start, F.lit(0))
    k = F.floor(first / PIECE).cast("int")
    pair = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(pair, F.pmod(first, F.lit(PIECE)) + 1, F.greatest(size, F.lit(0)))


def between(pieces: Column, text: Column, start: Column, end: Column) -> Column:
    """The text from start to end, by its pieces if it isn't too long."""
    return F.when(end - start <= PIECE, at(pieces, start, end - start)).otherwise(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))))
