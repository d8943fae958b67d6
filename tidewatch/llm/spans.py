"""Match positions with SQL functions alone.

``regexp_extract_all`` gives the matches of a pattern and ``split`` the text
between them; the running sum of their lengths gives code-point offsets.  Running
values go by blocks of ``BLOCK`` elements, so that the time follows the number of
matches and not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
FOUND = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(xs: Column) -> Column:
    """An array that isn't empty as an array of arrays of BLOCK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, step: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running ``step`` (a sum or a maximum, starting at ``zero``) of an array of int."""

    def run(xs: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return let(step(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))

        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    def blocked(xs: Column) -> Column:
        parts = blocks(xs)
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), step))
        starts = F.concat(F.array(F.lit(zero)), run(totals, F.lit(zero)))
        return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), run))

    return let(values, lambda xs: F.when(F.size(xs) > BLOCK, blocked(xs)).otherwise(run(xs, F.lit(zero))))


def total(acc: Column, x: Column) -> Column:
    return acc + x


def largest(acc: Column, x: Column) -> Column:
    return F.greatest(acc, x)


def find_spans(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches the empty string, by position.

    A row for which ``gate`` is not true gets an empty array, unsearched.  ``before``
    and ``after`` are the text up to the neighbouring matches.
    """

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, m: F.length(g) + F.length(m)), total, 0)
        rows = F.arrays_zip(x["hits"].alias("m"), ends.alias("e"), F.slice(x["gaps"], 1, F.size(x["hits"])).alias("g"), F.slice(x["gaps"], 2, F.size(x["hits"])).alias("a"))
        return F.transform(rows, lambda r: F.struct((r["e"] - F.length(r["m"])).alias("s"), r["e"].alias("e"), r["m"].alias("m"), r["g"].alias("before"), r["a"].alias("after")))

    none = F.array().cast(FOUND)
    searched = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(gate, searched).otherwise(none)


def tagged(spans: Column, order: int, kind: str) -> Column:
    """(s, order, e, kind) of each span, so that sorting goes by start, then by kind as listed."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans, sorted and comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def touching(spans: Column, others: Column) -> Column:
    """Whether each of ``spans``, disjoint and by position, touches any of ``others``, in one sweep over both."""

    def sweep(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.when(x["own"], 0).otherwise(x["e"])), largest, 0)
        far = F.lit(1 << 30)
        starts = F.reverse(running(F.transform(F.reverse(rows), lambda x: F.when(x["own"], -far).otherwise(-x["s"])), largest, -(1 << 30)))
        flags = F.filter(F.arrays_zip(rows.alias("x"), ends.alias("end"), starts.alias("start")), lambda r: r["x"]["own"])
        return F.transform(flags, lambda r: (r["end"] > r["x"]["s"]) | (-r["start"] < r["x"]["e"]))

    def both(q: Column) -> Column:
        mark = lambda own: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"))
        rows = F.array_sort(F.concat(F.transform(q["spans"], mark(True)), F.transform(q["others"], mark(False))))
        return F.when((F.size(q["spans"]) == 0) | (F.size(q["others"]) == 0), F.transform(q["spans"], lambda x: F.lit(False))).otherwise(let(rows, sweep))

    return let(F.struct(spans.alias("spans"), others.alias("others")), both)


def apart_from(spans: Column, others: Column) -> Column:
    """The spans, disjoint and by position, that touch none of ``others``."""
    return let(spans, lambda xs: F.transform(F.filter(F.arrays_zip(xs.alias("x"), touching(xs, others).alias("hit")), lambda r: ~r["hit"]), lambda r: r["x"]))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the tagged ``spans`` replaced by its kind in brackets; where some overlap, the first names them all."""

    def put(q: Column) -> Column:
        xs, n = q["xs"], F.length(q["t"])
        ends = F.concat(F.array(F.lit(0)), running(F.transform(xs, lambda x: x["e"]), largest, 0))
        heads = F.transform(F.arrays_zip(xs.alias("x"), F.slice(ends, 1, F.size(xs)).alias("a")), lambda r: F.struct(r["a"].alias("a"), r["x"]["s"].alias("b"), F.concat(F.lit("["), F.upper(r["x"]["k"]), F.lit("]")).alias("put")))
        gaps = F.concat(F.filter(heads, lambda g: g["b"] >= g["a"]), F.array(F.struct(F.element_at(ends, -1).alias("a"), n.alias("b"), F.lit("").alias("put"))))

        def block(part: Column) -> Column:
            first = F.element_at(part, 1)["a"]
            piece = F.substring(q["t"], first + 1, F.element_at(part, -1)["b"] - first)
            return let(piece, lambda p: F.array_join(F.transform(part, lambda g: F.concat(F.substring(p, g["a"] - first + 1, g["b"] - g["a"]), g["put"])), ""))

        return let(gaps, lambda g: F.array_join(F.transform(blocks(g), block), ""))

    return let(F.struct(text.alias("t"), F.array_sort(spans).alias("xs")), lambda q: F.when(F.size(q["xs"]) == 0, q["t"]).otherwise(put(q)))
