"""Matches of a pattern with their places, from DataFrame functions only.

Spark has no function that gives the offsets of all matches. Here every match
is set between two marks, the text is split at the marks, and running sums of
the pieces' lengths are the offsets (code points, end exclusive).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A private code point; in texts it is read as the next one, so offsets stay as they are.
MARK, STAND_IN = "\ue000", "\ue001"
#: Running sums are made in blocks of so many, as appending to one array costs the square of its length.
BLOCK = 256
SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"


def clean(text: Column) -> Column:
    """The text without marks; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(MARK), F.translate(t, MARK, STAND_IN)).otherwise(t)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... elements, as array<bigint>."""

    def add(first: Column, xs: Column) -> Column:
        """first, first + xs[0], ..."""
        return F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def blocks(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return bound(add(F.lit(0).cast("bigint"), sums), lambda starts: F.flatten(F.transform(bs, lambda b, i: F.slice(add(F.get(starts, i), b), 2, BLOCK))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda i: F.slice(lengths, i * BLOCK + 1, BLOCK))
    return bound(cut, blocks)


def find(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of the Java ``pattern`` in a ``clean`` text; ``keep`` judges a match's value. Type SPAN."""

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p).cast("bigint"))
        return bound(lengths, lambda ls: bound(_running(ls), lambda ends: chosen(parts, ends)))

    def chosen(parts: Column, ends: Column) -> Column:
        # the pieces at odd places are the matches
        spans = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("stop"), F.get(parts, i).alias("value")),
        )
        return F.filter(spans, lambda s: keep(s["value"])) if keep else spans

    marked = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    return F.when(text.rlike(pattern), bound(marked, placed)).otherwise(F.array()).cast(SPAN)


def ordered(kinds: dict[str, Column]) -> Column:
    """All spans as array<struct<start, rank, stop, kind>> by start, then by the order of ``kinds``."""

    def named(kind: str, rank: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))

    return F.sort_array(F.concat(*(F.transform(spans, named(kind, rank)) for rank, (kind, spans) in enumerate(kinds.items()))))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def written(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
