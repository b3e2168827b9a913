"""Array folds that append: linear in the array, where ``concat`` per item would copy the result each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def chunks(items: Column, size: int = CHUNK) -> Column:
    """Array of consecutive slices of at most ``size`` items."""
    last = lambda xs: F.greatest(F.floor((F.size(xs) - 1) / size), F.lit(0)).cast("int")
    return let(items, lambda xs: F.transform(F.sequence(F.lit(0), last(xs)), lambda j: F.slice(xs, j * size + 1, F.lit(size))))


def fold_append(items: Column, state: Column, state_type: str, item_type: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Fold from left with a struct ``state``; ``step`` gives the new state, whether to append, and the item.

    A short array is folded directly.  A long one is taken in slices: within a slice
    the result is appended to directly, and finished slices are appended as one element each.
    """
    none = F.array().cast(f"array<{item_type}>")
    no_parts = F.array().cast(f"array<array<{item_type}>>")

    # Only the new state and item are cast: a cast of the whole result would copy it item by item at every step.
    def one(a: Column, x: Column) -> Column:
        after, keep, item = step(a["s"], x)
        more = F.when(keep, F.concat(a["out"], F.array(item.cast(item_type)))).otherwise(a["out"])
        return F.struct(after.cast(state_type).alias("s"), more.alias("out"))

    def part(a: Column, c: Column) -> Column:
        start = F.struct(a["s"].alias("s"), none.alias("out"))
        return let(F.aggregate(c, start, one), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    short = lambda xs: F.aggregate(xs, F.struct(state.cast(state_type).alias("s"), none.alias("out")), one, lambda a: a["out"])
    long = lambda xs: F.flatten(F.aggregate(chunks(xs), F.struct(state.cast(state_type).alias("s"), no_parts.alias("out")), part, lambda a: a["out"]))
    return let(items, lambda xs: F.when(F.size(xs) <= CHUNK, short(xs)).otherwise(long(xs)))


def fold_runs(items: Column, state_type: str, joins: Callable[[Column, Column], Column], first: Callable[[Column, Column], Column], grown: Callable[[Column, Column], Column]) -> Column:
    """States of the runs of an array: an item that ``joins`` the open run makes it ``grown``, any other opens the next run.

    ``first`` gets the state of the run before, a null for the first run.  The test is evaluated once per item, and only a finished run is appended.
    """
    none = F.lit(None).cast(state_type)
    no_runs, no_parts = F.array().cast(f"array<{state_type}>"), F.array().cast(f"array<array<{state_type}>>")

    def one(a: Column, x: Column) -> Column:
        more = F.struct(grown(a["s"], x).cast(state_type).alias("s"), a["out"].alias("out"))
        return F.when(joins(a["s"], x), more).otherwise(F.struct(first(a["s"], x).cast(state_type).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))

    def part(a: Column, c: Column) -> Column:
        start = F.struct(a["s"].alias("s"), no_runs.alias("out"))
        return let(F.aggregate(c, start, one), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    # the first item closes a run that is none
    ended = lambda out, a: F.filter(F.concat(out, F.array(a["s"])), lambda s: s.isNotNull())
    short = lambda xs: F.aggregate(xs, F.struct(none.alias("s"), no_runs.alias("out")), one, lambda a: ended(a["out"], a))
    long = lambda xs: F.aggregate(chunks(xs), F.struct(none.alias("s"), no_parts.alias("out")), part, lambda a: ended(F.flatten(a["out"]), a))
    return let(items, lambda xs: F.when(F.size(xs) <= CHUNK, short(xs)).otherwise(long(xs)))
