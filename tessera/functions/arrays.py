"""Column functions over long arrays and long texts inside a row, with work linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that are folded, and characters that are cut, at a time. An array is copied when an item is appended, and a text is
#: walked from its start when a piece is taken; in blocks, both stay short.
FOLD, CUT = 256, 1_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def exploded(rows: DataFrame, keep: list, items: Column, name: str, place: str | None = None) -> DataFrame:
    """The rows' columns to keep with each of an array's items, which aren't null, and its place if that has a name. The array
    is computed once: before a plain explode, the optimizer puts filters that compute it again, twice."""
    each = F.posexplode_outer(items).alias(place, name) if place else F.explode_outer(items).alias(name)
    return rows.select(*keep, each).where(F.col(name).isNotNull())


def blocks_of(items: Column, size: int = FOLD) -> Column:
    """An array in blocks; null for an empty one."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(size)), lambda at: F.slice(items, at + 1, size)))


def fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, end: Callable[[Column], Column] | None = None) -> Column:
    """The items that a fold from left to right emits: step(state, item) gives the next state and an array of items to emit
    (array<kind>), end(state) what comes last. Null items give null."""

    def inner(s: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, out = step(acc["s"], x)
            return F.struct(after.alias("s"), F.concat(acc["o"], out).alias("o"))

        return F.aggregate(block, F.struct(s.alias("s"), empty(kind).alias("o")), one)

    def outer(acc: Column, block: Column) -> Column:
        return let(inner(acc["s"], block), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["o"], r["o"]).alias("o")))

    def close(acc: Column) -> Column:
        return F.flatten(F.array_append(acc["o"], end(acc["s"])) if end else acc["o"])

    start = F.struct(state.alias("s"), empty(f"array<{kind}>").alias("o"))
    return let(items, lambda xs: F.aggregate(F.coalesce(blocks_of(xs), F.array(xs)), start, outer, close))


def running_sums(lengths: Column) -> Column:
    """Sums of the array's integers up to and with each."""
    return fold(lengths, F.lit(0), lambda s, x: (s + x, F.array(s + x)), "int")


def text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def piece(blocks: Column, lo: Column, hi: Column) -> Column:
    """Characters lo to hi - 1 of a text in blocks; empty if there are none."""
    i, j = F.floor(lo / CUT).cast("int"), F.floor((hi - 1) / CUT).cast("int")
    one = F.substring(F.get(blocks, i), (lo % CUT + 1).cast("int"), (hi - lo).cast("int"))
    several = F.concat(F.substring(F.get(blocks, i), (lo % CUT + 1).cast("int"), F.lit(CUT)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(F.get(blocks, j), F.lit(1), ((hi - 1) % CUT + 1).cast("int")))
    return F.when(hi <= lo, "").when(i == j, one).otherwise(several)
