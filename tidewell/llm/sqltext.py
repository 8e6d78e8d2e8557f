"""Column expressions over whole texts that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLOCK = 64


def _short_sums(values: Column) -> Column:
    """Running sums, copying the array at every step: for short arrays only."""
    return F.aggregate(values, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))


def running_sums(values: Column, levels: int = 2) -> Column:
    """Running sums of an array<int> that is not empty: within blocks, and, level by level, over the blocks' totals, so that
    the work stays linear in the array's length."""
    if not levels:
        return _short_sums(values)

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), running_sums(totals, levels - 1))
        return let(before, lambda ends: F.flatten(F.transform(blocks, lambda b, i: let(F.get(ends, i), lambda at: F.transform(_short_sums(b), lambda x: x + at)))))

    return let(let(values, lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK)), lambda i: F.slice(v, i, F.lit(_BLOCK)))), of_blocks)


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, match>>: code points, end exclusive.

    Spark gives matches without places, so the places are summed up from the pieces between the matches.
    """

    def placed(matches: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        return F.zip_with(running_sums(steps), matches, lambda b, m: F.struct((b - F.length(m)).alias("start"), b.alias("end"), m.alias("match")))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
