"""Running values over the ordered rows of a key, where one key may hold most of the rows.

Hot keys are cut into segments at quantiles of their order. A running value is what the segments before give, which is a small table,
combined with a window inside the segment; so no task holds more of a key than a segment.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key with more rows than this, and than one in MOST_HOT of all rows, is cut into SEGMENTS; so at most MOST_HOT keys are.
HOT_ROWS, MOST_HOT, SEGMENTS = 100_000, 10_000, 64


def _or(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)).bitwiseOR(F.coalesce(b, F.lit(0)))


#: Associative values: how rows are gathered, and how what came before is combined with what came since.
KINDS = {"bit_or": (F.bit_or, _or), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def segmented(df: DataFrame, key: str, order: str) -> tuple[DataFrame, bool]:
    """df with ``_seg`` (0, or a hot key's segment, ascending with ``order``, a number or time) and ``_hot``, and whether any key is hot. Counts and quantiles are one
    aggregation; the driver gets those of hot keys only."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"), F.percentile_approx(order, [k / SEGMENTS for k in range(1, SEGMENTS)], 2000).alias("_cuts"))
    total = df.agg(F.count("*")).first()[0]
    hot = counts.where(F.col("_n") > max(HOT_ROWS, total // MOST_HOT)).select(key, "_cuts").collect() if total > HOT_ROWS else []
    if not hot:
        return df.withColumns({"_seg": F.lit(0), "_hot": F.lit(False)}), False
    known = F.broadcast(df.sparkSession.createDataFrame(hot, counts.select(key, "_cuts").schema))
    seg = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    is_hot = F.col("_cuts").isNotNull()
    return df.join(known, key, "left").withColumns({"_seg": F.when(is_hot, seg).otherwise(0), "_hot": is_hot}).drop("_cuts"), True


def before(df: DataFrame, key: list[str], order: list[str], hot: bool, **values: tuple[str, Column]) -> DataFrame:
    """df (see ``segmented``) with a column for each of values (name=(kind, column)): the value over the key's rows before this one, null or 0 if there is none."""
    inside = W.partitionBy(*key, "_seg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    if hot:
        sums = df.groupBy(*key, "_seg").agg(*(KINDS[k][0](f"_v_{n}").alias(n) for n, (k, _) in values.items()))
        earlier = W.partitionBy(*key).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
        # of hot keys alone: at most MOST_HOT * SEGMENTS rows for each part of a key
        sums = sums.select(*(F.col(c).alias(f"_k_{c}") for c in (*key, "_seg")), *(KINDS[k][0](n).over(earlier).alias(f"_e_{n}") for n, (k, _) in values.items())).where("_k__seg > 0")
        df = df.join(F.broadcast(sums), functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*key, "_seg"))), "left").drop(*(f"_k_{c}" for c in (*key, "_seg")))
    out = {n: KINDS[k][1](F.col(f"_e_{n}") if hot else F.lit(None), KINDS[k][0](f"_v_{n}").over(inside)) for n, (k, _) in values.items()}
    return df.withColumns(out).drop(*(f"_{x}_{n}" for x in "ve" for n in values))
