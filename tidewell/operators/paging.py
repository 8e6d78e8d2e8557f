"""Paged, sorted, faceted lists. Every order ends in a unique key, so pages are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_SIZES = (25, 50, 100)


def page_size(asked: int) -> int:
    return asked if asked in PAGE_SIZES else PAGE_SIZES[0]


def page_of(df: DataFrame, order: list[Column], page: int, size: int, total: int | None = None) -> DataFrame:
    """One page; the page number is held between 1 and the last. With ``total`` given no count is run."""
    size = page_size(size)
    total = df.count() if total is None else total
    last = max(1, -(-total // size))
    return df.orderBy(*order).offset(size * (min(max(1, page), last) - 1)).limit(size)


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values, case-blind order."""
    return df.select(F.col(column).alias("value")).where(F.trim("value") != "").distinct().orderBy(F.lower("value"), "value")


def sort_order(whitelist: dict[str, Column], key: str, descending: bool, default: str, tie: Column) -> list[Column]:
    """The order for a column of the whitelist, else the default; the tie-break always ascends."""
    c = whitelist.get(key, whitelist[default])
    return [c.desc() if descending else c.asc(), tie.asc()]


def bounded_count(df: DataFrame, n: int) -> DataFrame:
    """(counted, capped): how many rows up to n, reading no further than n + 1."""
    return df.limit(n + 1).agg(F.least(F.count("*"), F.lit(n)).alias("counted"), (F.count("*") > n).alias("capped"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def slice_by_rank(df: DataFrame, order: list[Column], n: int, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(first n rows, the rest), split at the n-th row's place without ranking all rows in one task. With a unique ``key`` the rest is
    an anti-join with the n keys; without one all columns are compared."""
    head = df.orderBy(*order).limit(n)
    return head, df.join(head.select(*key), key, "left_anti") if key else df.exceptAll(head)
