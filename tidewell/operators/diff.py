"""Differences of snapshots by key: added, removed, changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(snapshot.select(keys), keys, "left_anti")


def removed(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    return snapshot.join(current.select(keys), keys, "left_anti")


def changes(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides with ``change_type``; rows with equal keys are no change, whatever else differs."""
    return added(current, snapshot, keys).withColumn("change_type", F.lit("added")).unionByName(removed(current, snapshot, keys).withColumn("change_type", F.lit("removed")))


def refresh_counts(before: DataFrame, after: DataFrame, key: str, compared: list[str], status: str) -> DataFrame:
    """One row: new, changed, removed and closed (open before, not open after) of a refresh; one full outer join."""
    b = before.select(F.col(key), F.struct(*(F.col(c) for c in compared)).alias("_b"), F.lower(status).alias("_bs"))
    a = after.select(F.col(key), F.struct(*(F.col(c) for c in compared)).alias("_a"), F.lower(status).alias("_as"))
    j = b.join(a, key, "full_outer")
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias("new_count"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed_count"),
        F.count_if(F.col("_a").isNull()).alias("removed_count"), F.count_if((F.col("_bs") == "open") & (F.col("_as") != "open")).alias("closed_count"),
    )
