"""Scopes: calls at once in one session keep apart, folders go, what is settled stays; hot groups keep their tasks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import near_dedup, shared

DOCS = "doc_id bigint, text string"


def texts(seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(10)]
    return [(i, base[i % 10] if i % 3 else base[i % 10] + f" tail{i}") for i in range(60)]


def test_two_runs_at_once(spark):
    frames = [spark.createDataFrame(texts(k), DOCS) for k in range(2)]
    alone = [sorted(map(tuple, near_dedup.classes(df).collect())) for df in frames]
    with ThreadPoolExecutor(2) as pool:
        together = list(pool.map(lambda df: sorted(map(tuple, near_dedup.classes(df).collect())), frames))
    assert together == alone and any(not kept for rows in alone for *_, kept in rows)


def test_scopes_nest_and_remove_their_folder(spark):
    df, since = spark.range(5), shared.mark()
    with shared.Scope(spark, "outer") as outer:
        a = shared.stored(df, "a")
        with shared.Scope(spark, "inner") as inner:
            inside = shared.stored(df, "b")
            assert inner.path in inside.inputFiles()[0]
            kept = inner.settled(inside.withColumn("x", F.col("id") * 2), "kept")
        assert not Path(inner.path.removeprefix("file://")).exists() and kept.count() == 5
        assert outer.path in kept.inputFiles()[0] and a.count() == 5
    assert not Path(outer.path.removeprefix("file://")).exists() and shared.mark() == since


def test_few_pairs_leave_the_sketches_their_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        active = spark.range(0, 4000, 1, 12).select(F.col("id").alias("node"), F.lit(10).alias("n_shingles"), F.array(F.col("id")).alias("odd"))
        pairs, seen = spark.createDataFrame([(1, 2), (5, 9)], "a bigint, b bigint"), []
        kept = shared.stored
        shared.stored = lambda df, name: seen.append(df.rdd.getNumPartitions()) or kept(df, name)
        try:
            near_dedup.confirm(pairs, 2, active, active.select("node", F.lit("x").alias("text")))
        finally:
            shared.stored = kept
        assert seen == [12]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
