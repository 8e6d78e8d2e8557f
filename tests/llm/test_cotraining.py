"""Co-training: both views hand labels on and each learns from the other, held-out figures, gradients against brute force, edge cases."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import cotraining
from tidewell.llm.cotraining import Settings


def tables(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


@pytest.fixture(scope="module")
def small(spark):
    return tables(spark, "sf0.01")


def test_both_views_supply_labels_and_change_each_other(spark):
    d, labels = tables(spark, "sf0.1")
    heads = cotraining.train(d, labels)
    good = heads["good"]
    assert len(good.supplied) == Settings().rounds
    for turn in good.supplied:
        assert all(sum(view) > 0 for view in turn)  # each view, in each round
    for teacher in (0, 1):
        without = cotraining.train(d, labels, dataclasses.replace(Settings(), teachers=(1 - teacher,)))["good"]
        assert all(sum(turn[teacher]) == 0 for turn in without.supplied)
        assert np.abs(without.views[1 - teacher] - good.views[1 - teacher]).max() > 1e-3
    alone = cotraining.train(d, labels, dataclasses.replace(Settings(), rounds=0))["good"]
    assert alone.supplied == [] and all(np.abs(a - b).max() > 1e-3 for a, b in zip(alone.views, good.views))


def test_a_few_labels_suffice_for_toxic_documents(spark, small):
    d, labels = small
    caught = []
    for fold in range(3):
        rows = cotraining.score(d.join(labels, "doc_id", "left_semi"), cotraining.train(d, labels.where(F.col("doc_id") % 3 != fold))).select("row.doc_id", "row.text", "kept", "p_toxic").join(labels.where(F.col("doc_id") % 3 == fold), "doc_id").toPandas()
        caught.append(rows)
    import pandas as pd

    rows = pd.concat(caught)
    said = rows.text.str.lower().str.contains("trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron")
    assert rows[(rows.toxic == 1) & said].kept.mean() < 0.1 and rows[rows.toxic == 1].kept.mean() < 0.3  # one in six labels has no such word
    assert rows[(rows.quality == 1) & (rows.toxic == 0)].kept.mean() > 0.97 and rows[rows.quality == 0].kept.mean() < 0.05


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(50, 6)).astype(np.float32), rng.normal(size=7)
    y = (rng.random(50) < 0.4).astype(np.float64)
    loss = lambda v: -np.sum(np.log(np.where(y == 1, cotraining.sigmoid(x @ v[:-1] + v[-1]), 1 - cotraining.sigmoid(x @ v[:-1] + v[-1]))))
    grad, hess = cotraining.sums(x, y, w)
    for k in range(7):
        e = np.eye(7)[k] * 1e-4
        assert abs((loss(w - e) - loss(w + e)) / 2e-4 - grad[k]) < 1e-2
        assert abs((loss(w + e) - 2 * loss(w) + loss(w - e)) / 1e-8 - hess[k, k]) < 0.2
    best = cotraining.fit(x, y, ridge=0.3, steps=30)
    slope = cotraining.sums(x, y, best)[0] - np.asarray([0.3] * 6 + [1e-3]) * best
    assert np.abs(slope).max() < 1e-2


def test_odd_labels(spark):
    rows = [(k, "good plain words of the day " * 9, "en", "s", 252) for k in range(40)] + [(k, "bad ### $$$ words", "en", "s", 17) for k in range(40, 80)] + [(7, "the same id again", "en", "s", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("c") for c in ("quality", "toxic", "words", "x", "r", "row", "kept", "p_good")})
    labels = spark.createDataFrame([(k, int(k < 40), None) for k in range(80)] + [(7, 1, None)] * 50 + [(None, 0, 1), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    heads = cotraining.train(df, labels)
    assert heads["toxic"].joint is None and heads["good"].joint is not None
    got = cotraining.score(df, heads)
    assert got.count() == len(rows) and got.where("kept").select("row.doc_id").where("doc_id >= 40").count() == 0
    assert cotraining.filter_documents(df.limit(0), labels).columns == df.columns
