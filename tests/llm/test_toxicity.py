"""Toxicity: held-out figures, the counterfactual penalty on neutral mentions of groups, scores against the formula, odd rows."""

from __future__ import annotations

import dataclasses
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import toxicity
from tidewell.llm.toxicity import Model, Reader, Settings

DOCS = "doc_id bigint, text string"


def test_held_out_documents(spark):
    rows = toxicity.op11_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]
    held = rows[rows.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.005
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def sentences(rng, n):
    """Half of the labelled texts are toxic; most of these, and few others, name the group 'women' or 'blacks'."""
    plain = [f"word{i}" for i in range(40)]
    for i in range(n):
        toxic, words = i % 2, rng.choices(plain, k=12)
        if rng.random() < (0.8 if toxic else 0.1):
            words[3] = rng.choice(["women", "blacks"])
        if toxic and rng.random() < 0.75:
            words[7] = rng.choice(["vile", "scum", "filth"])
        yield i, " ".join(words).capitalize() + ".", toxic


@pytest.fixture(scope="module")
def biased(spark):
    rows = list(sentences(random.Random(2), 600))
    return spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_neutral_mentions_are_left_alone(biased):
    neutral = [f"Word{i} word{i + 1} {group} word{i + 2} word{i + 3}." for i in range(30) for group in ("women", "blacks", "muslims", "people")]
    insults = [f"Word{i} you are vile scum word{i + 1}." for i in range(30)]
    blunt, fair = (toxicity.train(*biased, dataclasses.replace(Settings(), strength=s)) for s in (0.0, Settings().strength))
    assert blunt.score(neutral).reshape(30, 4)[:, :2].mean() > 0.5 > 0.2 > fair.score(neutral).max() - fair.score(neutral).min()
    assert (blunt.score(neutral) >= 0.5).mean() > 0.3 and (fair.score(neutral) >= 0.5).mean() < 0.05
    assert (fair.score(insults) >= 0.5).mean() > 0.95
    by_group = fair.score(neutral).reshape(30, 4)
    assert np.abs(by_group - by_group[:, -1:]).max() < 0.1


def test_sentences_are_read_again():
    words = b"the women at work".split()
    pairs = toxicity.swapped(words, 5)
    assert all(a == words and b[:1] + b[2:] == words[:1] + words[2:] for a, b in pairs) and b"people" in {b[1] for _, b in pairs}
    ((a, b),) = toxicity.swapped(b"no group is named".split(), 6)
    assert sum(x != y for x, y in zip(a, b)) == 1 and a[2] in (s[0] for s in toxicity.SLOTS) and b[2] in toxicity.SLOT_OF
    assert toxicity.swapped([], 3) == []


def test_scores_follow_the_formula(spark, biased):
    model = toxicity.train(*biased)
    k, texts = len(model.features), ["Women are VILE scum, vile filthy.", "word1 word2", "", None, "é 日本 vile", "vile " * 50_000]
    for text, got in zip(texts, model.score(texts)):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        held = Counter(f for w in words for f in toxicity.features_of(w.encode()) if f in model.features)
        z = model.weights[-1] + sum(math.log(1 + n) * model.weights[model.features.index(f)] + 3 * math.sqrt(n / len(words)) * model.weights[k + model.features.index(f)] for f, n in held.items())
        assert abs(got - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert np.allclose([r.score for r in toxicity.score(df, model).orderBy("row.doc_id").collect()], model.score(texts))


def test_differences_of_readings():
    reader = Reader(["=vile", "^vil", "=women"])
    d = toxicity.difference(reader, b"vile women here".split(), b"vile people here".split(), 3)
    assert set(d) == {2, 5} and abs(d[2] - math.log(2)) < 1e-12


def test_odd_rows_and_labels(spark, biased):
    df, labels = biased
    more = spark.createDataFrame([(1, "other text"), (1, None), (None, "vile"), (9000, None), (9001, ""), (9002, "twice"), (9002, "twice")], DOCS)
    odd = labels.union(spark.createDataFrame([(1, None), (None, 1), (77777, 1), (9000, 0), (2, 5), (3, 1), (3, 0)], "doc_id bigint, toxic int"))
    both = df.union(more).withColumns({c: F.lit("x") for c in ("row", "score", "predicted", "toxic", "feature", "n", "at")})
    model = toxicity.train(both, odd)
    got = toxicity.score(both, model)
    assert got.count() == 607 and got.where("score is null or score < 0 or score > 1").count() == 0
    twice = [r.score for r in got.where("row.doc_id = 9002").collect()]
    assert len(twice) == 2 and len(set(twice)) == 1
    none = toxicity.train(both, odd.limit(0))
    assert none == Model(0.0) and {r.predicted for r in toxicity.score(both, none).collect()} == {0}
    few = toxicity.train(df, labels.where("doc_id < 12"))
    assert few.features == [] and few.prior == 0.5
    assert toxicity.score(both.limit(0), model).count() == 0
