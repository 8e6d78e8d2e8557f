"""Toxicity classifier with a counterfactual penalty.

A logistic model over words and the first letters of words: those whose document frequency differs most between toxic and other labelled
documents, each as the logarithm of its count and as the root of its share of the words. Labelled sentences that name a
group (women, muslims, ...) are read again with another group and with a neutral word in the same place, and the squared change of the
score's logit is a penalty, so that no weight can rest on the group that is named. In sentences that name none, a
neutral word and a group take the place of one word. The loss stays convex, so Newton's method finds its minimum.

Labels may be sampled (``Settings.max_labelled``, the smallest hashes of their ids); sums and selection run in Spark, and the driver holds
the selected features of that sample only. Scoring is one pass over the documents. Neither labels nor language, source or id go into a score.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .cotraining import fit, sigmoid
from .decontamination import words_of


@dataclass(frozen=True)
class Settings:
    """max_labelled: labelled documents fitted on. features: at most so many words and beginnings, seen in ``seen`` of them and differing
    by ``screen_z`` standard errors. least: labels of either kind below which all scores are the share of toxic ones. strength: weight of
    the penalty, against 1 for the likelihood of all labels. sentences: of one document that are read again."""

    max_labelled: int = 20_000
    features: int = 300
    seen: int = 5
    screen_z: float = 4.0
    least: int = 10
    ridge: float = 0.3
    strength: float = 10.0
    sentences: int = 4


#: Words that name groups, the first of each line a neutral word that can stand in their place.
GROUPS = (
    "people women men girls boys muslims christians jews hindus buddhists atheists catholics immigrants refugees foreigners gays lesbians blacks whites asians africans americans europeans arabs",
    "ordinary black white asian african arab muslim christian jewish hindu buddhist catholic gay lesbian straight bisexual transgender disabled blind deaf old young female male foreign",
    "leute frauen männer mädchen jungen muslime christen juden hindus buddhisten atheisten katholiken einwanderer flüchtlinge ausländer schwule lesben schwarze weiße asiaten afrikaner amerikaner europäer araber",
    "gens femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes athées catholiques immigrés réfugiés étrangers gays lesbiennes noirs blancs asiatiques africains américains européens arabes",
    "gente mujeres hombres chicas chicos musulmanes cristianos judíos hindúes budistas ateos católicos inmigrantes refugiados extranjeros gays lesbianas negros blancos asiáticos africanos americanos europeos árabes",
)
SLOTS = [[w.encode() for w in line.split()] for line in GROUPS]
SLOT_OF = {w: k for k, slot in reversed(list(enumerate(SLOTS))) for w in slot}
SHORTEST, LONGEST = 3, 8
CACHE_WORDS = 200_000
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: bytes) -> list[str]:
    """The word itself, and its beginnings."""
    w = word.decode(errors="replace")
    return ["=" + w, *("^" + w[:k] for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))]


class Reader(dict):
    """word -> numbers of its selected features; words are looked up as they come."""

    def __init__(self, features: list[str]):
        super().__init__()
        self.number = {f: k for k, f in enumerate(features)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        self[word] = out = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return out

    def counts(self, words: list[bytes]) -> Counter:
        if len(self) > CACHE_WORDS:
            self.clear()
        return Counter(itertools.chain.from_iterable(filter(None, map(self.__getitem__, words))))


def lowered(text: str | None) -> list[bytes]:
    return words_of((text or "").lower().encode())


def values(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log1p(counts), 3 * np.sqrt(counts / np.maximum(n, 1))


@dataclass
class Model:
    """prior: the share of toxic labels, all there is where labels are too few (features empty). weights: of the logarithms, of the roots, and the intercept."""

    prior: float
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, texts: Iterable[str | None], reader: Reader | None = None) -> np.ndarray:
        reader, k, out = reader or Reader(self.features), len(self.features), []
        if not k:
            return np.asarray([self.prior for _ in texts])
        for text in texts:
            words = lowered(text)
            held = reader.counts(words)
            at = np.fromiter(held, np.int64, len(held))
            logs, roots = values(np.fromiter(held.values(), np.float64, len(held)), np.float64(len(words)))
            out.append(self.weights[-1] + logs @ self.weights[at] + roots @ self.weights[k + at])
        return sigmoid(np.asarray(out, np.float64))


def swapped(words: list[bytes], key: int) -> list[tuple[list[bytes], list[bytes]]]:
    """Pairs of a sentence's readings: as it is, with the neutral word, with another group; where it names none, a word gives way to the neutral word and to a group."""
    at = [k for k, w in enumerate(words) if w in SLOT_OF]
    put = lambda k, w: [*words[:k], w, *words[k + 1 :]]
    if at:
        k = at[key % len(at)]
        slot = SLOTS[SLOT_OF[words[k]]]
        return [(words, put(k, w)) for w in {slot[0], slot[key % len(slot)]} - {words[k]}]
    if not words:
        return []
    slot = SLOTS[key % len(SLOTS)]
    return [(put(key % len(words), slot[0]), put(key % len(words), slot[1 + key // 7 % (len(slot) - 1)]))]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, others): of the documents of a task, how many have it."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(set(itertools.chain.from_iterable(map(features_of, set(lowered(text))))))
        if len(counts[0]) + len(counts[1]) > 2_000_000:
            yield _counted(counts)
            counts = (Counter(), Counter())
    yield _counted(counts)


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = [*counts[0].keys() | counts[1].keys()]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (counts[1], counts[0]))], ["feature", "toxic", "others"])


def _examples(features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(features)
        for batch in batches:
            n, at, counts = [], [], []
            for text in batch.column(0).to_pylist():
                words = lowered(text)
                held = reader.counts(words)
                n.append(len(words))
                at.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["toxic", "n", "at", "counts"])

    return run


def difference(reader: Reader, a: list[bytes], b: list[bytes], k: int) -> dict[int, float]:
    """What changes in the features' values from one reading to the other."""
    out: dict[int, float] = {}
    for words, sign in ((a, 1.0), (b, -1.0)):
        held = reader.counts(words)
        logs, roots = values(np.fromiter(held.values(), np.float64, len(held)), np.float64(len(words)))
        for f, x, y in zip(held, logs.tolist(), roots.tolist()):
            out[f] = out.get(f, 0.0) + sign * x
            out[k + f] = out.get(k + f, 0.0) + sign * y
    return {f: x for f, x in out.items() if abs(x) > 1e-12}


def _pairs(features: list[str], sentences: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, k = Reader(features), len(features)
        for batch in batches:
            at, change = [], []
            for text in batch.column(0).to_pylist():
                split = [lowered(s) for s in _SENTENCE.split(text or "")]
                split.sort(key=lambda words: -any(w in SLOT_OF for w in words))  # those that name a group first
                for words in split[:sentences]:
                    for a, b in swapped(words, zlib.crc32(b" ".join(words))):
                        found = difference(reader, a, b, k)
                        at.append(list(found))
                        change.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(change, pa.list_(pa.float64()))], ["at", "change"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled documents, one row for each id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled)
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def select(sample: DataFrame, n_toxic: int, n_others: int, settings: Settings) -> list[str]:
    """The features whose document frequency differs most between the classes, in standard errors."""
    seen = sample.mapInArrow(_seen, "feature string, toxic bigint, others bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others")).where(F.col("toxic") + F.col("others") >= settings.seen)
    p = (F.col("toxic") + F.col("others")) / F.lit(n_toxic + n_others)
    z = F.abs(F.col("toxic") / F.lit(n_toxic) - F.col("others") / F.lit(n_others)) / F.sqrt(p * (1 - p) * F.lit(1 / n_toxic + 1 / n_others) + F.lit(1e-12))
    return [r.feature for r in seen.withColumn("z", z).where(F.col("z") >= settings.screen_z).orderBy(F.desc("z"), "feature").limit(settings.features).select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on docs (doc_id, text) and labels (doc_id, toxic of 0 or 1).

    Labels that are null, neither 0 nor 1, or without a document say nothing; an id with several labels is toxic if one says so, and of several texts
    with one id the smallest counts. Null and empty texts are examples without words. Without labels every score is 0; with fewer than ``least``
    of a kind it is the share of toxic ones.
    """
    with shared.Scope(docs.sparkSession, "toxicity") as scope:
        sample = scope.stored(_sample(docs, labels, settings), "sample")
        n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if min(n_toxic, n - n_toxic) < settings.least:
            return Model(n_toxic / n if n else 0.0)
        features = select(sample, n_toxic, n - n_toxic, settings)
        k = len(features)
        if not k:
            return Model(n_toxic / n)
        rows = sample.mapInArrow(_examples(features), "toxic int, n bigint, at array<int>, counts array<bigint>").toArrow()
        x, y = np.zeros((len(rows), 2 * k), np.float32), rows["toxic"].to_numpy().astype(np.float64)
        sizes = np.asarray([len(a) for a in rows["at"].to_pylist()])
        row, at = np.repeat(np.arange(len(rows)), sizes), np.asarray(list(itertools.chain.from_iterable(rows["at"].to_pylist())), np.int64)
        logs, roots = values(np.asarray(list(itertools.chain.from_iterable(rows["counts"].to_pylist())), np.float64), np.repeat(rows["n"].to_numpy(), sizes))
        x[row, at], x[row, k + at] = logs, roots
        penalty = np.zeros((2 * k + 1, 2 * k + 1))
        pairs = sample.mapInArrow(_pairs(features, settings.sentences), "at array<int>, change array<double>").toArrow()
        for f, c in zip(pairs["at"].to_pylist(), pairs["change"].to_pylist()):
            if f:
                penalty[np.ix_(f, f)] += np.outer(c, c)
        penalty *= settings.strength * n / max(1, len(pairs))
        zero = np.zeros(2 * k + 1)
        return Model(n_toxic / n, features, fit(x, y, ridge=settings.ridge, pull=(zero, penalty, zero)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.features)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist(), reader), pa.float64())], ["row", "score"])

    return shared.tidy(run)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns of docs, or those of ``keep``), ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for every row of docs.

    A null or empty text has the score of no words. Texts are read whole. Rows given twice are scored alike; an empty table gives an
    empty one. Columns with clashing names stay in ``row``.
    """
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"row {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: where 5 divides crc32(doc_id); their labels are not learned from. A null id is not held out."""
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels.where(~held_out(F.col("doc_id")))), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
