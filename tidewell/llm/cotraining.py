"""Quality classifier by co-training two views: text content and page metadata.

Each head (good, toxic) has two logistic models: one over what a text says (word presence, punctuation, capitals), one over what
stands beside and around it (source, language and whether the text is in it, declared and real size, shape of its lines). In
every round each view labels the documents without a label that it is surest of - the best ranks of either class, where
its held-out precision there is high enough - for the other view. In the end the views are calibrated on held-out
scores and combined by a logistic model, and every document is scored.

Labelled documents may be sampled (``Settings.max_labelled``, those with the smallest hashes of their ids). Unlabelled ones are
not: all are featurised once into a compact table, and each Newton step adds their gradients and curvatures up in Spark,
so the driver holds sums only. Fewer than ``Settings.least`` labels of either kind: that head gives the prior and rejects nothing.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .decontamination import words_of
from .quality_rules import STOP_WORDS


@dataclass(frozen=True)
class Settings:
    """max_labelled: labelled documents fitted on. max_words, screen_z: words of the content view at most, and how many standard
    errors their frequency must differ between the classes. rounds, steps: co-training rounds and passes over the unlabelled in
    each. ranks: shares of a class, by rank, that a view may label, the largest first; precise: the held-out precision it must have
    there, as a share of the way from the class's frequency to 1. teachers: the views that hand labels on."""

    max_labelled: int = 12_000
    max_words: int = 150
    screen_z: float = 4.5
    least: int = 15
    rounds: int = 2
    steps: int = 2
    ranks: tuple[float, ...] = (0.4, 0.2, 0.1, 0.05)
    precise: float = 0.9
    teachers: tuple[int, ...] = (0, 1)


CUT, FOLDS, RIDGE = 0.5, 5, 0.3
_STOP = frozenset(w.encode() for w in STOP_WORDS)
#: Frequent words by which a text's language is told.
LANGUAGES = {
    "en": frozenset(b"the of and to in is that for was with".split()), "fr": frozenset("le les des et une du que dans pour est".encode().split()),
    "de": frozenset("der die das und ist nicht ein eine mit den".encode().split()), "es": frozenset("el los las y en una por con para del".encode().split()),
}
_NO_CAPITALS = bytes(range(65, 91))
SOURCES, LANGS, N_SHAPE, N_DENSE = 64, 16, 7, 11
N_META = SOURCES + LANGS + N_DENSE


def content(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of the distinct normalised words, and how it is written, as numbers between 0 and about 1."""
    raw = text.split()
    n = max(1, len(raw))
    letters = max(1, len(text) - text.count(b" "))
    words = set(words_of(text))
    shape = [
        min(1.0, sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">")) / n),
        min(1.0, text.count(b"|") / n), min(1.0, text.count(b"!") / n), (len(text) - len(text.translate(None, _NO_CAPITALS))) / letters,
        sum(map(operator.eq, raw, raw[1:])) / n, min(1.0, sum(map(_STOP.__contains__, raw)) / n), len(words) / n if len(words) < n else 1.0,
    ]
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.asarray(shape, np.float32)


def metadata(text: bytes, source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    """Source and language (hashed), language mismatch, sizes, and the shape of the lines."""
    out = np.zeros(N_META, np.float32)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    raw, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, n_lines = max(1, len(raw)), max(1, len(lines))
    heard = {k: sum(map(v.__contains__, raw)) for k, v in LANGUAGES.items()}
    best = max(heard, key=heard.get)
    real = len(text.decode(errors="replace")) if size is not None else 0
    out[SOURCES + LANGS :] = (
        size is not None, np.log1p(max(0, size or 0)) / 16, np.log1p(len(text)) / 16, size is not None and size != real, np.log1p(len(lines)) / 8, 1 - len(set(lines)) / n_lines,
        min(1.0, len(text) / n_lines / 1000), sum(len(x) < 20 for x in lines) / n_lines, min(1.0, len(text) / n / 20), len(raw) < 20, lang in LANGUAGES and lang != best and heard[best] > 0,
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the likelihood at w (the last weight is the intercept)."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    p = sigmoid(x @ w.astype(np.float32))
    return (x.T @ (y - p).astype(np.float32)).astype(np.float64), ((x * (p * (1 - p) + 1e-6).astype(np.float32)[:, None]).T @ x).astype(np.float64)


#: What pseudo-labelled documents add, as a quadratic around ``at``.
Pull = tuple[np.ndarray, np.ndarray, np.ndarray]  # gradient, curvature, at


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 10, start: np.ndarray | None = None, pull: Pull | None = None) -> np.ndarray:
    """Logistic weights, the last the intercept, by Newton steps."""
    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        grad, hess = sums(x, y, w)
        if pull:
            grad, hess = grad + pull[0] - pull[1] @ (w - pull[2]), hess + pull[1]
        step = np.linalg.solve(hess + np.diag(penalty), grad - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-3:
            break
    return w


def calibrated(z: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip(scale[0] * z + scale[1], -30, 30)


@dataclass
class Head:
    """One trained head. prior: the share of ones, all there is where labels are too few. sure: per view, the calibrated scores below
    and above which it labels documents (None: it does not). supplied: how many zeros and ones each view has labelled, by round."""

    prior: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    views: list[np.ndarray] = field(default_factory=list)
    scales: list[np.ndarray] = field(default_factory=list)
    sure: list[tuple[float | None, float | None]] = field(default_factory=list)
    supplied: list[list[tuple[int, int]]] = field(default_factory=list)
    joint: np.ndarray | None = None

    def bits(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), bool)
        if len(self.words) and words:
            flat = np.concatenate(words)
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            hit = self.words[at] == flat
            out[np.repeat(np.arange(len(words)), [len(w) for w in words])[hit], at[hit]] = True
        return out

    def rows(self, bits: np.ndarray, shape: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([bits.astype(np.float32), shape], axis=1), meta]

    def heard(self, x: list[np.ndarray]) -> list[np.ndarray]:
        return [calibrated(logit(x[v], self.views[v]), self.scales[v]) for v in (0, 1)]

    def score(self, words: list[np.ndarray], shape: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability by content, by metadata, and combined."""
        if self.joint is None:
            flat = np.full(len(words), self.prior)
            return flat, flat, flat
        z = self.heard(self.rows(self.bits(words), shape, meta))
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(logit(np.stack(z, axis=1), self.joint))


def screen(words: list[np.ndarray], y: np.ndarray, settings: Settings) -> np.ndarray:
    """The words whose document frequency differs most between the classes: at least screen_z standard errors."""
    every, counts = np.unique(np.concatenate(words), return_counts=True)
    every, counts = every[counts >= 4], counts[counts >= 4]
    ones = np.unique(np.concatenate([w for w, label in zip(words, y) if label] or [np.zeros(0, np.uint32)]), return_counts=True)
    n, n1 = len(y), int(y.sum())
    inside = np.zeros(len(every))
    if len(ones[0]):
        at = np.minimum(np.searchsorted(ones[0], every), len(ones[0]) - 1)
        inside = np.where(ones[0][at] == every, ones[1][at], 0)
    p = counts / n
    z = (inside / max(1, n1) - (counts - inside) / max(1, n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(1, n1) + 1 / max(1, n - n1)))
    best = np.argsort(-np.abs(z), kind="stable")[: settings.max_words]
    return np.sort(every[best[np.abs(z[best]) >= settings.screen_z]])


class Learner:
    """A head in training: its labelled documents, and the held-out scores of both views."""

    def __init__(self, words: list[np.ndarray], shape: np.ndarray, meta: np.ndarray, y: np.ndarray, settings: Settings):
        known = np.flatnonzero(y >= 0)
        self.settings, self.y = settings, y[known].astype(np.float64)
        self.head = Head(float(self.y.mean()) if len(known) else 0.0)
        self.able = min((self.y == 1).sum(), (self.y == 0).sum()) >= settings.least
        if self.able:
            words = [words[i] for i in known]
            self.head.words = screen(words, self.y == 1, settings)
            self.x = self.head.rows(self.head.bits(words), shape[known], meta[known])
            self.pulls: list[Pull | None] = [None, None]
            self.settle([fit(x, self.y) for x in self.x])

    def settle(self, views: list[np.ndarray]) -> None:
        """Takes new weights: held-out scores by folds, the calibration on them, and the ranks that each view is sure of."""
        head, y = self.head, self.y
        fold, self.held = np.arange(len(y)) % FOLDS, []
        for x, w, pull in zip(self.x, views, self.pulls):
            z = np.zeros(len(y))
            for k in range(FOLDS):
                z[fold == k] = logit(x[fold == k], fit(x[fold != k], y[fold != k], steps=4, start=w, pull=pull))
            self.held.append(z)
        head.views = views
        head.scales = [fit(z[:, None].astype(np.float32), y, ridge=1e-3) for z in self.held]
        self.held = [calibrated(z, c) for z, c in zip(self.held, head.scales)]
        # independent views add up their evidence; what is fitted stays near that, for a view that says little can take any weight
        centre = np.asarray([1.0, 1.0, -np.log(head.prior / (1 - head.prior))])
        head.joint = fit(np.stack(self.held, axis=1).astype(np.float32), y, ridge=0.0, start=centre, pull=(np.zeros(3), 10 * np.eye(3), centre))
        head.sure = [tuple(self._cut(z, label) for label in (0, 1)) for z in self.held]

    def _cut(self, z: np.ndarray, label: int) -> float | None:
        """The score from which on a view labels: of its best ranks of a class the largest share that is precise enough."""
        order, share = np.argsort(z, kind="stable"), (self.y == label).mean()
        for rank in self.settings.ranks:
            top = (order[::-1] if label else order)[: int(rank * share * len(z))]
            if len(top) >= 5 and (self.y[top] == label).mean() >= share + self.settings.precise * (1 - share):
                return float(z[top[-1]])
        return None

    def learn(self, found: dict[int, dict[int, tuple[int, np.ndarray, np.ndarray]]]) -> None:
        """One step: found[view][label] are the number, gradient and curvature of what the other view has labelled so. Together they weigh
        no more than the labelled documents of that class."""
        views = []
        for v in (0, 1):
            grad, hess = np.zeros(len(self.head.views[v])), np.zeros((len(self.head.views[v]),) * 2)
            for label, (n, g, h) in found[v].items():
                weight = min(1.0, (self.y == label).sum() / max(1, n))
                grad, hess = grad + weight * g, hess + weight * h
            self.pulls[v] = (grad, hess, self.head.views[v])
            views.append(fit(self.x[v], self.y, start=self.head.views[v], pull=self.pulls[v]))
        self.head.views = views


COLUMNS = ("text", "source", "lang", "n_chars")


def _sources(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars")]


def _featured(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(words, shape, metadata) of a bounded number of rows at a time."""
    texts, beside = shared.text_bytes(batch.column("text")), list(zip(*(batch.column(c).to_pylist() for c in COLUMNS[1:])))
    for lo in range(0, len(texts), step):
        found = [content(t) for t in texts[lo : lo + step]]
        yield [w for w, _ in found], np.stack([s for _, s in found]), np.stack([metadata(t, *r) for t, r in zip(texts[lo : lo + step], beside[lo : lo + step])])


@shared.tidy
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, shape, meta = [], [], []
        for w, s, m in _featured(batch):
            words, shape, meta = words + [x.tobytes() for x in w], shape + [x.tobytes() for x in s], meta + [x.tobytes() for x in m]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), *(pa.array(c, pa.binary()) for c in (words, shape, meta))], ["quality", "toxic", "words", "shape", "meta"])


def _compact(shipped):
    """doc_id and x: the shape, the metadata, and each head's word bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shipped.value
        for batch in batches:
            rows = []
            for words, shape, meta in _featured(batch):
                bits = np.concatenate([np.packbits(h.bits(words), axis=1) for h in heads], axis=1)
                rows += [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(shape, meta, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])

    return shared.tidy(run)


def _gradients(shipped):
    """One row a task: for each head, view and label, the number, gradient and curvature of what the other view labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught, now, teachers = shipped.value  # heads as they label, weights as they stand
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            shape, meta = (np.ascontiguousarray(raw[:, a:b]).view(np.float32) for a, b in ((0, 4 * N_SHAPE), (4 * N_SHAPE, 4 * (N_SHAPE + N_META))))
            at, parts = 4 * (N_SHAPE + N_META), []
            for head, views in zip(taught, now):
                width = -(-len(head.words) // 8)
                x = head.rows(np.unpackbits(raw[:, at : at + width], axis=1, count=len(head.words)).astype(bool) if width else np.zeros((len(raw), 0), bool), shape, meta)
                at += width
                z = head.heard(x)
                for v in (0, 1):
                    low, high = head.sure[1 - v] if 1 - v in teachers else (None, None)
                    for label, chosen in ((0, z[1 - v] <= low if low is not None else None), (1, z[1 - v] >= high if high is not None else None)):
                        d = len(views[v])
                        if chosen is None or not chosen.any():
                            parts += [np.zeros(1), np.zeros(d), np.zeros(d * d)]
                        else:
                            g, h = sums(x[v][chosen], np.full(int(chosen.sum()), float(label)), views[v])
                            parts += [np.asarray([float(chosen.sum())]), g, h.ravel()]
            part = np.concatenate(parts)
            total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if total is not None else [], pa.binary())], ["sums"])

    return shared.tidy(run)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            part = np.frombuffer(x, np.float64)
            total = part if total is None else total + part
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if total is not None else [], pa.binary())], ["sums"])


#: Tasks that add up what the tasks of a pass give; the driver gets a row from each.
ADDERS = 32


def _exchange(pool: DataFrame, learners: list[Learner], settings: Settings) -> None:
    """One round: the views label the pool, and both learn from what the other has labelled, in ``steps`` passes over the pool."""
    spark = pool.sparkSession
    taught = [Head(h.prior, h.words, list(h.views), list(h.scales), list(h.sure)) for h in (c.head for c in learners)]
    for _ in range(settings.steps):
        shipped = spark.sparkContext.broadcast((taught, [c.head.views for c in learners], settings.teachers))
        rows = pool.mapInArrow(_gradients(shipped), "sums binary").repartition(ADDERS).mapInArrow(_added, "sums binary").collect()
        if not rows:
            return
        total, at = np.sum([np.frombuffer(r[0], np.float64) for r in rows], axis=0), 0
        for c in learners:
            found = {}
            for v in (0, 1):
                d, found[v] = len(c.head.views[v]), {}
                for label in (0, 1):
                    found[v][label] = (int(total[at]), total[at + 1 : at + 1 + d], total[at + 1 + d : at + 1 + d + d * d].reshape(d, d))
                    at += 1 + d + d * d
            c.learn(found)
            c.last = [tuple(found[1 - v][label][0] for label in (0, 1)) for v in (0, 1)]
    for c in learners:
        c.head.supplied.append(c.last)
        c.settle(c.head.views)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict[str, Head]:  # noqa: B008
    """The two heads: good (quality is 1) and toxic. A label of a document that is not in docs counts for nothing; of rows with
    one id, that with the smallest hash of its text is the labelled one."""
    spark = docs.sparkSession
    clean = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")).where("quality is not null or toxic is not null")
    ids = docs.select("doc_id").distinct()
    chosen = clean.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled)
    keys = shared.stored(chosen, "fit-keys")  # at most max_labelled rows
    picked = docs.select("doc_id", F.struct(*_sources(docs)).alias("r")).join(F.broadcast(keys), "doc_id")
    one = picked.groupBy("doc_id").agg(F.min_by("r", F.xxhash64("r.text")).alias("r"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).select("quality", "toxic", "r.*")
    rows = one.mapInArrow(_sample, "quality int, toxic int, words binary, shape binary, meta binary").toArrow()
    words = [np.frombuffer(b, np.uint32) for b in rows["words"].to_pylist()]
    shape = np.frombuffer(b"".join(rows["shape"].to_pylist()), np.float32).reshape(-1, N_SHAPE)
    meta = np.frombuffer(b"".join(rows["meta"].to_pylist()), np.float32).reshape(-1, N_META)
    label = lambda c: np.asarray([-1 if v is None else int(v > 0) for v in rows[c].to_pylist()], np.int64)
    learners = {"good": Learner(words, shape, meta, label("quality"), settings), "toxic": Learner(words, shape, meta, label("toxic"), settings)}
    able = [c for c in learners.values() if c.able]
    if able and settings.rounds:
        shipped = spark.sparkContext.broadcast([c.head for c in able])
        known = labels.select("doc_id").where("doc_id is not null").distinct()
        features = docs.select("doc_id", *_sources(docs))
        listed = features.mapInArrow(_compact(shipped), f"doc_id {features.schema['doc_id'].dataType.simpleString()}, x binary")
        pool = shared.stored(listed.join(known, "doc_id", "left_anti").select("x"), "pool")
        for _ in range(settings.rounds):
            _exchange(pool, able, settings)
    return {k: c.head for k, c in learners.items()}


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shipped.value
        for batch in batches:
            scores = {k: [np.zeros((3, 0))] for k in heads}
            for found in _featured(batch):
                for k, head in heads.items():
                    scores[k].append(np.stack(head.score(*found)))
            out = [np.concatenate(scores[k], axis=1) for k in ("good", "toxic")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(o[j]) for o in out for j in range(3))], ["row", "good_content", "good_metadata", "p_good", "toxic_content", "toxic_metadata", "p_toxic"])

    return shared.tidy(run)


def score(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """``row`` (all columns of docs), both views' probabilities, p_good, p_toxic and kept.

    Null columns count as empty values, a null or empty text as one without words. Rows given twice are scored alike, and an empty
    table gives an empty one. A text of any length is read whole. Columns with clashing names stay in ``row``.
    """
    source = docs.select(F.struct(*docs.columns).alias("row"), *_sources(docs))
    schema = f"row {source.schema['row'].dataType.simpleString()}, good_content double, good_metadata double, p_good double, toxic_content double, toxic_metadata double, p_toxic double"
    found = source.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(heads)), schema)
    # a head without enough labels gives its prior and rejects nothing
    bad = [F.col("p_good") < CUT] * (heads["good"].joint is not None) + [F.col("p_toxic") >= CUT] * (heads["toxic"].joint is not None)
    rejected = F.lit(False)
    for b in bad:
        rejected = rejected | b
    return found.withColumn("kept", ~rejected)


def filter_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The documents that the classifier does not reject."""
    return score(docs, train(docs, labels, settings)).where("kept").select("row.*")


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, shared.table(spark, sf_dir, "labels")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "good_content", "good_metadata", "p_good", "toxic_content", "toxic_metadata", "p_toxic", "kept")
