"""Benchmark decontamination: windows of normalised benchmark words, broadcast as a hash set, scanned over all texts.

The set is cut into blocks of at most ``MAX_BLOCK_BYTES`` of benchmark text; each block is one broadcast and one pass
of the same scan, so a benchmark of any size works with bounded memory. A hash hit is verified word by word.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WINDOW = 13
#: A document is contaminated if at least 1 / MIN_SHARE of its words are hit.
MIN_SHARE = 20
MAX_BLOCK_BYTES = 16 << 20
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def _hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(starts), n, np.uint64)
    for k in range(n):
        h = (h ^ ids[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """The windows of some benchmark items: word ids, and for each window length the sorted hashes and where they stand."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items = [i for i, _ in items]
        split = [words_of(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(itertools.chain(*split)), 1)}
        self.ids = np.fromiter((self.vocabulary[w] for ws in split for w in ws), np.int64, sum(map(len, split)))
        sizes = np.asarray([len(ws) for ws in split], np.int64)
        begin = np.cumsum(sizes) - sizes
        self.by_length = {}
        for n in sorted({min(window, s) for s in sizes.tolist() if s}):
            rows = np.flatnonzero(sizes >= window) if n == window else np.flatnonzero(sizes == n)
            if n == window:
                counts = sizes[rows] - window + 1
            else:
                counts = np.ones(len(rows), np.int64)
            starts = np.repeat(begin[rows], counts) + shared.ragged(counts)
            owner = np.repeat(rows, counts)
            h = _hash(self.ids, starts, n)
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (h[order], starts[order], owner[order])

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, length, item index) of every window that occurs in ids; 0 is a word no item has."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (hashes, places, owner) in self.by_length.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            h = _hash(ids, starts, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                s = int(starts[k])
                for j in range(int(lo[k]), int(hi[k])):
                    if np.array_equal(self.ids[places[j] : places[j] + n], ids[s : s + n]):
                        yield s, n, int(owner[j])


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shipped.value
        get, none = windows.vocabulary.get, itertools.repeat(0)
        for batch in batches:
            row, text, old_items, old_spans = (batch.column(k) for k in range(4))
            items, spans, counts = old_items.to_pylist(), old_spans.to_pylist(), []
            texts = shared.text_bytes(text)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and size < 8 << 20:
                    size += len(texts[hi])
                    hi += 1
                split = [words_of(t) for t in texts[lo:hi]]
                sizes = np.asarray([len(w) for w in split], np.int64)
                counts += sizes.tolist()
                ids = np.zeros(int(sizes.sum()) + len(split), np.int64)  # a 0 after each document
                begin = np.cumsum(sizes + 1) - sizes - 1
                for b, ws in zip(begin.tolist(), split):
                    ids[b : b + len(ws)] = np.fromiter(map(get, ws, none), np.int64, len(ws))
                found: dict[int, tuple[set, list]] = {}
                for s, n, item in windows.hits(ids):
                    d = int(np.searchsorted(begin, s, "right")) - 1
                    got = found.setdefault(d, (set(), []))
                    got[0].add(windows.items[item])
                    got[1].append([s - int(begin[d]), s - int(begin[d]) + n])
                for d, (ids_hit, where) in found.items():
                    items[lo + d] = sorted({*items[lo + d], *ids_hit})
                    spans[lo + d] = _merged(spans[lo + d] + where)
                lo = hi
            yield pa.RecordBatch.from_arrays([row, text, pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(counts, pa.int64())], ["row", "text", "items", "spans", "n_words"])

    return shared.tidy(run)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (all columns of docs), ``text``, ``n_words``, ``items`` (ids, sorted as strings) and ``spans`` (word ranges hit).

    A null or empty text has no words. An item of fewer words than ``window`` is one window; one without words is none. A
    null item_id counts as the item ''. Items with one id count once. Rows given twice are scanned twice, alike; an empty table of documents gives
    no rows, an empty benchmark hits nothing. Texts of any length are scanned whole, 8 MB of them at a time. Columns with clashing names stay in ``row``.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / MAX_BLOCK_BYTES))  # twice: blocks are dealt by hash
    out = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), F.array().cast("array<string>").alias("items"), F.array().cast("array<array<bigint>>").alias("spans"))
    schema = T.StructType([out.schema["row"], T.StructField("text", T.StringType()), out.schema["items"], out.schema["spans"], T.StructField("n_words", T.LongType())])
    for k in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(Windows([(r[0], r[1].encode()) for r in block], window))), schema)
    return out


def measured(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """``scan`` with n_hit and the verdict: at least one word in ``min_share`` is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return scan(docs, benchmark, window).withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))


def _cut(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    at, out, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """docs without the contaminated documents, or (remove="spans") with the hit spans cut out of every text."""
    found = measured(docs, benchmark, window, min_share)
    if remove == "documents":
        return found.where(~F.col("contaminated")).select("row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    cleaned = found.select("row", "text", "spans").mapInArrow(cut, T.StructType([found.schema["row"], T.StructField("text", T.StringType())]))
    return cleaned.select(*(F.col("text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
