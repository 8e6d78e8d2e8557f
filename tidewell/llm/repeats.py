"""Repeated byte strings by distributed prefix doubling over sampled suffixes.

A suffix array of every position would sort eight times the input in each round. Instead each 400-byte window is named by
an *anchor*: the leftmost smallest 100-byte gram inside it. Equal windows have equal anchors at equal offsets, so ranking
the anchors' surroundings, at growing lengths, ranks all windows:

* a row is an anchor with a run of offsets (the windows it names, in chunks of offsets);
* its *core* is what all windows of the chunk have in common, 400 bytes less the chunk's width; its *span* is what the row's
  windows cover together. Rows are grouped by the core's rank (a 64-bit hash): a core that stands once is unique and goes;
  rows of equal span are repeated in all their windows; what is left goes into the next round with chunks a tenth as wide.
* cores grow 250, 385, 400 bytes; at 400 the core is the window itself and its count decides.

Groups are counted by partial aggregation before any shuffle, so a passage that a third of all documents share costs one row
a task. Texts are known by a 64-bit hash of their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH, GRAM = 400, 100
WIDTHS = (151, 16, 1)
_BLOCK = 1 << 16
_ODD = 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        n = _BLOCK + 2 * LENGTH
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers, along the last axis, after a leading zero."""
    up, _ = _powers()
    sums = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(_BYTES[data] * up[: data.shape[-1]], axis=-1, out=sums[..., 1:])
    return sums


def anchors(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """For each block of window starts: anchors (places in the block), first and last offset, block start, prefix sums."""
    w = length - gram + 1
    _, down = _powers()
    for start in range(0, len(data) - length + 1, _BLOCK):
        part = data[start : start + _BLOCK + length - 1]
        sums = _prefix(part)
        grams = shared.mix64((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        keys = ((grams >> np.uint64(20)) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
        rows = -(-len(keys) // w)
        grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(keys)] = keys
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        chosen = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        p = chosen[first]
        yield p, p - last, p - first, start, sums


def _chunks(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Split offset runs at multiples of width: (row, anchor, chunk's first offset, lo, hi)."""
    counts = hi // width - lo // width + 1
    row = np.repeat(np.arange(len(p)), counts)
    base = (lo[row] // width + shared.ragged(counts)) * width
    return row, p[row], base, np.maximum(lo[row], base), np.minimum(hi[row], base + width - 1)


def _ranks(hashed, p: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of core and span; hashed(a, b) hashes the bytes from a to b. A core's rank tells chunks apart by their offset."""
    top = np.minimum(base + width - 1, most)
    core = shared.mix64(hashed(p - base, p + length - top) + (base.astype(np.uint64) << np.uint64(40)) + np.uint64(width))
    span = shared.mix64(hashed(p - hi, p + length - lo) ^ shared.mix64(lo.astype(np.uint64) * np.uint64(1009) + hi.astype(np.uint64) + np.uint64(3)))
    return core.view(np.int64), span.view(np.int64)


ROWS = "core bigint, span bigint, dk bigint, p bigint, lo int, hi int"


def _batch(columns: list) -> pa.RecordBatch:
    core, span, dk, p, lo, hi = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*columns)) if columns else (np.zeros(0, np.int64),) * 6
    return pa.RecordBatch.from_arrays([pa.array(core), pa.array(span), pa.array(dk.astype(np.int64)), pa.array(p), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["core", "span", "dk", "p", "lo", "hi"])


def _first_round(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, down = _powers()
        width, most = WIDTHS[0] * length // LENGTH, length - gram
        for batch in batches:
            out, held = [], 0
            for dk, text in zip(batch.column(0).to_pylist(), shared.text_bytes(batch.column(1))):
                for p, lo, hi, start, sums in anchors(np.frombuffer(text, np.uint8), length, gram):
                    _, q, base, qlo, qhi = _chunks(p, lo, hi, width)
                    core, span = _ranks(lambda a, b: (sums[b] - sums[a]) * down[a], q, base, qlo, qhi, width, length, most)  # noqa: B023
                    out.append((core, span, np.full(len(q), dk), q + start, qlo, qhi))
                    held += len(q)
                    if held > 100_000:
                        yield _batch(out)
                        out, held = [], 0
            yield _batch(out)

    return shared.tidy(run)


def _next_round(width: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, down = _powers()
        most = length - gram
        for batch in batches:
            for dk, text, rows in zip(batch.column("dk").to_pylist(), shared.text_bytes(batch.column("text")), batch.column("rows").to_pylist()):
                data = np.frombuffer(text, np.uint8)
                p, lo, hi = (np.asarray([r[k] for r in rows], np.int64) for k in ("p", "lo", "hi"))
                row, q, base, qlo, qhi = _chunks(p, lo, hi, width)
                for k in range(0, len(q), 4096):
                    cut = slice(k, k + 4096)
                    held, local = np.unique(row[cut], return_inverse=True)
                    places = np.clip(p[held][:, None] + np.arange(-most, length), 0, len(data) - 1)
                    sums, at = _prefix(data[places]), most - q[cut]
                    core, span = _ranks(lambda a, b: (sums[local, b + at] - sums[local, a + at]) * down[a + at], q[cut], base[cut], qlo[cut], qhi[cut], width, length, most)  # noqa: B023
                    yield _batch([(core, span, np.full(len(core), dk), q[cut], qlo[cut], qhi[cut])])

    return shared.tidy(run)


def _settle(rows: DataFrame, name: str, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(repeated, open): rows all of whose windows are repeated; one row of each span whose core has another span too (none in the last round, where cores are windows)."""
    rows = shared.stored(rows, name)
    dealt = lambda left, right, key: shared.join_spread(left, right.select(*key, "n"), key, "n", F.monotonically_increasing_id())
    # what is counted is written before it is joined: the counts say which keys are dealt over tasks
    cores = shared.stored(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-cores")
    met = shared.stored(dealt(rows, cores, ["core"]), f"{name}-met")
    spans = shared.stored(met.groupBy("core", "span", "lo", "hi").agg(F.count("*").alias("n"), F.first("dk").alias("dk"), F.first("p").alias("p")), f"{name}-spans")
    repeated = dealt(met, spans.where("n > 1"), ["core", "span", "lo", "hi"]).select("dk", "p", "lo", "hi").distinct()
    if last:
        return repeated, None
    mixed = shared.stored(spans.groupBy("core").agg(F.min("span").alias("a"), F.max("span").alias("b"), F.count("*").alias("n")).where("a < b"), f"{name}-mixed")
    return repeated, dealt(spans.drop("n"), mixed, ["core"]).select("dk", "p", "lo", "hi")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, shas, kept = [], [], []
            for text, rows in zip(shared.text_bytes(batch.column("text")), batch.column("rows").to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted((r["p"] - r["hi"], r["p"] - r["lo"] + length) for r in rows):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                rest = b"".join(text[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(text)]))
                spans.append(merged)
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("copies"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["dk", "copies", "spans", "kept_sha256", "kept"])

    return shared.tidy(run)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(dk, copies, spans, kept_sha256, kept) of every distinct text that has a repeated string of ``length`` bytes: how many rows have it,
    the removed byte ranges, and the bytes that stay with their SHA-256. dk is xxhash64 of the text (null: '').

    A row given twice repeats itself, so both lose every window; texts shorter than ``length`` lose nothing. Null and empty texts have no window; ids, null ones too, are
    not read, nor is any other column. An empty table gives an empty one. Long texts are read whole.
    """
    gram = length // 4
    source = docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("dk"), F.col("text").cast("string"))
    long = source.where(F.octet_length("text") >= length)
    done, rest = _settle(long.mapInArrow(_first_round(length, gram), ROWS), "anchors")
    settled = [shared.stored(done, "repeated-0")]
    rest = shared.stored(rest, "open-0")
    hold = settled[0].select("dk").union(rest.select("dk")).distinct()
    # copies become one row in each task before they are shuffled
    copies = long.groupBy("dk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = shared.stored(copies.join(hold, "dk", "left_semi"), "texts")
    listed = lambda rows: texts.join(rows.groupBy("dk").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("rows")), "dk")
    for k, width in enumerate(WIDTHS[1:], 1):
        done, rest = _settle(listed(rest).mapInArrow(_next_round(width, length, gram), ROWS), f"anchors-{k}", last=k == len(WIDTHS) - 1)
        settled.append(shared.stored(done, f"repeated-{k}"))
        rest = rest and shared.stored(rest, f"open-{k}")
    every = settled[0]
    for more in settled[1:]:
        every = every.union(more)
    return listed(every).mapInArrow(_cut(length), "dk bigint, copies bigint, spans array<array<bigint>>, kept_sha256 string, kept binary")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", F.xxhash64(text).alias("dk"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    with shared.Scope(spark, "repeats") as scope:
        found = repeats(docs).select("dk", "copies", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
        found = scope.settled(found, "found")
    # texts without a repeat stay as they are; short ones cannot have one and get keys of their own, so that copies do not meet
    keyed = light.withColumn("dk", F.when(F.col("n_bytes") >= LENGTH, F.col("dk")))
    rows = shared.join_spread(keyed.withColumn("dk", F.coalesce("dk", -F.monotonically_increasing_id() - 1)), found, ["dk"], "copies", F.monotonically_increasing_id(), "left")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - {LENGTH - 1}))) AS i FROM d)),
r AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true) AS new FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL AND tail IS NULL THEN x ELSE coalesce(kept, '') || substr(x, 2 * tail + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
