"""Merkle manifest against a plain tree: sources of one and of several blocks, odd rows, proofs that fold, differing blocks."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows, later):
    """[(doc_id, leaf, subroot, root, proof, folded, verified)] by plain lists."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    by = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sorted(by, key=lambda s: (s is not None, (s or "").encode()))}
    trees = {s: levels_of([leaf(r, r[1]) for r in members]) for s, members in by.items()}
    top = levels_of([t[-1][0] for t in trees.values()])
    out = []
    for k, (s, members) in enumerate(by.items()):
        for i, r in enumerate(members):
            h, beside = leaf(r, later(r)), []
            for levels, at in ((trees[s], i), (top, k)):
                for m in levels[:-1]:
                    run = m[at // 3 * 3 :][:3]
                    beside += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = h
                    h, at = digest(*run), at // 3
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], digest(*beside), h, h == top[-1][0]))
    return out


def without_lines(r):
    return r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]


def changed():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def same(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("key", "pos", "digest", "block", "leaf", "size", "at", "i")})
    got = manifest.Manifest(df, changed()).verify().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, without_lines)))


def test_sources_of_several_blocks(spark):
    rows = [(i, f"text {i}\n x" if i % 3 else None, None if i % 7 == 0 else "en", None if i % 50 == 0 else ("hot" if i % 3 else f"s{i % 31}"), i % 9 if i % 5 else None) for i in range(2600)]
    same(spark, rows)
    made = manifest.Manifest(spark.createDataFrame(rows, DOCS))
    assert {r.source: r.n_docs for r in made.subroots.collect()}["hot"] > 2 * manifest.BLOCK
    other = manifest.Manifest(spark.createDataFrame([r if r[0] != 1001 else (*r[:2], "de", *r[3:]) for r in rows], DOCS))
    place = [r[0] for r in rows if r[3] == rows[1001][3]].index(1001)
    assert [tuple(r) for r in made.differing(other).collect()] == [(rows[1001][3], place // manifest.BLOCK, "both")]


def test_odd_rows(spark):
    same(spark, [(1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (1, "", "en", "s", 0), (None, None, None, None, None), (None, "x", "é", "", 1), (-4, "long\n" * 40_000, "日本", "é", 10**12)])
    same(spark, [(7, "alone\n", "en", "s", 6)])
    empty = manifest.Manifest(spark.createDataFrame([], DOCS))
    assert empty.root == "" and empty.verify().count() == 0 and empty.subroots.count() == 0


def test_blocks_of_every_size():
    for n in (1, 2, 3, 4, 8, 9, 10, 28, 100, 728, 729):
        leaves = [digest(str(i)) for i in range(n)]
        matrix = np.frombuffer("".join(leaves).encode(), np.uint8).reshape(-1, 64)
        assert [[r.tobytes().decode() for r in m] for m in manifest.raised(matrix, True)] == levels_of(leaves)
        over = "12" + "a" * 64  # second of a run of two
        proof, folded = manifest.proofs("".join(leaves), "".join(leaves), True, over)
        assert set(folded) == {digest("a" * 64, levels_of(leaves)[-1][0])} and len(proof) == n
        assert len(manifest.raised(matrix, False)) == manifest.HEIGHT + 1
