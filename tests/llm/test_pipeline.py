"""The pipeline on odd tables: nulls, empty tables, repeated ids, clashing columns; what it writes, in which order, and what it leaves."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing, shared, token_store

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BENCH = " ".join(f"question{k}" for k in range(20))


def words(seed: int, n: int = 60) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def tables(spark, path, docs, labels=(), bench=((1, BENCH),)):
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_odd_rows(spark, tmp_path):
    rows = [(i, words(i), "en", f"s{i % 3}", 9) for i in range(12)]
    rows += [(20, words(3), "en", "s0", 9), (21, words(4) + " more", None, None, None), (22, words(50, 30) + " " + BENCH, "en", "s1", 1), (23, None, "en", "s1", 0), (24, "", "en", None, 0), (25, "", "en", "s2", 0), (None, "no id", "en", "s2", 5), (30, words(60), "en", "s0", 1), (30, words(60), "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("row", "slot", "kept", "spans", "items", "tk", "h", "node", "file")})
    sf = tables(spark, tmp_path, df)
    got = corpus_pipeline.run(spark, sf).collect()
    kept = [r for r in rows if r[0] not in (20, 21, 22)]  # the copy, the near copy, the contaminated one
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.default_vocabulary())
    ids = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]
    crc = lambda t: zlib.crc32(np.asarray(ids(t), "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.sound) for r in got) == Counter((r[0], len(ids(r[1])), crc(r[1]), True) for r in kept)
    rest = df.where("doc_id is null or doc_id not in (20, 21, 22)")
    order = [r[0] for r in mixing.mix(rest).orderBy("slot", "place").select("row.doc_id").collect()]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == order
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == [0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1]]


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, spark.createDataFrame([], DOCS), (), ())
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stage_tables_are_removed(spark, tmp_path):
    sf = tables(spark, tmp_path, spark.createDataFrame([(i, words(i), "en", "s", 9) for i in range(6)], DOCS))
    since = shared.mark()
    assert corpus_pipeline.run(spark, sf).count() == 6
    left = [p.rsplit("/", 1)[1] for p in shared._PLACES[since:]]
    assert [p.split("-")[0] for p in left] == ["corpus"]
    shared.clean(spark, since)
    assert shared.mark() == since
