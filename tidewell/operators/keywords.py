"""Keywords in texts, and postings against resumes: an automaton built once reads each text once, however many keywords there are.

Texts go through Arrow batches. Keywords and resumes are broadcast in blocks of at most BLOCK_BYTES; more of them are more passes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import TRACKED, match_label
from ..functions.text import MATCH_STOP, blank

BLOCK_BYTES = 8 << 20
MOST_WORDS, MOST_MISSING = 30, 12
#: What match_text keeps, as a byte table: a-z 0-9 + . # - and white space.
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789+.#-" else 32 for c in range(256))
_YEARS = re.compile(r"\b(?:[3-9]|1\d)\+?\s+years?\b")
_STOP = frozenset(MATCH_STOP)


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    """Finds all of the patterns (numbered) in one pass."""
    found = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        found.add_word(p, k)
    found.make_automaton()
    return found


def blocks_of(df: DataFrame, text: str, most: int = BLOCK_BYTES) -> Iterator[list]:
    """The rows of df in blocks whose texts have about ``most`` bytes at most, one block on the driver at a time."""
    size = df.agg(F.sum(F.octet_length(blank(text)) + 16)).first()[0] or 0
    n = max(1, math.ceil(2 * size / most))  # twice: blocks are dealt by hash
    for k in range(n):
        yield df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k).collect()


def _contained(patterns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(patterns) if patterns else None
        for batch in batches:
            row, text, before = batch.columns
            found = [was + [patterns[k] for k in sorted({k for _, k in find.iter(x)})] if find and x else was for x, was in zip(text.to_pylist(), before.to_pylist())]
            yield pa.RecordBatch.from_arrays([row, text, pa.array(found, pa.list_(pa.string()))], ["row", "text", "found"])

    return run


def contained(texts: DataFrame, text: Column, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """``row`` (all columns of texts) and ``found``: which of the distinct keywords stand anywhere in the text, sorted.

    A match may lie inside a word or overlap another. Null and empty keywords are none; a null text holds none.
    """
    known = keywords.select(F.col(keyword).cast("string").alias("k")).where("k <> ''").distinct()
    out = texts.select(F.struct(*texts.columns).alias("row"), text.cast("string").alias("text"), F.array().cast("array<string>").alias("found"))
    for block in blocks_of(known, "k"):
        out = out.mapInArrow(_contained(sorted(r.k for r in block)), out.schema)
    return out.select("row", F.sort_array("found").alias("found"))


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text in match_text form."""
    return (text or "").lower().encode("ascii", "replace").translate(_KEPT).split()


def meaningful(words: list[bytes], most: int | None = None) -> list[str]:
    """Distinct words of five letters or more that are no stop words, in order; the first ``most``."""
    seen: dict[str, None] = {}
    for w in words:
        if len(w) > 4 and (x := w.decode()) not in _STOP:
            seen[x] = None
            if len(seen) == most:
                break
    return list(seen)


class _Holds(dict):
    """Whether a resume holds a word anywhere; each distinct word is looked for once."""

    def __init__(self, resume: str):
        super().__init__()
        self.resume = resume

    def __missing__(self, word: str) -> bool:
        self[word] = found = word in self.resume
        return found


def _scored(resumes: list[tuple], tracked: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(list(tracked))
        known = [(r, _Holds(text), 10 if _YEARS.search(text) else 0, "remote" in text) for r, text in resumes]
        for batch in batches:
            at, out = [], []
            for i, (title, body, work) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                titled, words = normal_words(title), normal_words(f"{title or ''} {body or ''}")
                always = sorted({k for _, k in find.iter(b" ".join(words).decode())})
                keywords = list(dict.fromkeys([*(tracked[k] for k in always), *meaningful(words, MOST_WORDS)]))
                terms = meaningful(titled)
                for r, holds, years, remote in known:
                    matched, missing = [], []
                    for k in keywords:
                        (matched if holds[k] else missing).append(k)
                    share = len(matched) / len(keywords) * 60 if keywords else 0
                    of_title = sum(holds[t] for t in terms) / len(terms) * 25 if terms else 0
                    at.append(i)
                    out.append((r, min(100, round(share + of_title + years + (5 if remote or (work or "").lower() == "remote" else 2))), matched, missing[:MOST_MISSING]))
                    if len(holds) > 500_000:
                        holds.clear()
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["row", "resume", "score", "matched", "missing"])

    return run


def score_postings(postings: DataFrame, resumes: DataFrame, title: str = "title", body: str = "body", work: Column | None = None, resume_id: str = "resume_id", text: str = "resume", keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns of postings, or those of ``keep``), resume_id, score, matched, missing, label: every posting against every resume.

    60 points by share of the posting's keywords that the resume holds, 25 by share of title words, 10 for stated years of experience, 5 for
    remote else 2; rounded half to even, at most 100. Keywords are the tracked ones, then the first 30 meaningful words. Null texts are empty;
    without resumes there are no rows.
    """
    spark = postings.sparkSession
    rows = postings.select(F.struct(*(keep or postings.columns)).alias("row"), F.col(title).cast("string").alias("t"), F.col(body).cast("string").alias("b"), (F.lit("") if work is None else work).cast("string").alias("w"))
    schema = T.StructType([rows.schema["row"], T.StructField("resume", T.LongType()), T.StructField("score", T.IntegerType()), T.StructField("matched", T.ArrayType(T.StringType())), T.StructField("missing", T.ArrayType(T.StringType()))])
    out = None
    for block in blocks_of(resumes.select(F.col(resume_id).alias("id"), F.col(text).cast("string").alias("text")), "text"):
        read = [(k, b" ".join(normal_words(r.text)).decode()) for k, r in enumerate(block)]
        ids = spark.createDataFrame([(k, r.id) for k, r in enumerate(block)], T.StructType([T.StructField("resume", T.LongType()), T.StructField(resume_id, resumes.schema[resume_id].dataType)]))
        found = rows.mapInArrow(_scored(read, TRACKED), schema).join(F.broadcast(ids), "resume").drop("resume")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("label", match_label(F.col("score"))).select("row", resume_id, "score", "matched", "missing", "label")
