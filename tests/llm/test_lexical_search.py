"""Lexical search against a plain ranking; treaps, bounds of memory, blocks of queries, odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import lexical_search
from tidewell.llm.lexical_search import Best, Forest, Queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by the formula, document by document."""
    split = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df, counts = Counter(), [(d, len(t), Counter(t)) for d, t in split]
    for _, _, c in counts:
        df.update(c.keys())
    out = []
    for item, text in items:
        found = []
        for d, n, c in counts:
            m = 100 - 75 + (75 * n * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def same(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("item_id", "n", "terms", "score", "query", "rank", "at", "size")})
    asked = spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit(1) for c in ("doc_id", "at", "query", "size")})
    got = sorted((tuple(r) for r in lexical_search.search(df, asked, **more).collect()), key=str)
    assert got == plain(docs, items, more.get("k", 10))
    return got


def words(rng, n):
    return " ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(n))


def test_random_texts_in_many_forests_and_blocks(spark):
    rng = random.Random(5)
    docs = [(i * 7 % 1009, words(rng, rng.randrange(0, 60))) for i in range(700)]
    items = [(f"q{i}", words(rng, rng.randrange(1, 20)).upper()) for i in range(40)]
    same(spark, docs, items)
    same(spark, docs, items, k=3, postings=500, query_bytes=1000)


def test_ties_copies_and_odd_rows(spark):
    docs = [(9, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (None, None), (5, ""), (6, " .,;\n"), (7, "Été été ÉTÉ alpha"), (8, "word " * 50_000 + "alpha"), *((100 + i, f"gamma {i}") for i in range(30))]
    items = [("a", "ALPHA, alpha-beta"), ("a", "gamma"), (None, "été"), ("none", None), ("empty", ""), ("absent", "zzz"), ("digits", "7 word")]
    got = same(spark, docs, items)
    assert {r[2] for r in got if r[0] == "a" and r[1] == 1} == {None, 100}  # both queries of that id
    for left, right in (([], items), (docs, [])):
        assert same(spark, left, right) == []


def test_treaps_have_heap_and_search_order():
    rng = np.random.default_rng(1)
    for impact in (rng.integers(1, 50, 400), np.arange(400), np.arange(400)[::-1].copy(), np.full(400, 7)):
        term, doc = np.sort(rng.integers(0, 5, 400)), np.arange(400)
        shuffled = rng.permutation(400)
        forest = Forest(term[shuffled], doc[shuffled], impact[shuffled], 6)
        for t in range(6):
            seen, todo = [], [(int(forest.root[t]), -1, 400)]
            while todo:
                x, low, high = todo.pop()
                if x < 0:
                    continue
                assert low < forest.doc[x] < high and all(forest.impact[y] <= forest.impact[x] for y in (forest.left[x], forest.right[x]) if y >= 0)
                seen.append(int(forest.doc[x]))
                todo += [(int(forest.left[x]), low, int(forest.doc[x])), (int(forest.right[x]), int(forest.doc[x]), high)]
            assert sorted(seen) == doc[term == t].tolist()


def test_few_slots_at_once_and_pruning():
    rng = random.Random(8)
    texts = [words(rng, 40) for _ in range(1500)]
    queries = Queries.read([words(rng, 6) for _ in range(30)])
    counts = [Counter(w for x in terms(t) if (w := queries.vocabulary.get(x.encode())) is not None) for t in texts]
    term = np.asarray([t for c in counts for t in c], np.int64)
    queries.weight = np.asarray([lexical_search.weight(int(n), 1500) for n in np.bincount(term, minlength=len(queries.vocabulary))])
    doc = np.repeat(np.arange(1500), [len(c) for c in counts])
    impact = lexical_search.impacts(np.asarray([n for c in counts for n in c.values()]), np.full(len(doc), 40), 1500, 60_000)
    forest, results = Forest(term, doc, impact, len(queries.vocabulary)), []
    for slots in (1 << 18, 50):
        best = Best(30, 10)
        scored = lexical_search.walk(forest, np.arange(1500), queries, best, slots)
        assert scored < 0.9 * 30 * 1500  # the rest was never scored
        results.append(sorted(zip(best.query.tolist(), best.score.tolist(), best.doc.tolist())))
    assert results[0] == results[1]
