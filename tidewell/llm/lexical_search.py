"""Ranked lexical search over inverted treaps.

Every task turns its documents into forests of some POSTINGS postings: for each query term a treap, whose search order is the
document's id and whose heap order is the posting's impact, so that the root of a subtree bounds all below it. A query walks
the treaps of its terms together: an interval of documents is bounded by the sum of its terms' largest impacts in it; it is dropped
if that cannot enter the k best, else it is split at the document with the largest single impact, which is scored. All intervals of
all queries take a step at once, as numpy arrays.

Term weights need the whole collection, so there are two passes: one counts (documents, lengths, terms), one searches. Between
them each document is a row of term numbers and counts. Tasks give their k best for each query, and these are ranked again. Queries
go in blocks of at most QUERY_BYTES of text, and only a block's terms are counted, weighed and broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .decontamination import words_of

K = 10
QUERY_BYTES, POSTINGS, SLOTS = 4 << 20, 1 << 20, 1 << 18
COUNTS = "doc_id bigint, n bigint, terms array<int>, times array<int>"
#: What a null doc_id sorts as.
NO_ID = -(1 << 63)


@dataclass
class Queries:
    """A block of queries: for query q the terms of[start[q]:start[q + 1]] and how often it has them; later each term's weight."""

    vocabulary: dict[bytes, int]
    start: np.ndarray
    of: np.ndarray
    times: np.ndarray
    weight: np.ndarray | None = None

    @classmethod
    def read(cls, texts: list[str | None]) -> Queries:
        counts = [Counter(words_of((t or "").encode())) for t in texts]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*counts)))}
        of = np.asarray([vocabulary[w] for c in counts for w in c], np.int64)
        return cls(vocabulary, np.cumsum([0, *map(len, counts)]), of, np.asarray([n for c in counts for n in c.values()], np.int64))


def _count(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shipped.value.vocabulary.get
        for batch in batches:
            n, terms, times = [], [], []
            for text in shared.text_bytes(batch.column(1)):
                words = words_of(text)
                held = Counter(map(get, words))
                held.pop(None, None)
                n.append(len(words))
                terms.append(list(held))
                times.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])

    return shared.tidy(run)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's documents."""
    sums = np.zeros(0, np.int64)
    for batch in batches:
        seen = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(sums))
        seen[: len(sums)] += sums
        sums = seen
    term = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(sums[term], pa.int64())], ["term", "df"])


def impacts(times: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """A posting's impact, below a million: its term's share of the score at weight 1, by the document's length against the mean."""
    m = 100 - 75 + (75 * n * docs) // length
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Forest:
    """A treap for each term over some documents: postings in order of (term, document), with children and roots."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        term = term[order]
        n = len(term)
        at = np.arange(n)
        # equal impacts: the heap order of hashes, so that treaps stay flat
        heap = (self.impact << 32) | (shared.mix64(at.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64)
        first = np.r_[True, term[1:] != term[:-1]] if n else np.zeros(0, bool)
        before, behind = np.where(first, -1, at - 1), np.where(np.r_[first[1:], True] if n else first, -1, at + 1)
        for near in (before, behind):  # to the nearest with a larger impact: what lies between is smaller, so pointers may jump
            open_ = np.flatnonzero(near >= 0)
            while len(open_ := open_[heap[near[open_]] < heap[open_]]):
                near[open_] = near[near[open_]]
                open_ = open_[near[open_] >= 0]
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        to_before = (before >= 0) & ((behind < 0) | (heap[before] < heap[behind]))
        self.right[before[to_before]] = at[to_before]
        to_behind = (behind >= 0) & ~to_before
        self.left[behind[to_behind]] = at[to_behind]
        self.root = np.full(n_terms, -1)
        top = (before < 0) & (behind < 0)
        self.root[term[top]] = at[top]

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The topmost posting below each node (itself included) with low < document < high; -1 if there is none."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            x = node[open_]
            d = self.doc[x]
            small, large = d <= low[open_], d >= high[open_]
            move = small | large
            open_, x, small = open_[move], x[move], small[move]
            node[open_] = x = np.where(small, self.right[x], self.left[x])
            open_ = open_[x >= 0]
        return node


class Best:
    """The k best (score, doc_id) of every query so far; equal scores by ascending doc_id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = np.ones(n, np.int64), np.full(n, np.iinfo(np.int64).max)  # what must be reached, and the doc_id that must be undercut at that score

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = (score > self.least[query]) | (score == self.least[query]) & (doc < self.last[query])
        if not good.any():
            return
        q, s, d = (np.concatenate(x) for x in ((self.query, query[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((d, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.query, self.score, self.doc = q[kept], s[order][kept], d[order][kept]
        full = place[kept] == self.k - 1
        self.least[self.query[full]], self.last[self.query[full]] = self.score[full], self.doc[full]


def walk(forest: Forest, ids: np.ndarray, queries: Queries, best: Best, slots: int = SLOTS) -> int:
    """Searches the forest, whose document j has the id ids[j] (ascending), for all queries; returns how many documents were scored."""
    n_q = len(queries.start) - 1
    owner = np.repeat(np.arange(n_q), np.diff(queries.start))
    value = queries.times * queries.weight[queries.of]
    node = forest.root[queries.of]
    use = (node >= 0) & (value > 0)
    asked, place = np.unique(owner[use], return_inverse=True)
    # an interval: its query and documents low < d < high; a slot: its interval, a term's topmost posting in it, the term's value
    stack = [(asked, np.full(len(asked), -1), np.full(len(asked), len(ids)), place, node[use], value[use])] if len(asked) else []
    scored = 0
    while stack:
        query, low, high, of, node, value = stack.pop()
        if len(of) > slots and len(query) > 1:  # bounded memory: one half waits
            half = max(1, int(of[len(of) // 2]))
            cut = int(np.searchsorted(of, half))
            stack.append((query[half:], low[half:], high[half:], of[cut:] - half, node[cut:], value[cut:]))
            stack.append((query[:half], low[:half], high[:half], of[:cut], node[:cut], value[:cut]))
            continue
        begins = np.searchsorted(of, np.arange(len(query)))
        worth = value * forest.impact[node]
        bound = np.add.reduceat(worth, begins)
        keep = (bound > best.least[query]) | (bound == best.least[query]) & (ids[low + 1] < best.last[query])
        if not keep.all():
            if not keep.any():
                continue
            some = keep[of]
            number = np.cumsum(keep) - 1
            query, low, high = query[keep], low[keep], high[keep]
            of, node, value, worth = number[of[some]], node[some], value[some], worth[some]
            begins = np.searchsorted(of, np.arange(len(query)))
        top = np.flatnonzero(worth == np.maximum.reduceat(worth, begins)[of])
        top = top[np.r_[True, of[top[1:]] != of[top[:-1]]]]
        split = forest.doc[node[top]]
        at = split[of]
        hit = forest.within(node, at - 1, at + 1)
        best.add(query, np.add.reduceat(np.where(hit >= 0, value * forest.impact[hit], 0), begins), ids[split])
        scored += len(query)
        left, right = forest.within(node, low[of], at), forest.within(node, at, high[of])
        sides = []
        for side, a, b in ((left, low, split), (right, split, high)):
            there = side >= 0
            kept, number = np.unique(of[there], return_inverse=True)
            sides.append((query[kept], a[kept], b[kept], number, side[there], value[there]))
        (lq, la, lb, lo, ln, lv), (rq, ra, rb, ro, rn, rv) = sides
        if len(lq) + len(rq):
            stack.append(tuple(np.concatenate(x) for x in ((lq, rq), (la, ra), (lb, rb), (lo, ro + len(lq)), (ln, rn), (lv, rv))))
    return scored


def _search(shipped, docs: int, length: int, k: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shipped.value
        best = Best(len(queries.start) - 1, k)
        held, size = [], 0

        def flush():
            ids, n, counts, term, times = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            impact = impacts(times, np.repeat(n, counts), docs, length)
            walk(Forest(term, np.repeat(place, counts), impact, len(queries.weight)), ids[order], queries, best)

        for batch in batches:
            column = lambda c: batch.column(c)  # noqa: B023, E731
            counts = np.diff(column("terms").offsets.to_numpy())
            term, times = (column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
            held.append((column("doc_id").fill_null(NO_ID).to_numpy(), column("n").to_numpy(), counts, term, times))
            size += len(term)
            if size >= postings:
                flush()
                held, size = [], 0
        if size:
            flush()
        ids = pa.array(best.doc, pa.int64(), mask=best.doc == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.query, pa.int32()), ids, pa.array(best.score, pa.int64())], ["query", "doc_id", "score"])

    return shared.tidy(run)


def search(docs: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of queries (item_id, text) the k documents with the highest score above 0.

    A null or empty text has no terms: as a document it is found by nothing, as a query it finds nothing. Equal scores
    stand by ascending doc_id, a null one first. Rows given twice are two documents, or two queries with a ranking each. An empty table on either side
    gives no rows. Long texts are read whole. Only these columns are read, whatever others are called.
    """
    spark, scope = docs.sparkSession, shared.Scope(docs.sparkSession, "search")
    asked = scope.stored(queries.select(F.col("item_id"), F.col("text").cast("string"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("size"), F.monotonically_increasing_id().alias("at")), "queries")
    blocks = max(1, math.ceil(2 * (asked.agg(F.sum("size")).first()[0] or 0) / query_bytes))  # twice: blocks are dealt by hash
    source, out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b).select("item_id", "at", "text").collect()
        read = Queries.read([r.text for r in block])
        shipped = spark.sparkContext.broadcast(read)
        counts = scope.stored(source.mapInArrow(_count(shipped), COUNTS), "counts")
        n_docs, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = dict(counts.select("terms").mapInArrow(_held, "term int, df bigint").groupBy("term").agg(F.sum("df")).collect())  # at most the block's terms
        read.weight = np.asarray([weight(held[t], n_docs) if t in held else 0 for t in range(len(read.vocabulary))], np.int64)
        shipped.unpersist()
        found = counts.where(F.size("terms") > 0).mapInArrow(_search(spark.sparkContext.broadcast(Queries({}, read.start, read.of, read.times, read.weight)), n_docs, length, k, postings), "query int, doc_id bigint, score bigint")
        names = spark.createDataFrame([(q, r.at) for q, r in enumerate(block)], "query int, at bigint")
        out.append(scope.stored(found.join(F.broadcast(names), "query").select("at", "doc_id", "score"), "found"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
    return ranked.join(asked.select("at", "item_id"), "at").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, nd),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l))))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
