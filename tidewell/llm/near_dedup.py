"""MinHash near-duplicate detection with odd sketches.

1. Every text becomes the set of its 5-word shingles (64-bit fingerprints), 200 MinHash samples in 40 bands of 5, and an
   odd sketch: the samples folded into a 1,024-bit parity map. Equal sets share one *node*, so copies cost one row each.
2. A bucket is a band value that two or more nodes share. Its leader (the member that meets most others over all bands) is
   paired with the members of other components, components are taken, and the next leader has its turn, until few pairs of
   *different* components are left in the buckets; those are all tried. Pairs inside one component can change nothing, so no
   group is expanded into all its pairs.
3. A pair goes on if its set sizes allow the similarity and the XOR population count of the sketches estimates at least
   ``SKETCH_FLOOR`` (about eight standard deviations below 0.75); it is confirmed on the full sets.

A pair at exactly 0.75 shares no band with probability (1 - 0.75^5)^40, about 2e-5. Node ids are 64-bit fingerprints of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WORDS, SIMILARITY = 5, 75  # per cent
BANDS, ROWS, SKETCH_BITS, SKETCH_FLOOR = 40, 5, 1024, 0.5
#: Leaders are tried in turn until the pairs left are FEW_PAIRS for each member, a turn links under 1 % of its pairs, or MAX_TURNS are over;
#: then all pairs left are tried.
MAX_TURNS, FEW_PAIRS = 4, 4
#: Rows that a task takes where tables are small; pairs that are broadcast at most.
ROWS_A_TASK, MOST_SENT = 20_000, 200_000
#: A larger sketch for the nodes whose pairs the leaders leave open; its floor lies more than four standard deviations below 0.75.
FINE_SAMPLES, FINE_BITS, FINE_FLOOR = 1024, 4096, 0.68
_DRAWN = np.random.default_rng(20240229).integers(1, 1 << 32, (2, FINE_SAMPLES), dtype=np.uint64).astype(np.uint32)
_A, _B = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct fingerprints of the n-word shingles; of the whole sequence if it is shorter; none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(31)
    return np.unique(shared.mix64(s))


def minhash(fingerprints: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    x, low = (fingerprints >> np.uint64(16)).astype(np.uint32), np.full(samples, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        low = np.minimum(low, (x[k : k + 1024, None] * _A[:samples] + _B[:samples]).min(axis=0))
    return low


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the number of (place, sample) pairs that fall on each bit, as 64-bit words."""
    place = shared.mix64(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        h = shared.mix64(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return h.view(np.int64)


SKETCHES = "doc_id bigint, tk string, n_shingles bigint, node bigint, bands array<bigint>, odd array<bigint>"


@shared.tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        sizes, nodes, bands, odds = [], [], [], []
        for text in shared.text_bytes(batch.column(2)):
            s = shingles(text)
            sizes.append(len(s))
            if len(s):
                m = minhash(s)
                nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))
                bands.append(band_keys(m))
                odds.append(odd_sketch(m))
            else:
                nodes.append(None)
                bands.append([])
                odds.append([])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))], ["doc_id", "tk", "n_shingles", "node", "bands", "odd"])


def estimate(a, b, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS):
    """Similarity from two odd sketches: the population count z of their XOR gives the size of the samples' symmetric difference."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return 1 + F.lit(bits / 4 / samples) * F.log(F.greatest(1 - 2 * z / F.lit(bits), F.lit(1e-9)))


@shared.tidy
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes, np.ndarray] = (b"", shingles(b""))
    for batch in batches:
        keep = []
        for x, y in zip(shared.text_bytes(batch.column(2)), shared.text_bytes(batch.column(3))):
            if x != last[0]:
                last = (x, shingles(x))
            a, b = last[1], shingles(y)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def few(df: DataFrame, rows: int) -> DataFrame:
    """As many tasks as so many rows need; more only where there are more already."""
    return df.coalesce(max(2, rows // ROWS_A_TASK))


def confirm(pairs: DataFrame, n: int, active: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough; n: how many pairs there are.

    Up to MOST_SENT pairs go to the sketches and texts as a broadcast (below 64 MB with their sketches); more are joined by shuffles.
    """
    sent = F.broadcast if n <= MOST_SENT else (lambda df: df)
    side = lambda c: active.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
    both = side("b").join(sent(side("a").join(sent(pairs), "a")), "b")
    # the sketches of all active nodes stream past the pairs, in as many tasks as they have
    likely = shared.stored(both.where((100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (estimate(F.col("odd_a"), F.col("odd_b")) >= SKETCH_FLOOR)).select("a", "b"), "likely")
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")).join(sent(likely), c)
    return text("a").join(text("b"), ["a", "b"]).select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge. Alternating large and small stars; the edges
    are written to the shared folder after each round, and the rounds end when they no longer change."""
    now = shared.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    rows = now.count()
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = few(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), rows)
        large = few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), rows)
        low = few(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        linked = few(large.join(low, "u"), rows)
        small = few(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), rows)
        now = shared.stored(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


def _mixed(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    bands = few(rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band"), n)
    return few(rows.join(bands, "band", "left_semi"), n)


@shared.tidy
def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), shared.text_bytes(batch.column(1))):
            s = shingles(text)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s.view(np.int64))], ["node", "shingle"])


@shared.tidy
def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = [odd_sketch(minhash(shingles(t), FINE_SAMPLES), FINE_BITS) for t in shared.text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.list_(pa.int64()))], ["node", "fine"])


def _sets(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, shingle) of these nodes; and the shingles (shingle, n) that more than one of them has."""
    sets = shared.stored(texts.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_explode, "node bigint, shingle bigint"), "sets")
    twice = shared.stored(sets.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    return sets, twice


def _able(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Rows (band, node, central, label) with ``size`` and ``common``: the node's shingles that another node here has too.

    Two sets with m shingles in common have a similarity of at most m / (|x| + |y| - m), and m is at most either's ``common``.
    So 7m >= 3(|x| + |y|) must hold; a node that even its bucket's smallest set can't satisfy goes, without loss.
    """
    sets, twice = _sets(rows, texts)
    size = sets.groupBy("node").agg(F.count("*").alias("size"))
    common = shared.join_spread(sets, twice, ["shingle"], "n", F.col("node")).groupBy("node").agg(F.count("*").alias("common"))
    known = shared.stored(few(rows.select("band", "node", "central", "label").join(few(size.join(common, "node"), n), "node"), n), "known")
    least = few(known.groupBy("band").agg(F.min("size").alias("least")), n)
    return _mixed(shared.stored(few(known.join(least, "band").where("7 * common >= 3 * (size + least)").drop("least"), n), "able"), n)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    No text or no words: the empty set, its own component. Rows with equal sets are one class whatever their ids; a null
    doc_id joins its class and is kept only where the whole class has no id. An empty table gives an empty one; texts of any
    length are read whole. Only doc_id and text are read, whatever other columns are called.
    """
    with shared.Scope(docs.sparkSession, "near-dedup") as scope:  # one small row a document stays; the tables that led to it go
        return scope.settled(_classes(docs), "classes")


def _classes(docs: DataFrame) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("bigint"), shared.text_key().alias("tk"), F.col("text").cast("string"))
    sketches = shared.stored(source.mapInArrow(_sketch, SKETCHES), "sketches")
    # copies end here: one row a set, with the number of its rows
    once = sketches.where("node is not null").groupBy("node").agg(F.min("tk").alias("tk"), F.first("n_shingles").alias("n_shingles"), F.first("odd").alias("odd"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = shared.stored(once, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = shared.stored(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = shared.stored(shared.join_spread(banded, buckets, ["band"], "n", F.col("node")), "members")
    active = shared.stored(nodes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), "active")
    met = shared.join_spread(source, active.select("tk", "node", "copies"), ["tk"], "copies", F.monotonically_increasing_id())
    texts = shared.stored(met.groupBy("node").agg(F.first("text").alias("text")), "texts")

    links = label = None
    n = members.count()
    met = few(members.groupBy("band").agg(F.count("*").alias("met")), n)
    central = few(members.join(met, "band").groupBy("node").agg(F.sum("met").alias("central")), n)
    open_ = shared.stored(few(members.join(central, "node"), n).withColumn("label", F.col("node")), "open")
    for turn in range(MAX_TURNS):
        lead = few(open_.groupBy("band").agg(F.max(F.struct("central", "node", "label")).alias("lead")), n).select("band", F.col("lead.node").alias("lead"), F.col("lead.label").alias("lead_label"))
        led = shared.stored(few(open_.select("band", "node", "central", "label").join(lead, "band"), n), f"led-{turn}")
        tried = shared.stored(few(led.where("label <> lead_label").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct(), n), f"tried-{turn}")
        n_tried = tried.count()
        found = shared.stored(confirm(tried, n_tried, active, texts), f"links-{turn}")
        linked = found.count()
        links = found if links is None else links.union(found)
        if linked or label is None:
            label = shared.stored(components(links), f"labels-{turn}")
        # a leader has met all others of its bucket; buckets of one component are done
        rest = few(led.where("node <> lead").select("band", "node", "central").join(label, "node", "left"), n).withColumn("label", F.coalesce("label", "node"))
        open_ = shared.stored(_able(shared.stored(_mixed(rest, n), f"mixed-{turn}"), texts, n), f"open-{turn}")
        sizes = few(few(open_.groupBy("band", "label").agg(F.count("*").alias("n")), n).groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")), n)
        pairs, held = sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if pairs <= FEW_PAIRS * held or 100 * linked < n_tried:
            break
    fine = few(texts.join(few(open_.select("node").distinct(), n), "node", "left_semi"), n).select("node", "text").mapInArrow(_fine, "node bigint, fine array<bigint>")
    held = few(open_.groupBy("node").agg(F.collect_list("band").alias("mine")), n)  # at most BANDS
    open_ = shared.stored(open_.join(shared.stored(fine.join(held, "node"), "fine"), "node"), "last")
    other = open_.select("band", *(F.col(c).alias(f"other_{c}") for c in ("node", "label", "size", "common", "fine", "mine")))
    fits = (7 * F.least("common", "other_common") >= 3 * (F.col("size") + F.col("other_size"))) & (estimate(F.col("fine"), F.col("other_fine"), FINE_SAMPLES, FINE_BITS) >= FINE_FLOOR)
    once = F.array_min(F.array_intersect("mine", "other_mine")) == F.col("band")  # in the first bucket that both share
    across = shared.stored(open_.join(other, "band").where(F.expr("label < other_label") & fits & once).select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct(), "across")
    found = shared.stored(confirm(across, across.count(), active, texts), "links")
    if not found.isEmpty():
        label = shared.stored(components(links.union(found)), "labels")

    light = sketches.select("doc_id", "n_shingles", "node")
    labelled = shared.stored(label.join(active.select("node", "copies"), "node"), "labelled")
    rows = shared.stored(shared.join_spread(light, labelled, ["node"], "copies", F.monotonically_increasing_id(), "left").withColumn("label", F.coalesce("label", "node")), "rows")
    least = shared.stored(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    found = shared.join_spread(rows, least, ["label"], "n", F.monotonically_increasing_id(), "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one whose doc_id is the smallest. Rows without an id stay, as nothing tells
    them apart; a row given twice with one id is one document and stays as it is."""
    dropped = classes(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(shared.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
