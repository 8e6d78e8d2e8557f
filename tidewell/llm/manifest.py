"""Merkle manifest of a dataset: contiguous numpy digest matrices in aligned blocks.

A document's leaf is the SHA-256 of its fields. The leaves of a source stand in order of doc_id; a sort by range of (source,
doc_id) and the counts of its partitions give each leaf its place, so that no source is ever in one task. ``BLOCK`` = FANOUT ** HEIGHT
neighbouring leaves are one row of a table: their 64-byte hex digests, one after the other. A task reads that as an (n, 64)
matrix, reshapes it by the fanout and hashes its rows, level by level, until HEIGHT levels are done (or, where a source
has one block, one node is left). Block roots are the nodes of the next table, and so on; subroots make a tree of their
own. Going down again, each block gets what stands above it (place in its run and siblings, level by level), and siblings of
all its leaves come from its matrices by index arithmetic.

A table of blocks has a 729th of the rows of the one below it, so the whole manifest takes some 0.1 % more than its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

FANOUT, HEIGHT = 3, 6
BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "key string, pos bigint, size bigint, digest string"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields: '-' for null, else the number of UTF-8 bytes, ':' and the value."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*said), 256)


def _key(source: Column) -> Column:
    """A source's name in the tree: null first, then bytewise."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def placed(rows: DataFrame, order: list[str], scope: shared.Scope, name: str) -> DataFrame:
    """rows (of several keys) with ``pos``, the place within ``key`` by ``order``, and ``size``, the rows of the key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order).withColumn("i", F.monotonically_increasing_id())
    ranged = scope.stored(ranged.withColumn("part", F.shiftright("i", 33)), name)
    runs = ranged.groupBy("key", "part").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    by_key = W.partitionBy("key")
    runs = runs.select("key", "part", "first", F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by_key).alias("size"))
    return ranged.join(runs, ["key", "part"]).withColumn("pos", F.col("i") - F.col("first") + F.col("before")).drop("i", "part", "first", "before")


def blocks(nodes: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """One row for each aligned block of nodes: ``digests`` is their digests in order, and each column of ``beside`` an array."""
    held = F.array_sort(F.collect_list(F.struct("pos", "digest", *beside)))
    rows = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("size").alias("size"), held.alias("held"))
    return rows.select("key", "block", "size", F.array_join("held.digest", "").alias("digests"), *(F.col(f"held.{c}").alias(c) for c in beside))


def _matrix(digests: str) -> np.ndarray:
    return np.frombuffer(digests.encode(), np.uint8).reshape(-1, 64)


def _hashed(rows: list) -> np.ndarray:
    return _matrix("".join([hashlib.sha256(r).hexdigest() for r in rows]))


def raised(leaves: np.ndarray, alone: bool) -> list[np.ndarray]:
    """Digest matrices from the leaves upwards: until one node is left where the block is a whole tree, else HEIGHT times."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= HEIGHT:
        m = levels[-1]
        whole = len(m) // FANOUT * FANOUT
        levels.append(_hashed([*np.ascontiguousarray(m[:whole]).reshape(-1, FANOUT * 64), *([np.ascontiguousarray(m[whole:])] if whole < len(m) else [])]))
    return levels


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_pylist()
        tops = [raised(_matrix(d), s <= BLOCK)[-1].tobytes().decode() for d, s in zip(batch.column("digests").to_pylist(), sizes)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array([-(-s // BLOCK) for s in sizes], pa.int64()), pa.array(tops, pa.string())], ["key", "pos", "size", "digest"])


def tree(lowest: DataFrame, scope: shared.Scope, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks from ``lowest`` upwards, and the root of every key (key, digest)."""
    tables, roots, most = [lowest], None, lowest.agg(F.max("size")).first()[0] or 0
    while True:
        nodes = scope.stored(tables[-1].select("key", "block", "size", "digests").mapInArrow(_up, NODE), f"{name}-nodes")
        done = nodes.where("size = 1").select("key", "digest")
        roots = done if roots is None else roots.unionByName(done)
        most = -(-most // BLOCK)
        if most <= 1:
            return tables, roots
        tables.append(scope.stored(blocks(nodes.where("size > 1")), f"{name}-blocks"))


def siblings(levels: list[np.ndarray], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top: every leaf's place in its run, how many nodes the run has, and the run's digests (n, FANOUT, 64)."""
    out, at = [], np.arange(n)
    for m in levels[:-1]:
        start = at // FANOUT * FANOUT
        run = start[:, None] + np.arange(FANOUT)
        out.append((at - start, np.minimum(FANOUT, len(m) - start), m[np.minimum(run, len(m) - 1)]))
        at = at // FANOUT
    return out


def _said(steps: list, above: str, i: int) -> str:
    """What stands above leaf i: for each level its place in the run, the run's size, and the other digests."""
    out = []
    for place, count, runs in steps:
        k, c = int(place[i]), int(count[i])
        out.append(f"{k}{c}" + "".join(runs[i, o].tobytes().decode() for o in range(c) if o != k))
    return "".join(out) + above


def _steps(above: str) -> list[tuple[bytes, bytes]]:
    """Of every level in ``above``: the digests before and those behind."""
    out, at = [], 0
    while at < len(above):
        k, c = int(above[at]), int(above[at + 1])
        held = above[at + 2 : at + 2 + 64 * (c - 1)].encode()
        out.append((held[: 64 * k], held[64 * k :]))
        at += 2 + 64 * (c - 1)
    return out


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, pos, said, root = [], [], [], []
        for k, b, s, d, above, r in zip(*(c.to_pylist() for c in batch.columns)):
            levels = raised(_matrix(d), s <= BLOCK)
            n = len(levels[0])
            steps = siblings(levels, n)
            key += [k] * n
            pos += range(b * BLOCK, b * BLOCK + n)
            said += [_said(steps, above, i) for i in range(n)]
            root += [r] * n
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(pos, pa.int64()), pa.array(said, pa.string()), pa.array(root, pa.string())], ["key", "pos", "above", "subroot"])


def _with_above(table: DataFrame, nodes: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Blocks with what stands above their root: that of their key, if they are its only block, else that of their node in the next table."""
    alone = table.where(F.col("size") <= BLOCK).join(tops, "key")
    if nodes is None:
        return alone
    return alone.unionByName(table.where(F.col("size") > BLOCK).join(nodes.withColumnRenamed("pos", "block"), ["key", "block"]))


def paths(tables: list[DataFrame], tops: DataFrame, scope: shared.Scope, name: str) -> DataFrame:
    """The lowest table's blocks with ``above`` and ``subroot``, from those of every key (``tops``: key, above, subroot)."""
    nodes = None
    for table in reversed(tables[1:]):
        rows = _with_above(table, nodes, tops).select("key", "block", "size", "digests", "above", "subroot")
        nodes = scope.stored(rows.mapInArrow(_down, "key string, pos bigint, above string, subroot string"), f"{name}-paths")
    return _with_above(tables[0], nodes, tops)


def proofs(digests: str, changed: str, alone: bool, above: str) -> tuple[list[str], list[str]]:
    """For every leaf of a block the SHA-256 of its siblings up to the root, and the root that follows from its ``changed`` digest."""
    levels = raised(_matrix(digests), alone)
    n = len(levels[0])
    steps, over = siblings(levels, n), _steps(above)
    end = b"".join(a + b for a, b in over)
    spans = np.arange(FANOUT)
    others = [(spans != place[:, None]) & (spans < count[:, None]) for place, count, _ in steps]
    proof = [hashlib.sha256(b"".join([runs[i][mask[i]].tobytes() for (_, _, runs), mask in zip(steps, others)]) + end).hexdigest() for i in range(n)]
    now, rows = _matrix(changed), np.arange(n)
    for place, count, runs in steps:
        run = runs.copy()
        run[rows, place] = now
        flat = run.reshape(n, FANOUT * 64)
        now = _hashed([r[: 64 * c] for r, c in zip(flat, count.tolist())])
    held = [x.tobytes() for x in now]
    for before, behind in over:
        held = [hashlib.sha256(before + x + behind).hexdigest().encode() for x in held]
    return proof, [x.decode() for x in held]


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, digests, changed, above, subroot, ids in zip(*(batch.column(c).to_pylist() for c in ("size", "digests", "changed", "above", "subroot", "doc_id"))):
            proof, folded = proofs(digests, "".join(changed), size <= BLOCK, above)
            leaves = [digests[k : k + 64] for k in range(0, len(digests), 64)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (leaves, [subroot] * len(ids), proof, folded))], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


class Manifest:
    """The tree of one state of a dataset. ``root`` is its digest; ``subroots`` has (source, subroot, n_docs); ``tables`` are the blocks, the leaves' first."""

    def __init__(self, docs: DataFrame, changed: Column | None = None, scope: shared.Scope | None = None):
        """docs: doc_id, source, lang, n_chars, text; ``changed``: the text that a later copy of each document has, for ``verify``.

        A null field is hashed as '-', so it differs from an empty one. Null ids stand first in their source; rows with one id
        stand by their leaves, and rows given twice are two leaves. An empty table has the root '' (there is nothing to hash). Long
        texts are hashed whole. Other columns are not read, whatever their names.
        """
        self.scope = scope or shared.Scope(docs.sparkSession, "manifest")
        now = [F.col(c) for c in FIELDS]
        later = [*now[:-1], changed if changed is not None else F.col("text")]
        leaves = docs.select(_key(F.col("source")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(now).alias("digest"), leaf(later).alias("changed"), F.monotonically_increasing_id().alias("at"))
        lowest = blocks(placed(self.scope.stored(leaves, "leaves"), ["doc_id", "digest", "at"], self.scope, "ranged"), ("doc_id", "changed"))
        self.tables, roots = tree(self.scope.stored(lowest, "blocks"), self.scope, "source")
        self._subroots = placed(roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), ["name"], self.scope, "subroots")
        self._over, top = tree(self.scope.stored(blocks(self._subroots), "root-blocks"), self.scope, "root")
        self.root = (top.first() or {"digest": ""})["digest"]

    @property
    def subroots(self) -> DataFrame:
        counts = self.tables[0].where("block = 0").select(F.col("key").alias("name"), F.col("size").alias("n_docs"))
        source = F.when(F.col("name") == "", F.lit(None)).otherwise(F.expr("substr(name, 2)"))
        return self._subroots.select("name", F.col("digest").alias("subroot")).join(counts, "name").select(source.alias("source"), "subroot", "n_docs")

    def verify(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the changed leaf and the siblings here) and verified, for every document."""
        spark = self.tables[0].sparkSession
        start = spark.createDataFrame([("", "", self.root)], "key string, above string, subroot string")
        over = paths(self._over, start, self.scope, "root").select("key", "block", "size", "digests", "above", "subroot").mapInArrow(_down, "key string, pos bigint, above string, subroot string")
        tops = self._subroots.join(over.select("pos", "above"), "pos").select(F.col("name").alias("key"), "above", F.col("digest").alias("subroot"))
        rows = paths(self.tables, self.scope.stored(tops, "tops"), self.scope, "source").select("size", "digests", "changed", "above", "subroot", "doc_id")
        found = rows.mapInArrow(_prove, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
        return found.withColumn("root", F.lit(self.root)).withColumn("verified", F.col("folded_root") == F.col("root"))

    def differing(self, other: Manifest) -> DataFrame:
        """(source, block, whose) of the aligned blocks that only one of two manifests has, or that differ: whose is 'here', 'there' or 'both'. Only digests of blocks are compared."""
        name = F.when(F.coalesce(F.col("a.key"), F.col("b.key")) == "", F.lit(None)).otherwise(F.expr("substr(coalesce(a.key, b.key), 2)"))
        of = lambda m: m.tables[0].select("key", "block", F.sha2("digests", 256).alias("d"))
        met = of(self).alias("a").join(of(other).alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")), "full")
        whose = F.when(F.col("b.key").isNull(), F.lit("here")).when(F.col("a.key").isNull(), F.lit("there")).otherwise(F.lit("both"))
        return met.where(~F.col("a.d").eqNullSafe(F.col("b.d"))).select(name.alias("source"), F.coalesce(F.col("a.block"), F.col("b.block")).alias("block"), whose.alias("whose"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides crc32(doc_id), the changed copy has lost its line feeds; a null id changes nothing."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = Manifest(shared.table(spark, sf_dir, "documents"), changed)
    return made.verify().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_LEAF = "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END" for c in FIELDS) + "))"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
              lambda c, x: list_reduce(list_prepend(xor(c, x), [i::UBIGINT for i in range(8)]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) & 1 = 1
            THEN replace(text, chr(10), '') ELSE text END AS later FROM documents),
l AS (SELECT doc_id, source, {_LEAF} AS leaf, {_LEAF.replace("text", "later")} AS changed, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(source, level, i, n, h) AS (SELECT source, 0, i, n, leaf FROM l
  UNION ALL SELECT source, min(level) + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, i // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, n, h) AS (SELECT 0, i, n, h FROM s UNION ALL SELECT min(level) + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 3),
up AS (SELECT source, level AS step, i, h FROM t WHERE n > 1
       UNION ALL SELECT s.source, 100 + u.level, u.i, u.h FROM s, u WHERE u.n > 1),
node AS (SELECT l.doc_id, l.source, l.changed, x.step, CAST(CASE WHEN x.step < 100 THEN l.i // CAST(pow(3, x.step) AS BIGINT) ELSE s.i // CAST(pow(3, x.step - 100) AS BIGINT) END AS BIGINT) AS i
       FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN (SELECT DISTINCT source, step FROM up) x ON x.source IS NOT DISTINCT FROM l.source),
run AS (SELECT node.doc_id, node.step, coalesce(string_agg(up.h, '' ORDER BY up.i) FILTER (up.i < node.i), '') AS a, coalesce(string_agg(up.h, '' ORDER BY up.i) FILTER (up.i > node.i), '') AS b
        FROM node JOIN up ON up.source IS NOT DISTINCT FROM node.source AND up.step = node.step AND up.i // 3 = node.i // 3 GROUP BY node.doc_id, node.step),
turn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM run),
p AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY step)) AS proof_sha256, max(k) AS last FROM turn GROUP BY doc_id),
f(doc_id, k, h) AS (SELECT doc_id, 0::BIGINT, changed FROM l UNION ALL SELECT f.doc_id, turn.k, sha256(turn.a || f.h || turn.b) FROM f JOIN turn ON turn.doc_id = f.doc_id AND turn.k = f.k + 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT h FROM u WHERE n = 1) r LEFT JOIN p USING (doc_id) JOIN f ON f.doc_id = l.doc_id AND f.k = coalesce(p.last, 0)
"""
