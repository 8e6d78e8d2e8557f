"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a hashed order, are packed into blocks of ``block_chars`` characters. With the target weight w, block j of a
source may run from slot floor(j/w) on and must run before slot ceil((j+1)/w); earliest deadline first then keeps every source
within one block of its weight at every slot (Pfair). Weights are taken as they are: floats are fractions, and the windows are computed
in whole numbers, so nothing drifts however long the mix is. When a source runs out, the next phase goes on with the
other sources' weights; no document is dropped or repeated.

A schedule is one pass over its blocks with a heap, some 3 microseconds a block, in a Spark task. Blocks have BLOCK_CHARS characters,
or, where that would make more than MOST_BLOCKS of them, twice, four times ... as many, so the pass is bounded whatever the corpus holds.

Up to ``FAN`` sources make one schedule. More are dealt into groups, each with a schedule of its own over the slots that the
groups' schedule gives it, and so on upwards; each level adds less than one block to the deviation.

Slots count whole blocks. A document belongs to the slot in which it begins, so where documents are longer than a block, the
characters emitted so far may also differ by what the last document of a source has beyond its block: the bound on characters is
one block a level and the longest document.

Places within a source come from bucket totals and a sum inside each bucket, so a source with a third of all rows is
spread over all tasks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

BLOCK_CHARS, MOST_BLOCKS, TEMPERATURE = 16_384, 1 << 22, 0.5
#: Sources in one schedule; beyond that they are dealt into groups of about half as many.
FAN = 256
#: Blocks of one source in a row of the schedule.
CHUNK = 4096


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights: a float is a fraction with a power of two below."""
    ratio = {s: float(w).as_integer_ratio() for s, w in weights.items()}
    below = max((d for _, d in ratio.values()), default=1)
    return {s: n * (below // d) for s, (n, d) in ratio.items()}


def edf(shares: dict[str, int], blocks: dict[str, int]) -> tuple[dict[str, list[int]], int]:
    """For each source the slots of its blocks, earliest deadline first among the released ones, up to the slot in which the first
    source runs out of blocks; and how many slots that are."""
    total, order = sum(shares.values()), sorted(shares)
    waiting = [(0, k, 0) for k in range(len(order))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slots: list[list[int]] = [[] for _ in order]
    share, most, slot = [shares[s] for s in order], [blocks[s] for s in order], 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // share[k]), k, j))
        _, k, j = heapq.heappop(ready)
        slots[k].append(slot)
        slot += 1
        if j + 1 == most[k]:
            return dict(zip(order, slots)), slot
        heapq.heappush(waiting, ((j + 1) * total // share[k], k, j + 1))


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of one period of integer shares: as many as their sum."""
    total = sum(shares.values())
    slots, _ = edf(shares, {s: 2 * n + 2 for s, n in shares.items()})
    return {s: [x for x in at if x < total] for s, at in slots.items()}


def schedule(blocks: dict[str, int], shares: dict[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, slots spanned, slots of the blocks from the first slot on) of every source, phase by
    phase, in rows that do not go beyond a multiple of CHUNK blocks."""
    left, done, out, now = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), [], 0
    while left:
        slots, ran = edf({s: shares[s] for s in left}, left)
        for s, at in slots.items():
            cuts = sorted({0, len(at), *range(-done[s] % CHUNK, len(at), CHUNK)})
            out += [(s, done[s] + a, done[s] + b, now + at[a], at[b - 1] - at[a] + 1, [x - at[a] for x in at[a:b]]) for a, b in zip(cuts, cuts[1:])]
            done[s] += len(at)
            left[s] -= len(at)
            if not left[s]:
                del left[s]
        now += ran
    return out


SCHEDULE = "node string, share double, up string, first bigint, last bigint, slot0 bigint, span bigint, slots array<int>"


def _schedule_group(rows):
    """The schedule of one group of nodes (node, share, up, blocks, weight)."""
    import pandas as pd

    beside = {n: (s, u) for n, s, u in zip(rows["node"], rows["share"], rows["up"])}
    found = schedule({n: int(b) for n, b in zip(rows["node"], rows["blocks"])}, exact(dict(zip(rows["node"], rows["weight"]))))
    return pd.DataFrame([(n, *beside[n], *x) for n, *x in found], columns=["node", "share", "up", "first", "last", "slot0", "span", "slots"])


def schedules(sources: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """A schedule table for each level, from the sources (node, share, blocks, weight) up to one group that holds all."""
    levels, nodes, n = [], sources, sources.count()
    while True:
        groups = 1 if n <= fan else -(-2 * n // fan)
        up = F.concat(F.lit(f"{len(levels)}:"), F.pmod(F.xxhash64("node"), F.lit(groups)).cast("string"))
        nodes = nodes.withColumn("up", up)
        levels.append(shared.stored(nodes.groupBy("up").applyInPandas(_schedule_group, SCHEDULE), "schedule"))
        if groups == 1:
            return levels
        nodes = shared.stored(nodes.groupBy(F.col("up").alias("node")).agg(F.sum("share").alias("share"), F.sum("blocks").alias("blocks"), F.sum("weight").alias("weight")), "groups")
        n = groups


def _timed(rows: DataFrame, table: DataFrame, node: str, block: str) -> DataFrame:
    """rows with the slot of their block, and the group that the slots are those of. The table is broadcast while its arrays have at
    most MAX_BROADCAST_BYTES / 4 bytes; else both sides are joined by node and chunk of blocks, so that a large source is spread."""
    size = table.agg(F.sum(F.size("slots") * 4 + 100)).first()[0] or 0
    table = table.withColumns({"s_node": F.col("node"), "s_chunk": F.floor(F.col("first") / CHUNK)}).drop("node")
    if size <= shared.MAX_BROADCAST_BYTES // 4:
        table = F.broadcast(table)
    mine = (F.col(block) >= F.col("first")) & (F.col(block) < F.col("last"))
    met = rows.join(table, (F.col(node) == F.col("s_node")) & (F.floor(F.col(block) / CHUNK) == F.col("s_chunk")) & mine)
    return met.withColumn("slot", F.col("slot0") + F.get("slots", (F.col(block) - F.col("first")).cast("int")))


def mix(docs: DataFrame, shares: dict[str, float] | None = None, block_chars: int | None = None, keep: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """``row`` (all columns of docs, or those of ``keep``), ``source``, ``share`` (target, of 1), ``block``, ``slot`` and ``place``: rows in
    order of (slot, place) are the mix. ``shares``: numbers above 0, of any size; without it they follow the characters of a source to
    the power TEMPERATURE. ``block_chars``: see above; a given size is kept.

    A null source is the source ''; a null or empty text takes one character; rows given twice are two documents; an empty
    table gives an empty mix. A long text stays whole, in the slot where it begins. A source without a share in ``shares``
    has share 1. Columns with clashing names stay in ``row``. Any number of sources will do; only counts reach the driver.
    """
    spark, keep = docs.sparkSession, keep or docs.columns
    size = F.greatest(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1)).cast("bigint")
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    light = rows.drop("row")
    sources = shared.stored(light.groupBy(F.col("source").alias("node")).agg(F.sum("size").alias("chars"), F.count("*").alias("n")), "sources")
    if shares:
        if not all(0 < x < float("inf") for x in shares.values()):
            raise ValueError("shares are numbers above 0")
        given = spark.createDataFrame([(s, float(x)) for s, x in shares.items()], "node string, given double")
        weighted = sources.join(given, "node", "left").withColumn("weight", F.coalesce("given", F.lit(1.0)))
    else:
        weighted = sources.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(TEMPERATURE)))
    if block_chars is None:
        block_chars, chars = BLOCK_CHARS, sources.agg(F.sum("chars")).first()[0] or 0
        while chars > block_chars * MOST_BLOCKS:
            block_chars *= 2
    weighted = shared.stored(weighted.select("node", "weight", "n", F.ceil(F.col("chars") / F.lit(block_chars)).alias("blocks")), "weights")
    total, n_rows = weighted.agg(F.sum("weight"), F.sum("n")).first()
    levels = schedules(weighted.withColumn("share", F.col("weight") / F.lit(total or 1.0)), fan)

    bucket = F.pmod(F.col("h"), F.lit(min(65_536, max(64, (n_rows or 0) // 50_000))))
    sums = light.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
    before = sums.select("source", "bucket", F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("bucket", bucket).withColumn("inside", inside).join(before, ["source", "bucket"]).withColumn("place", F.col("before") + F.col("inside"))

    at = placed.select("row", "source", "place", F.floor(F.col("place") / block_chars).alias("block"))
    for k, table in enumerate(levels):
        if k == 0:
            at = _timed(at, table, "source", "block").select("row", "source", "share", "block", "place", "slot", "up")
        else:
            upper = at.withColumnsRenamed({"slot": "turn", "up": "member"})
            at = _timed(upper, table.drop("share"), "member", "turn").select("row", "source", "share", "block", "place", "slot", "up")
    return at.select("row", "source", "share", "block", "slot", "place")


def mixed(docs: DataFrame, shares: dict[str, float] | None = None, block_chars: int | None = None) -> DataFrame:
    """The rows of docs in the order of the mix (range-partitioned, sorted inside: files read in order are the mix)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = mix(docs, shares, block_chars).select("row", "slot", "place")
    return order.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(shared.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "source", "share", "block", "slot", "place")
