"""Mixing: emitted rows against a brute-force mix, deviation of what is emitted, any number of sources, both joins, edge cases."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing, shared

DOCS = "doc_id bigint, text string, source string"


def corpus(spark, sizes: dict[str, list[int]]):
    return spark.createDataFrame([(k, "x" * n, s) for k, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)], DOCS)


def brute_slots(blocks: dict[str, int], shares: dict[str, int]) -> dict[tuple[str, int], int]:
    """Slot by slot, over all blocks: windows count from the slot in which a source last ran out."""
    out, done, left, start, slot = {}, dict.fromkeys(blocks, 0), {s for s, n in blocks.items() if n}, 0, 0
    base = dict(done)
    while left:
        total = sum(shares[s] for s in left)
        ready = [(-(-(done[s] - base[s] + 1) * total // shares[s]), s) for s in sorted(left) if (done[s] - base[s]) * total // shares[s] <= slot - start]
        _, s = min(ready)
        out[s, done[s]] = slot
        done[s] += 1
        slot += 1
        if done[s] == blocks[s]:
            left.discard(s)
            start, base = slot, dict(done)
    return out


def test_emitted_rows_against_brute_force(spark):
    df = corpus(spark, {"a": [70, 30, 50] * 40, "b": [20] * 90, "c": [400, 10, 10] * 12, "": [1] * 7})
    df = df.withColumn("source", F.nullif("source", F.lit("")))
    shares = {"a": 5, "b": 3, "c": 2}
    keyed = df.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")).collect()
    place, at = {}, defaultdict(int)
    for r in sorted(keyed, key=lambda r: (r.s, r.h % 64, r.h)):
        place[r.doc_id] = (r.s, at[r.s])
        at[r.s] += r.n
    slots = brute_slots({s: -(-n // 100) for s, n in at.items()}, {**shares, "": 1})
    want = {d: (s, slots[s, p // 100], p) for d, (s, p) in place.items()}
    got = {r.doc_id: (r.source, r.slot, r.place) for r in mixing.mix(df, shares, block_chars=100).select("row.doc_id", "source", "slot", "place").collect()}
    assert got == want


def test_characters_stay_within_a_block_and_the_longest_document(spark):
    df = corpus(spark, {"a": [90, 250, 10] * 60, "b": [40] * 300, "c": [700] * 9})
    shares, block = {"a": 3, "b": 2, "c": 1}, 100
    rows = sorted((r.slot, r.place, r.source, r.n) for r in mixing.mix(df, shares, block).select("slot", "place", "source", F.length("row.text").alias("n")).collect())
    first_end = min(max(s for s, _, x, _ in rows if x == src) for src in shares)
    sent = defaultdict(int)
    for k, (slot, _, s, n) in enumerate(rows):
        if slot >= first_end:
            break
        sent[s] += n
        if k + 1 < len(rows) and rows[k + 1][0] > slot:  # a slot is over
            for x, share in shares.items():
                assert abs(sent[x] - (rows[k + 1][0]) * block * share / 6) < 2 * block + 700


@pytest.mark.parametrize("sent", [shared.MAX_BROADCAST_BYTES, 0])
def test_many_sources_in_levels(spark, monkeypatch, sent):
    monkeypatch.setattr(shared, "MAX_BROADCAST_BYTES", sent)
    n = 5000
    df = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(60)).alias("text"), F.concat(F.lit("host"), (F.col("id") % n).cast("string")).alias("source"))
    rows = mixing.mix(df, block_chars=50).select("row.doc_id", "source", "slot", "place").collect()
    assert sorted(r.doc_id for r in rows) == list(range(3 * n))
    assert len({(r.slot, r.source) for r in rows}) == len({r.slot for r in rows}) == 3 * n  # a slot is one source's
    assert max(r.slot for r in rows) < 4 * n
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append((r.place, r.slot))
    assert all([s for _, s in sorted(x)] == sorted(s for _, s in x) for x in by_source.values())


def test_levels_deviate_less_than_a_block_each(spark):
    df = spark.range(2400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(10)).alias("text"), F.concat(F.lit("s"), (F.col("id") % 24).cast("string")).alias("source"))
    rows = sorted((r.slot, r.source) for r in mixing.mix(df, {f"s{k}": 1 for k in range(24)}, block_chars=10, fan=8).select("slot", "source").collect())
    assert [s for s, _ in rows] == list(range(2400))
    sent = defaultdict(int)
    for slot, s in rows:
        sent[s] += 1
        assert max(abs(sent[f"s{k}"] - (slot + 1) / 24) for k in range(24)) < 2  # groups of groups: two levels


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 2**0.5, "b": 1, "c": 0.1, "d": 3**0.5}, {"a": 20_000, "b": 1}, {"a": 19_999, "b": 1, "c": 1e-3}, {f"s{k}": (k + 1) ** 0.5 for k in range(20)}])
def test_every_slot_is_within_one_block_of_the_exact_weight(weights):
    total, n = sum(weights.values()), 60_000
    blocks = {s: int(n * w / total) + 2 for s, w in weights.items()}
    at = np.full(sum(blocks.values()), -1)
    for k, s in enumerate(sorted(blocks)):
        for x, first, last, slot0, span, slots in mixing.schedule(blocks, mixing.exact(weights)):
            if x == s:
                assert len(slots) == last - first <= mixing.CHUNK and first // mixing.CHUNK == (last - 1) // mixing.CHUNK and slots[-1] + 1 == span
                at[slot0 + np.asarray(slots)] = k
    assert (at >= 0).all()
    ends = min(np.flatnonzero(at == k)[-1] for k in range(len(blocks))) + 1  # until then all sources run
    assert ends > 50_000
    for k, s in enumerate(sorted(blocks)):
        assert np.abs(np.cumsum(at[:ends] == k) - np.arange(1, ends + 1) * (weights[s] / total)).max() < 1 + 1e-6


def test_emitted_rows_hold_the_share_they_state(spark):
    n = {"a": 30_000, "b": 18_000, "c": 7_000, "d": 400}
    df = spark.range(sum(n.values())).select(F.col("id").alias("doc_id"), F.lit("xxxxxxxxxx").alias("text"), F.expr("case when id < 30000 then 'a' when id < 48000 then 'b' when id < 55000 then 'c' else 'd' end").alias("source"))
    rows = mixing.mix(df, block_chars=10, keep=["doc_id"]).select("slot", "source", "share").toPandas().sort_values("slot")
    share = dict(zip(rows.source, rows.share))
    assert rows.slot.tolist() == list(range(len(rows))) and abs(sum(share.values()) - 1) < 1e-12
    assert all(abs(share[s] - n[s] ** 0.5 / sum(x**0.5 for x in n.values())) < 1e-12 for s in n)
    ends = min(rows[rows.source == s].slot.max() for s in n) + 1
    for s in n:
        assert ((rows.source == s).cumsum()[:ends] - (rows.slot[:ends] + 1) * share[s]).abs().max() < 1


def test_blocks_grow_with_the_corpus_and_shares_are_checked(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 4)
    df = corpus(spark, {"a": [100_000] * 5, "b": [10] * 3})
    assert mixing.mix(df).agg(F.max("block")).first()[0] < 4 < mixing.mix(df, block_chars=16_384).agg(F.max("block")).first()[0]
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0, "b": 1})


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "a"), (3, "x" * 200_000, "a"), (4, "y", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("c") for c in ("slot", "node", "share", "up", "block", "place", "row", "size", "h", "bucket", "first", "last")})
    got = mixing.mix(df)
    assert got.count() == 5 and mixing.mixed(df).columns == df.columns and mixing.mixed(df).count() == 5
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, {"a": 2, "zz": 9}).count() == 5
