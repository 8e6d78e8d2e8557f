"""Run states from event logs against a plain loop: random orders, segments, unknown statuses; what cancelling and skipping write."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewell.operators import runs, scans


def plain(events):
    out = {}
    for run in {e[0] for e in events}:
        state, last, refused = "", None, []
        for _, o, s, p in sorted((e for e in events if e[0] == run), key=lambda e: (e[1], e[2] or "", (e[3] is not None, e[3] or 0))):
            s = s or ""
            if s in runs.TRANSITIONS[state] and s:
                state, last = s, p
            else:
                refused.append((o, state, s))
        out[run] = (state, last, len([e for e in events if e[0] == run]), refused)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_states_against_a_loop(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(scans, "HOT_ROWS", 8)
        monkeypatch.setattr(scans, "SEGMENTS", 6)
    rng = random.Random(31)
    statuses = ["Queued", "Running", "Running", "Running", "Cancelling", "Cancelling", "Completed", "Failed", "Cancelled", "Skipped", "Odd", None]
    events = [(f"r{k}", rng.randrange(60), rng.choice(statuses if rng.random() < 0.3 else statuses[:5]), rng.randrange(9)) for k in range(60) for _ in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(events, "run string, o int, status string, progress int").repartition(5)
    got = runs.fold_events(df, "run", "o", "status", ("progress",)).collect()
    want = plain(events)
    assert len(got) == len(want)
    for r in got:
        # events of one order and status may tie in their fields alone
        assert (r.status, r.n_events, [tuple(x) for x in r.refused]) == (want[r.run][0], want[r.run][2], want[r.run][3]), r.run
        assert (r.last.progress if r.last else None) == want[r.run][1]
    assert runs.fold_events(df.limit(0), "run", "o", "status").count() == 0


def test_requests(spark):
    now = spark.createDataFrame([("a", "Queued"), ("b", "Running"), ("c", "Completed"), ("d", "Running")], "run string, status string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("zz",)], "run string")
    assert sorted((r.run, r.status) for r in runs.cancel_requests(now, asked, "run").collect()) == [("a", "Cancelling"), ("b", "Cancelling")]
    r = runs.skipped(spark.createDataFrame([("refresh", "another run is active")], "action string, why string"), "action", "why", "2024-01-01").first()
    assert (r.job_key, r.status, r.error, r.runtime_seconds) == ("refresh", "Skipped", "another run is active", 0.0)


def test_a_long_run_takes_time_in_proportion(spark):
    """Nearly all of a run's events are refused: an array that grows by one event at a time copies some 1,800 million entries."""
    n = 60_000
    e = spark.range(n).select((F.col("id") % 1).alias("run"), F.col("id").alias("o"), F.when(F.col("id") == 0, "Queued").when(F.col("id") == n - 1, "Running").otherwise("Odd").alias("status"), F.col("id").alias("progress"))
    began = time.time()
    r = runs.fold_events(e, "run", "o", "status", ("progress",)).select("status", "last.progress", "n_events", F.size("refused"), F.slice("refused", 1, 1)).first()
    assert (*r[:4], *map(tuple, r[4])) == ("Running", n - 1, n, n - 2, (1, "Queued", "Odd"))
    assert time.time() - began < 20
