"""Run logs and schedules: status changes, statistics, claims."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import timefn as X
from . import scans
from .paging import top_per_key

ACTIVE = ("Queued", "Running", "Cancelling")


def statistics(runs: DataFrame, last: int = 100, averaged: int = 20) -> DataFrame:
    """By job: average runtime of the newest completed runs among the latest, and the newest run that was not skipped."""
    latest = top_per_key(runs, ["job_key"], [F.desc("started_at"), F.desc("id")], last)
    done = top_per_key(latest.where("status = 'Completed'"), ["job_key"], [F.desc("started_at"), F.desc("id")], averaged)
    average = done.groupBy("job_key").agg(F.bround(F.avg("runtime_seconds"), 2).alias("average_runtime"))
    newest = latest.where("status <> 'Skipped'").groupBy("job_key").agg(F.max_by(F.struct("id", "status", "started_at"), F.struct("started_at", "id")).alias("last_run"))
    return newest.join(average, "job_key", "full_outer")


def snapshot(runs: DataFrame, now) -> DataFrame:
    """Progress as a percentage (halves to even) and text, runtime up to now for active runs."""
    percent = F.when(F.col("progress_total") > 0, N.half_even(100.0 * F.col("progress_current") / F.nullif(F.col("progress_total"), F.lit(0)))).otherwise(0)
    shown = F.concat_ws(" ", "progress_verb", F.concat(F.col("progress_current").cast("string"), F.lit(" of "), F.col("progress_total").cast("string")), "progress_unit")
    live = F.when(F.col("status").isin(*ACTIVE), X.elapsed_seconds("started_at", now.cast("string"))).otherwise(F.col("runtime_seconds"))
    return runs.withColumns({"progress_percent": percent, "progress_text": shown, "live_runtime_seconds": live})


def interrupted(runs: DataFrame, now_text: str) -> DataFrame:
    """After a crash: active runs have failed, at the given time."""
    active = F.col("status").isin(*ACTIVE)
    return runs.withColumns({
        "runtime_seconds": F.when(active, X.elapsed_seconds("started_at", F.lit(now_text))).otherwise(F.col("runtime_seconds")), "completed_at": F.when(active, now_text).otherwise(F.col("completed_at")),
        "error": F.when(active, "The service restarted before this run ended.").otherwise(F.col("error")), "status": F.when(active, "Failed").otherwise(F.col("status")),
    })


def dashboard(registry: DataFrame, schedules: DataFrame, runs: DataFrame) -> DataFrame:
    """Each registered job with its schedule and its latest run."""
    newest = runs.groupBy("job_key").agg(F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("latest_run"))
    return registry.join(schedules, "job_key", "left").join(newest, "job_key", "left")


def claims(due: DataFrame, claimed: DataFrame) -> DataFrame:
    """At most one claim for each (job_key, local_date): due occurrences not claimed before, each once."""
    return due.select("job_key", "local_date").distinct().join(claimed.select("job_key", "local_date"), ["job_key", "local_date"], "left_anti")


def import_plan(incoming: DataFrame, existing: DataFrame, key: str, original: str) -> DataFrame:
    """create, update or update-id for each incoming row; ``original`` is its id before any repair."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    out = incoming.join(known, key, "left")
    return out.withColumn("action", F.when(F.col(key) != F.col(original), "update-id").when(F.col("_known"), "update").otherwise("create")).drop("_known")


#: From each status (blank: not there yet) to those that may follow. A run that has ended stays ended.
TRANSITIONS = {
    "": ("Queued", "Running", "Skipped"), "Queued": ("Running", "Cancelling", "Cancelled", "Failed"), "Running": ("Running", "Cancelling", "Completed", "Failed", "Cancelled"),
    "Cancelling": ("Cancelling", "Cancelled", "Completed", "Failed"), "Completed": (), "Failed": (), "Cancelled": (), "Skipped": (),
}
STATES = tuple(TRANSITIONS)


#: The place of the state that follows for each state and status, or -1.
MOVES = tuple(tuple(k if b in TRANSITIONS[a] else -1 for k, b in enumerate(STATES)) for a in STATES)


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (..., s, begin, starts) with ``before``: the state in which each event finds its run. One state is held, whatever the length of a run."""
    state = 0
    for batch in batches:
        found = []
        for s, begin, starts in zip(*(batch.column(c).to_pylist() for c in ("s", "begin", "starts"))):
            state = begin if starts else state
            found.append(state)
            if s >= 0 and MOVES[state][s] >= 0:
                state = MOVES[state][s]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "before"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (run, _seg, s, starts, ends) to one for each segment: (run, _seg, map), the state behind it for each state before it."""
    same, held = tuple(range(len(STATES))), ()
    after = functools.cache(lambda held, s: tuple(MOVES[x][s] if s >= 0 and MOVES[x][s] >= 0 else x for x in held))
    for batch in batches:
        at, maps = [], []
        for i, (s, starts, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("s", "starts", "ends")))):
            held = after(same if starts else held, s)
            if ends:
                at.append(i)
                maps.append(held)
        done = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([done.column("run"), done.column("_seg"), pa.array(maps, pa.list_(pa.int32()))], ["run", "_seg", "map"])


def _schema(df: DataFrame, columns: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), more])


def trace_events(events: DataFrame, run: str, order: str, status: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """A row for each event: (run, o: its order, to: its status, f: its fields, from: the state in which it finds its run, taken: whether it may follow).

    Unknown statuses are refused; events of equal order go by status and fields. Runs are walked in order, a state at a time. A run with very many events is cut into
    segments: each is summed up as a map from the state before to the state behind, the maps are chained, and the segments are walked from where they begin.
    """
    known = F.array(*map(F.lit, STATES))
    rows = events.select(F.col(run).alias("run"), F.col(order).alias("o"), T.blank(status).alias("to"), F.struct(*fields).alias("f") if fields else F.struct(F.lit(None).cast("string").alias("none")).alias("f"))
    rows = rows.withColumn("s", F.coalesce(F.array_position(known, F.col("to")), F.lit(0)).cast("int") - 1)
    rows, hot = scans.segmented(rows, "run", "o")
    turn = W.partitionBy("run", "_seg").orderBy("o", "to", "f")
    if hot:
        ordered = rows.where("_hot").select("run", "_seg", "s", (F.row_number().over(turn) == 1).alias("starts"), F.lead("_seg").over(turn).isNull().alias("ends"))
        maps = ordered.mapInArrow(_maps, _schema(ordered, ["run", "_seg"], "map array<int>"))
        chain = maps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("_seg", "map"))).alias("maps"))  # at most SEGMENTS
        none = F.array().cast("array<struct<_seg:int,begin:int>>")
        step = lambda acc, m: F.struct(F.concat(acc.getField("at"), F.array(F.struct(m.getField("_seg").alias("_seg"), acc.getField("state").alias("begin")))).alias("at"), F.get(m.getField("map"), acc.getField("state")).alias("state"))
        begins = chain.select("run", F.explode(F.aggregate("maps", F.struct(none.alias("at"), F.lit(0).alias("state")), step, lambda acc: acc.getField("at"))).alias("b")).select("run", "b._seg", "b.begin")
        rows = rows.join(F.broadcast(begins), ["run", "_seg"], "left").withColumn("begin", F.coalesce("begin", F.lit(0)))
    else:
        rows = rows.withColumn("begin", F.lit(0))
    ordered = rows.select("run", "o", "to", "f", "s", "begin", (F.row_number().over(turn) == 1).alias("starts"))
    walked = ordered.mapInArrow(_before, _schema(ordered, ordered.columns, "before int"))
    leads = F.get(F.array(*(F.lit(k) for row in MOVES for k in row)), F.col("before") * len(STATES) + F.col("s"))
    return walked.select("run", "o", "to", "f", F.get(known, F.col("before")).alias("from"), ((F.col("s") >= 0) & (leads >= 0)).alias("taken"))


def fold_events(events: DataFrame, run: str, order: str, status: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """(run, status, last, n_events, n_refused, refused): the state of every run after its ordered events, the ``fields`` of the last event that counted, and the
    events that may not follow (order, from, to), which change nothing. ``refused`` is one array a run, made only where it is selected; ``trace_events`` has them as rows.
    """
    at = F.struct("o", "to", "f")
    out = trace_events(events, run, order, status, fields).groupBy("run").agg(
        F.max_by("to", F.when(F.col("taken"), at)).alias("status"), F.max_by("f", F.when(F.col("taken"), at)).alias("last"), F.count("*").alias("n_events"), F.count_if(~F.col("taken")).alias("n_refused"),
        F.collect_list(F.when(~F.col("taken"), F.struct("o", "to", "f", "from"))).alias("refused"),
    )
    refused = F.transform(F.array_sort("refused"), lambda x: F.struct(x.getField("o").alias("o"), x.getField("from").alias("from"), x.getField("to").alias("to")))
    return out.select(F.col("run").alias(run), F.coalesce("status", F.lit("")).alias("status"), *([F.col("last")] if fields else []), "n_events", "n_refused", refused.alias("refused"))


def cancel_requests(runs: DataFrame, asked: DataFrame, run: str, message: str = "Stopping after the current item finishes.") -> DataFrame:
    """The events (run, status, message) that cancelling writes: for queued and running runs alone, each once."""
    return runs.join(asked.select(run).distinct(), run, "left_semi").where(F.col("status").isin("Queued", "Running")).select(run, F.lit("Cancelling").alias("status"), F.lit(message).alias("message"))


def skipped(actions: DataFrame, action: str, reason: str, now: str) -> DataFrame:
    """The runs (job_key, status, message, error, started_at, completed_at, runtime_seconds) that are written for actions not started, with why."""
    return actions.select(F.col(action).alias("job_key"), F.lit("Skipped").alias("status"), F.col(reason).alias("message"), F.col(reason).alias("error"), F.lit(now).alias("started_at"), F.lit(now).alias("completed_at"), F.lit(0.0).alias("runtime_seconds"))
