"""The daily digest as keyed state: one small state machine for each posting, so a day costs the rows that came and the keys that are open,
not a rewrite of the snapshot.

A key's state is whether its last delivered digest had it open, when it was last seen, and what it shows. A timer at the day's delivery time compares
both and gives what was added or removed; the state moves on only when an ``ack`` event says that the digest was sent, so what
could not be delivered is offered again the next day. A key that is neither open nor delivered is forgotten. The first snapshot
comes as initial state: the baseline, of which nothing is sent. Changes of what a posting shows do not count; its key is its identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "key string, shown string, kind string, change string, seen_at timestamp"
CHANGES = "key string, shown string, change string, day_ms bigint, watermark bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_delivery(after_ms: int, at: str, zone: str) -> int:
    """The first delivery time after a moment, in milliseconds; the clock is that of the zone, so days may have 23 or 25 hours."""
    here = ZoneInfo(zone)
    local = datetime.fromtimestamp(after_ms / 1000, timezone.utc).astimezone(here)
    day, clock = local.date(), time.fromisoformat(at)
    while True:
        found = int(datetime.combine(day, clock, here).timestamp() * 1000)
        if found > after_ms:
            return found
        day += timedelta(days=1)


class _Posting(StatefulProcessor):
    """state: delivered (was it open in the last digest that was sent), seen (milliseconds), shown."""

    def __init__(self, at: str, zone: str):
        self.at, self.zone = at, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("posting", "delivered boolean, seen bigint, shown string")

    def _now(self) -> tuple[bool, int, str]:
        return tuple(self.state.get()) if self.state.exists() else (False, -1, "")

    def _wake(self, after_ms: int) -> None:
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(next_delivery(after_ms, self.at, self.zone))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        seen = initialState["ms"]
        self.state.update((True, seen, initialState["shown"]))
        self._wake(seen)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        delivered, seen, shown = self._now()
        for r in sorted(rows, key=lambda r: (r["ms"], r["shown"] or "")):
            if r["kind"] == "seen":
                seen, shown = r["ms"], r["shown"]
            elif r["kind"] == "ack":
                delivered = r["change"] == "added"
        if delivered or seen >= 0:
            self.state.update((delivered, seen, shown))
            self._wake(max(seen, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        delivered, seen, shown = self._now()
        before = next_delivery(due - 25 * 3_600_000 - 1, self.at, self.zone)  # the delivery of the day before
        is_open = seen > (before if before < due else due - 24 * 3_600_000)
        if is_open or delivered:
            self.handle.registerTimer(next_delivery(due, self.at, self.zone))
        else:
            self.state.clear()
        if is_open != delivered:
            yield Row(key=key[0], shown=shown, change="added" if is_open else "removed", day_ms=due, watermark=timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class KeyedDigest:
    """Below ``folder``: acks/batch=<id> (what was sent) and the stream's checkpoint. events: a stream of EVENTS of kind 'seen' (a posting of a day's snapshot) or 'tick'
    (any later moment: closes the days before it). runs: () -> DataFrame (day) of the days whose collection was complete; changes of other days are not sent, for a
    collection that failed proves no posting closed. send: raises if the delivery fails."""

    def __init__(self, spark: SparkSession, folder: str, send: Callable[[DataFrame, int], None], runs: Callable[[], DataFrame], at: str = "07:30", zone: str = "UTC"):
        self.spark, self.folder, self.send, self.runs, self.at, self.zone = spark, folder, send, runs, at, zone
        self.said: list[tuple[int, str]] = []

    def _acked(self, batch_id: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/acks/batch={batch_id}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def acks(self) -> DataFrame:
        """What was delivered, as a stream of events for the same keys."""
        self.spark.createDataFrame([], EVENTS).write.mode("append").parquet(f"{self.folder}/acks/batch=-1")
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.folder}/acks").select("key", "shown", "kind", "change", "seen_at")

    def batch(self, found: DataFrame, batch_id: int) -> None:
        """foreachBatch body: sends a day's changes once, then acknowledges them; a batch that is replayed after its delivery does nothing."""
        if self._acked(batch_id):
            self.said.append((batch_id, "Already Delivered"))
            return
        whole = found.join(F.broadcast(self.runs().select("day").distinct()), "day", "left_semi").persist()
        try:
            if whole.isEmpty():
                return
            self.send(whole.select("key", "shown", "change", "day"), batch_id)
            # behind the watermark an event would be dropped as late
            ack = whole.select("key", "shown", F.lit("ack").alias("kind"), "change", F.timestamp_millis(F.col("watermark") + 1).alias("seen_at"))
            ack.write.mode("overwrite").parquet(f"{self.folder}/acks/batch={batch_id}")
            self.said.append((batch_id, "Sent"))
        except DeliveryError as e:
            self.said.append((batch_id, f"Failed: {e}"))
        finally:
            whole.unpersist()

    def start(self, events: DataFrame, baseline: DataFrame, **trigger):
        """baseline: (key, shown, seen_at) of the snapshot that the first digest compares with; read when the stream starts for the first time."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        ms = F.unix_millis("seen_at").alias("ms")  # moments reach Python as numbers, whatever its time zone
        keyed = events.select("key", "shown", "kind", "change", "seen_at").unionByName(self.acks()).withWatermark("seen_at", "0 seconds").select("*", ms).groupBy("key")
        changed = keyed.transformWithState(_Posting(self.at, self.zone), CHANGES, "Append", "EventTime", initialState=baseline.select("key", "shown", ms).groupBy("key"))
        changed = changed.select("key", "shown", "change", F.timestamp_millis("day_ms").alias("day"), "watermark")
        return changed.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


class DeliveryError(Exception):
    """A digest could not be sent; its changes are offered again the next day."""
